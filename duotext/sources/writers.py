"""Writers: corpus, tables, reports and snapshots."""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.points import format_points
from ..functions.text import detokenise
from ..operators.numbering import numbered
from ..operators.tables import dubious, sure, table_summary, topk_text
from ..scratch import written


def export_lines(bitext: DataFrame) -> DataFrame:
    """``row_id, line1, line2, alignment`` as exported: detokenised sides and Pharaoh points."""
    return bitext.select(
        "row_id",
        detokenise(F.array_join("src", " ")).alias("line1"),
        detokenise(F.array_join("tgt", " ")).alias("line2"),
        format_points("points").alias("alignment"),
    )


def export_corpus(bitext: DataFrame, fixes: DataFrame, path: str) -> None:
    """Text folders whose parts are in row order, and the fixes as JSON."""
    lines = export_lines(bitext).repartitionByRange("row_id").sortWithinPartitions("row_id")
    for col in ("line1", "line2", "alignment"):
        lines.select(col).write.mode("overwrite").text(f"{path}/{col}")
    fixes.write.mode("overwrite").json(f"{path}/fixes")


@F.pandas_udf(StringType())
def _six(x: pd.Series) -> pd.Series:
    """Six decimals of the number's exact value, as C prints it; Java rounds the shortest decimal form, half up."""
    return x.map(lambda v: f"{v:.6f}", na_action="ignore")


def csv_columns(table: DataFrame) -> DataFrame:
    six = lambda c: _six(F.col(c).cast("double"))
    return table.select("direction", "src", "total", "top_tgt", "top_count", six("top_share").alias("top_share"), "num_tgts", six("entropy").alias("entropy"), topk_text().alias("topk"))


def write_phrase_csv(table: DataFrame, path: str) -> None:
    rows = csv_columns(table).orderBy(F.desc("total"), "src")
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def phrase_json(table: DataFrame) -> DataFrame:
    return table.select("direction", "src", F.to_json(F.struct(*[F.col(c) for c in table.columns])).alias("json"))


def write_phrase_json(table: DataFrame, path: str) -> None:
    phrase_json(table).select(F.col("json").alias("value")).write.mode("overwrite").text(f"{path}/rows")
    table_summary(table).write.mode("overwrite").json(f"{path}/summary")


def write_sure(table: DataFrame, path: str) -> None:
    write_phrase_csv(sure(table), f"{path}/csv")
    write_phrase_json(sure(table), f"{path}/json")


def write_dubious(table: DataFrame, path: str) -> None:
    write_phrase_csv(dubious(table), f"{path}/csv")
    write_phrase_json(dubious(table), f"{path}/json")


def write_json(df: DataFrame, path: str) -> None:
    """Hidden phrases, ignore lists, symmetric phrases and statistics as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_ignored(ignored: DataFrame, path: str) -> None:
    """The ignore list as the hidden-phrase reader takes it: ``src, tgt``, each pair once."""
    write_json(ignored.select(F.col("src_phrase").alias("src"), F.col("tgt_phrase").alias("tgt")).distinct(), path)


def write_stats(stats: DataFrame, path: str) -> None:
    """Statistics of a corpus, one object a row."""
    write_json(stats, path)


def write_fixes(fixes: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Fixes as JSON arrays, as the reader of fixes takes them: a file for about ``per_file`` of them."""
    n = max(1, -(-fixes.count() // per_file))
    group = F.pmod(F.xxhash64("src_phrase", "tgt_phrase", "direction"), F.lit(n))
    arrays = fixes.groupBy(group.alias("file")).agg(F.to_json(F.collect_list(F.struct(*fixes.columns))).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def symmetric_pairs(counts: DataFrame) -> DataFrame:
    shown = {c: detokenise(F.col(c)) for c in ("src_phrase", "tgt_phrase")}
    return counts.where("direction = 0").withColumns(shown).select("src_phrase", "tgt_phrase", "num_occurrences")


def beam_ttable(ttable: DataFrame, beam: float = -4.0) -> DataFrame:
    """``e, f, logp`` with log p at least ``-beam`` times the log of e's best p. The maximum is combined
    before its shuffle."""
    best = ttable.groupBy("e").agg(F.max("p").alias("best"))
    return ttable.join(best, "e").where(F.log("p") >= -beam * F.log("best")).select("e", "f", F.log("p").alias("logp"))


def export_ttable(ttable: DataFrame, path: str, beam: float = -4.0) -> None:
    beam_ttable(ttable, beam).write.mode("overwrite").csv(path, sep="\t", quote="")


def table_checksum(df: DataFrame) -> tuple[int, int]:
    """Rows, and the sum of the rows' checksums: the same in any order."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.crc32(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).cast("binary"))), F.lit(0))).first()
    return row[0], row[1]


SNAPSHOT_VERSION = 1


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """A Parquet folder per table and a manifest with version, rows and checksum."""
    spark = next(iter(tables.values())).sparkSession
    manifest = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest.append((SNAPSHOT_VERSION, name, *table_checksum(spark.read.parquet(f"{path}/{name}"))))
    spark.createDataFrame(manifest, "version int, name string, n long, checksum long").write.mode("overwrite").json(f"{path}/manifest")


def load_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables, after their rows and checksums agree with the manifest."""
    out = {}
    for m in spark.read.schema("version int, name string, n long, checksum long").json(f"{path}/manifest").collect():
        if m.version != SNAPSHOT_VERSION:
            raise ValueError(f"version {m.version} is not known")
        df = spark.read.parquet(f"{path}/{m.name}")
        if table_checksum(df) != (m.n, m.checksum):
            raise ValueError(f"{m.name} differs from its manifest")
        out[m.name] = df
    return out


_COMMIT = "version long, at timestamp"


def _commits(spark: SparkSession, path: str) -> list[int]:
    """The versions that were saved whole."""
    try:
        return [r.version for r in spark.read.schema(_COMMIT).json(f"{path}/commits").select("version").distinct().orderBy("version").collect()]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def save_version(tables: dict[str, DataFrame], path: str) -> int:
    """A snapshot beside the earlier ones, in two phases: its tables and its manifest are written to a folder of
    their own, then one line commits it. A save that fails on the way leaves the last version as it was, and its folder is
    written again by the next save."""
    spark = next(iter(tables.values())).sparkSession
    version = max(_commits(spark, path), default=0) + 1
    save_snapshot(tables, f"{path}/{version}")
    commit = spark.createDataFrame([(version,)], "version long").withColumn("at", F.current_timestamp())
    commit.coalesce(1).write.mode("append").json(f"{path}/commits")
    return version


def load_version(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a committed version, by default the last one."""
    known = _commits(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"{path} has no version {'at all' if version is None else version}")
    return load_snapshot(spark, f"{path}/{known[-1] if version is None else version}")


def dense_rows(bitext: DataFrame) -> DataFrame:
    """Row ids from 0 without gaps in each project, in the order of the old ones."""
    rows = written(numbered(bitext, ["project_id", "row_id"], "_n"), "dense-rows")
    firsts = rows.groupBy("project_id").agg(F.min("_n").alias("_first"))  # one row a project
    # Broadcast: joined by their project, all rows of one would meet in one task.
    return rows.join(F.broadcast(firsts), "project_id").withColumn("row_id", F.col("_n") - F.col("_first")).select(*bitext.columns)


def save_bitext(bitext: DataFrame, path: str) -> None:
    """Rows by project; a project that is written again replaces its partition only."""
    bitext.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def replace_phrases(occ: DataFrame, path: str) -> None:
    """A project's occurrences, each once, in place of its old ones."""
    occ.dropDuplicates().write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def recount_phrases(occ: DataFrame) -> DataFrame:
    """``project_id, src_phrase, tgt_phrase, num_occurrences``: the rows of each phrase in its project, as
    saved occurrences have them."""
    pair = ["project_id", "src_phrase", "tgt_phrase"]
    return occ.select(*pair, "row_id").distinct().groupBy(*pair).agg(F.count(F.lit(1)).alias("num_occurrences"))
