"""Readers of the corpus formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.points import parse_points, valid_alignment
from ..scratch import written


def numbered_lines(spark: SparkSession, path: str, name: str = "line") -> DataFrame:
    """``row_id, <name>``: lines with dense numbers in the order of files and positions.

    The lines are written once with an increasing id, so that numbers don't change when a task runs
    again. Within a split of a file the ids are consecutive; splits are set off by the lines before
    them, a running sum over one row per split."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = written(spark.read.text(path).select(F.col("value").alias(name), *at, F.monotonically_increasing_id().alias("id")), "lines")
    splits = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(offsets, ["file", "start"]).select((F.col("offset") + F.col("id") - F.col("first")).alias("row_id"), name)


def read_bitext(spark: SparkSession, src_path: str, tgt_path: str) -> DataFrame:
    """``row_id, src_raw, tgt_raw`` of two line-aligned files; an error when they differ in length."""
    src, tgt = numbered_lines(spark, src_path, "src_raw"), numbered_lines(spark, tgt_path, "tgt_raw")
    a, b = ((df.agg(F.max("row_id")).first()[0] if not df.isEmpty() else -1) + 1 for df in (src, tgt))
    if a != b:
        raise ValueError(f"the sides have {a} and {b} lines")
    return src.join(tgt, "row_id")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    lines = numbered_lines(spark, path)
    return lines.select("row_id", parse_points(F.col("line")).alias("points"), valid_alignment(F.col("line")).alias("valid"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """One number per line; blank lines and other text are skipped, rows keep their line's number."""
    return numbered_lines(spark, path).select("row_id", F.expr("try_cast(line as double)").alias("score")).where("score is not null and not isnan(score)")


FIX_SCHEMA = "src_phrase string, src_fix string, tgt_phrase string, tgt_fix string, direction int, percentage int, num_occurrences long, type string"


def read_fixes(spark: SparkSession, path: str) -> DataFrame:
    """Complete entries of a JSON array."""
    df = spark.read.schema(FIX_SCHEMA).json(path, multiLine=True)
    return df.dropna(subset=["src_phrase", "src_fix", "tgt_phrase", "tgt_fix", "direction"])


def clean_hidden(entries: DataFrame) -> DataFrame:
    """``src, tgt``: trimmed, a source required, '' for any target, each once."""
    out = entries.select(F.trim("src").alias("src"), F.coalesce(F.trim("tgt"), F.lit("")).alias("tgt"))
    return out.where("src != ''").dropDuplicates()


def read_hidden(spark: SparkSession, path: str) -> DataFrame:
    return clean_hidden(spark.read.schema("src string, tgt string").json(path, multiLine=True))


def wordlist_entries(lines: DataFrame) -> DataFrame:
    """Words of lines that are neither blank nor comments, as entries for any target."""
    word = F.trim("value")
    return lines.select(word.alias("src"), F.lit("").alias("tgt")).where("src != '' and not startswith(src, '#')")


def hidden_from_wordlist(spark: SparkSession, path: str) -> DataFrame:
    return wordlist_entries(spark.read.text(path))


def split_pairs(lines: DataFrame) -> DataFrame:
    parts = F.split("value", r"\|\|\|")
    return lines.where(F.size(parts) >= 2).select(parts[0].alias("src"), parts[1].alias("tgt"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``src|||tgt`` lines."""
    return split_pairs(spark.read.text(path))


def read_lex_src(spark: SparkSession, path: str) -> DataFrame:
    """``entry_id, tag, form, line`` of a CSV cut at its first two commas."""
    parts = F.split("text", ",", 3)
    lines = numbered_lines(spark, path, "text").where(F.size(parts) == 3)
    return lines.select(parts[0].alias("entry_id"), F.trim(parts[1]).alias("tag"), F.trim(parts[2]).alias("form"), F.col("row_id").alias("line"))


def read_lex_tgt(spark: SparkSession, path: str) -> DataFrame:
    """``form, lemma, feat, line`` of a TSV of at least three columns."""
    parts = F.split("text", "\t")
    lines = numbered_lines(spark, path, "text").where(F.size(parts) >= 3)
    return lines.select(*[F.trim(parts[i]).alias(n) for i, n in enumerate(("form", "lemma", "feat"))], F.col("row_id").alias("line"))


def read_ttable(spark: SparkSession, path: str) -> DataFrame:
    """``e, f, p`` of a saved lexical table of log-probabilities."""
    df = spark.read.schema("e string, f string, logp double").csv(path, sep="\t", quote="")
    return df.select("e", "f", F.exp("logp").alias("p"))


def load_bitext(spark: SparkSession, path: str, project_id: int) -> DataFrame:
    """A project's rows that are not deleted: partition filter and pushed-down flag."""
    return spark.read.parquet(path).where((F.col("project_id") == project_id) & ~F.col("deleted"))
