"""Files written from the corpora and read back: sources and sinks in one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.points import format_points
from ..operators import em, hidden, tables
from ..operators import phrases as ph
from ..scratch import scratch_path
from ..sources import readers, writers
from ..streaming.counts import stream_capped_counts, stream_force_align, stream_phrase_counts
from . import fixtures as fx
from . import queries_align, queries_phrases, queries_prep, queries_tables
from .queries_phrases import occ_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _lines(df, key: str, line, path: str) -> str:
    """A text folder whose parts are in the order of ``key``."""
    rows = df.select(key, line.alias("value")).repartitionByRange(key).sortWithinPartitions(key)
    rows.select("value").write.text(path)
    return path


_NO = "row_number() over (order by row_id) - 1 as row_id"


@query("src1_read_bitext", f"with {fx.SQL_BITEXT} select {_NO}, array_to_string(src, ' ') as src_raw, array_to_string(tgt, ' ') as tgt_raw from bitext")
def _(spark, d):
    df, path = fx.bitext(spark, d), scratch_path(spark, "sides")
    sides = [_lines(df, "row_id", F.array_join(c, " "), f"{path}/{c}") for c in ("src", "tgt")]
    return readers.read_bitext(spark, *sides)


@query("src4_read_scores", f"with {fx.SQL_BITEXT}, n as (select {_NO}, score from bitext) select row_id, score from n where score is not null")
def _(spark, d):
    score = F.coalesce(F.col("score").cast("string"), F.lit("none"))
    return readers.read_scores(spark, _lines(fx.bitext(spark, d), "row_id", score, scratch_path(spark, "scores")))


@query("src9_read_lex_src", queries_tables._LEX + "select 'e' || line::varchar as entry_id, tag, upper(form) as form, row_number() over (order by line) - 1 as line from ls")
def _(spark, d):
    src = queries_tables._lexicons(spark, d)[0]
    text = F.concat_ws(",", F.concat(F.lit("e"), F.col("line")), "tag", "form")
    return readers.read_lex_src(spark, _lines(src, "line", text, scratch_path(spark, "lexicon")))


@query("src10_read_lex_tgt", queries_tables._LEX + "select form, form || '#' as lemma, feat, row_number() over (order by line) - 1 as line from lt")
def _(spark, d):
    tgt = queries_tables._lexicons(spark, d)[1]
    text = F.concat_ws("\t", "form", F.concat("form", F.lit("#")), "feat")
    return readers.read_lex_tgt(spark, _lines(tgt, "line", text, scratch_path(spark, "lexicon")))


@query("src11_read_ttable", f"with {queries_tables._WORDS}, t as (select src_phrase as e, tgt_phrase as f, num_occurrences / sum(num_occurrences) over (partition by src_phrase)::double as p from words), b as (select *, max(p) over (partition by e) as best from t) select e, f, round(p, 6) as p from b where ln(p) >= 4.0 * ln(best)")
def _(spark, d):
    w, path = queries_tables._words(spark, d), scratch_path(spark, "ttable")
    total = w.groupBy("src_phrase").agg(F.sum("num_occurrences").alias("t"))
    t = w.join(total, "src_phrase").select(F.col("src_phrase").alias("e"), F.col("tgt_phrase").alias("f"), (F.col("num_occurrences") / F.col("t")).alias("p"))
    writers.export_ttable(t, path)
    return readers.read_ttable(spark, path).select("e", "f", F.round("p", 6).alias("p"))


@query("snk1_corpus_files", f"with {fx.SQL_BITEXT} select {_NO}, {fx.sql_detokenise(chr(97) + 'rray_to_string(src, chr(32))')} as src_raw, {fx.sql_detokenise(chr(97) + 'rray_to_string(tgt, chr(32))')} as tgt_raw, {fx.sql_points('points')} as points from bitext")
def _(spark, d):
    df, path = fx.bitext(spark, d), scratch_path(spark, "corpus")
    writers.export_corpus(df, df.select("row_id"), path)
    points = readers.read_alignments(spark, f"{path}/alignment").select("row_id", format_points("points").alias("points"))
    return readers.read_bitext(spark, f"{path}/line1", f"{path}/line2").join(points, "row_id")


def _csv(spark, path):
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    return rows.select("direction", "src", *[F.col(c).cast("long").alias(c) for c in ("total", "top_count", "num_tgts")], "top_tgt", "top_share", "entropy", "topk")


_CSV = "select direction, src, total, top_count, num_tgts, top_tgt, printf('%.6f', top_share) as top_share, printf('%.6f', entropy) as entropy, topk from tab where total >= 10 and top_share "


@query("snk4_sure_csv", f"with {queries_tables._WORDS},{fx.sql_table('words')} {_CSV} >= 0.75")
def _(spark, d):
    path = scratch_path(spark, "sure")
    writers.write_sure(tables.phrase_table(queries_tables._words(spark, d)), path)
    return _csv(spark, f"{path}/csv")


@query("snk4_dubious_csv", f"with {queries_tables._WORDS},{fx.sql_table('words')} {_CSV} < 0.75")
def _(spark, d):
    path = scratch_path(spark, "dubious")
    writers.write_dubious(tables.phrase_table(queries_tables._words(spark, d)), path)
    return _csv(spark, f"{path}/csv")


@query("snk3_phrase_json", f"with {queries_tables._WORDS},{fx.sql_table('words')} select direction, src, total, top_tgt, top_count, num_tgts from tab")
def _(spark, d):
    path = scratch_path(spark, "phrases")
    writers.write_phrase_json(tables.phrase_table(queries_tables._words(spark, d)), path)
    schema = "direction string, src string, total long, top_tgt string, top_count long, num_tgts long"
    return spark.read.schema(schema).json(f"{path}/rows")


@query("snk5_hidden_json", f"with {fx.SQL_CATALOGUE} select id, project_id, src_phrase, tgt_phrase from hidden")
def _(spark, d):
    path = scratch_path(spark, "hidden")
    writers.write_json(fx.hidden_entries(spark, d), path)
    return spark.read.schema("id long, project_id long, src_phrase string, tgt_phrase string").json(path)


@query("snk7_symmetric_json", f"with {fx.SQL_OCC} select {fx.sql_detokenise('src_phrase')} as src_phrase, {fx.sql_detokenise('tgt_phrase')} as tgt_phrase, num_occurrences from counts where direction = 0")
def _(spark, d):
    path = scratch_path(spark, "symmetric")
    writers.write_json(writers.symmetric_pairs(ph.phrase_counts(occ_of(spark, d))), path)
    return spark.read.schema("src_phrase string, tgt_phrase string, num_occurrences long").json(path)


@query("snk6_ignored_json", f"with {fx.SQL_CATALOGUE}, i as (select src_phrase, tgt_phrase from hidden union select src_phrase, tgt_phrase from catalogue where ignore) select distinct trim(src_phrase) as src, trim(tgt_phrase) as tgt from i where trim(src_phrase) <> ''")
def _(spark, d):
    path = scratch_path(spark, "ignored")
    writers.write_ignored(hidden.all_ignored(fx.hidden_entries(spark, d), fx.catalogue(spark, d)), path)
    return readers.clean_hidden(spark.read.schema("src string, tgt string").json(path))


@query("snk9_stats_json", queries_prep.ORACLES["sta1_line_stats"])
def _(spark, d):
    stats, path = queries_prep.QUERIES["sta1_line_stats"](spark, d), scratch_path(spark, "stats")
    writers.write_stats(stats, path)
    return spark.read.schema(stats.schema).json(path)


@query("src5_read_fixes", f"with {queries_phrases._FIXES} select src_phrase, src_fix, tgt_phrase, tgt_fix, direction, percentage from fixes where id % 5 <> 0")
def _(spark, d):
    """Fixes as JSON arrays in several files; every fifth lacks a field and is left out."""
    fixes, path = queries_phrases._fixes(spark, d)[1], scratch_path(spark, "fixes")
    fixes = fixes.withColumn("tgt_fix", F.when(F.col("id") % 5 != 0, F.col("tgt_fix")))
    writers.write_fixes(fixes.drop("id", "project_id"), path, per_file=100)
    return readers.read_fixes(spark, path).select("src_phrase", "src_fix", "tgt_phrase", "tgt_fix", "direction", "percentage")


@query("prj3_save_bitext", f"with {fx.SQL_BITEXT} select project_id, row_number() over (partition by project_id order by b.row_id) - 1 as row_id, array_to_string(src, ' ') as src, {fx.sql_points('points')} as points from bitext b where project_id <> 1 or b.row_id % 2 = 0")
def _(spark, d):
    """Project 1 is saved again with half of its rows."""
    df, path = fx.bitext(spark, d), scratch_path(spark, "bitext")
    writers.save_bitext(writers.dense_rows(df), path)
    writers.save_bitext(writers.dense_rows(df.where("project_id = 1 and row_id % 2 = 0")), path)
    saved = spark.read.parquet(path)
    return saved.select(F.col("project_id").cast("long").alias("project_id"), "row_id", F.array_join("src", " ").alias("src"), format_points("points").alias("points"))


_REPLACED = ", o as (select distinct row_id % 3 as project_id, * from occ where row_id % 3 <> 1 or row_id % 2 = 0)"


@query("snk12_replace_phrases", f"with {fx.SQL_OCC}{_REPLACED} select project_id, src_phrase, tgt_phrase, count(distinct row_id) as num_occurrences from o group by 1, 2, 3")
def _(spark, d):
    """Project 1 is written again with half of its rows; the phrases are counted anew from the files."""
    occ, path = occ_of(spark, d).withColumn("project_id", F.col("row_id") % 3), scratch_path(spark, "occurrences")
    writers.replace_phrases(occ, path)
    writers.replace_phrases(occ.where("project_id = 1 and row_id % 2 = 0"), path)
    return writers.recount_phrases(spark.read.parquet(path)).withColumn("project_id", F.col("project_id").cast("long"))


@query("prj3_snapshot", f"with {fx.SQL_BITEXT} select project_id, row_id, array_to_string(src, ' ') as src, {fx.sql_points('points')} as points, score, deleted from bitext")
def _(spark, d):
    path = scratch_path(spark, "snapshot")
    writers.save_snapshot({"bitext": fx.bitext(spark, d)}, path)
    df = writers.load_snapshot(spark, path)["bitext"]
    return df.select("project_id", "row_id", F.array_join("src", " ").alias("src"), format_points("points").alias("points"), "score", "deleted")


@query("snk11_versions", f"with {fx.SQL_BITEXT} select 1 as version, row_id, array_to_string(src, ' ') as src from bitext union all select 2, row_id, array_to_string(src, ' ') from bitext where row_id % 2 = 0")
def _(spark, d):
    """Two versions: the first and the last one are read."""
    df, path = fx.bitext(spark, d).select("row_id", F.array_join("src", " ").alias("src")), scratch_path(spark, "versions")
    writers.save_version({"bitext": df}, path)
    writers.save_version({"bitext": df.where("row_id % 2 = 0")}, path)
    read = [writers.load_version(spark, path, v)["bitext"].select(F.lit(v).alias("version"), "row_id", "src") for v in (1, None)]
    return read[0].unionByName(read[1].withColumn("version", F.lit(2)))


@query("str1_stream_counts", f"with {fx.SQL_OCC} select src_phrase, tgt_phrase, num_occurrences from counts")
def _(spark, d):
    df, path = fx.bitext(spark, d).select("row_id", "src", "tgt", "points"), scratch_path(spark, "stream")
    df.repartition(3, "row_id").write.parquet(f"{path}/in")
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")

    def latest(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out")

    counts = stream_phrase_counts(rows).writeStream.outputMode("complete").foreachBatch(latest)
    counts.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _sql_capped(batches: int, most: int) -> str:
    """Batches by ``row_id % batches``: r0 … are the counts after each."""
    out = ""
    for k in range(batches):
        before = f" union all select * from r{k - 1}" if k else ""
        out += f""",
b{k} as (select src_phrase, tgt_phrase, sum(n) as n from (select src_phrase, tgt_phrase, count(*) as n from by_row where row_id % {batches} = {k} group by 1, 2{before}) group by 1, 2),
r{k} as (select src_phrase, tgt_phrase, n from b{k} where n >= (select min(n) from (select n, sum(count(*)) over (order by n desc) as upto from b{k} group by n) where upto <= {most}))"""
    return out


@query("str1_capped_stream", f"with {fx.SQL_OCC}{_sql_capped(3, 400)} select src_phrase, tgt_phrase, n::bigint as num_occurrences from r2")
def _(spark, d):
    df, path = fx.bitext(spark, d).select("row_id", "src", "tgt", "points"), scratch_path(spark, "stream")
    for k in range(3):  # a batch each, in this order
        df.where(F.col("row_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{path}/in")
    rows = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream_capped_counts(rows, f"{path}/counts", f"{path}/state", 400).awaitTermination()
    return spark.read.parquet(f"{path}/counts/0")


@query("str2_stream_force_align", queries_align.ORACLES["aln13_force_align"])
def _(spark, d):
    df, path = fx.pseudo(spark, d), scratch_path(spark, "stream")
    df.write.parquet(f"{path}/in")
    rows = spark.readStream.schema(df.schema).parquet(f"{path}/in")
    sink = lambda batch, i: batch.select("row_id", "points", "log_prob").write.mode("append").parquet(f"{path}/out")
    stream_force_align(rows, em.train_model(df, iterations=3), 1.0, sink, f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("row_id", format_points("points").alias("points"), F.round("log_prob", 5).alias("log_prob"))
