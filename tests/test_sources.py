"""Files: readers, writers, snapshots and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from duotext.functions.points import POINTS
from duotext.operators.em import force_align, train_ttable
from duotext.operators.phrases import extract_phrases, phrase_counts
from duotext.operators.tables import phrase_table
from duotext.sources import readers, writers
from duotext.streaming.counts import stream_capped_counts, stream_force_align, stream_phrase_counts

BITEXT = f"project_id long, row_id long, src array<string>, tgt array<string>, points {POINTS}, score double, deleted boolean"
ROWS = [(i % 2, i, ["the", "car", str(i % 3)], ["il", "auto", str(i % 3)], [(0, 0), (1, 1), (2, 2)], 0.5, i == 3) for i in range(12)]


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_text_readers(spark, tmp_path):
    a, b = put(tmp_path / "a", "one\ntwo\n\nfour\n"), put(tmp_path / "b", "uno\ndue\n\nquattro\n")
    rows = sorted(readers.read_bitext(spark, a, b).collect())
    assert [tuple(r) for r in rows] == [(0, "one", "uno"), (1, "two", "due"), (2, "", ""), (3, "four", "quattro")]
    with pytest.raises(ValueError, match="4 and 1"):
        readers.read_bitext(spark, a, put(tmp_path / "c", "x\n")).count()
    al = sorted(readers.read_alignments(spark, put(tmp_path / "al", "0-0 1-2\n\nx ||| y ||| 2-1 1- a-b\n")).collect())
    assert [[tuple(p) for p in r.points] for r in al] == [[(0, 0), (1, 2)], [], [(2, 1)]] and [r.valid for r in al] == [True, False, False]
    sc = readers.read_scores(spark, put(tmp_path / "sc", "0.5\n\nNaN\nx\n1\n")).collect()
    assert sorted((r.row_id, r.score) for r in sc) == [(0, 0.5), (4, 1.0)]


def test_json_and_lexicon_readers(spark, tmp_path):
    whole = {"src_phrase": "a", "src_fix": "b", "tgt_phrase": "c", "tgt_fix": "d", "direction": 1}
    assert readers.read_fixes(spark, put(tmp_path / "f.json", json.dumps([whole, {"src_phrase": "a"}]))).count() == 1
    h = readers.read_hidden(spark, put(tmp_path / "h.json", json.dumps([{"src": " a "}, {"src": "a", "tgt": ""}, {"src": " ", "tgt": "x"}, {"src": "b", "tgt": "c"}])))
    assert sorted(map(tuple, h.collect())) == [("a", ""), ("b", "c")]
    w = readers.hidden_from_wordlist(spark, put(tmp_path / "w", "# no\n\n es \nas\n"))
    assert sorted(map(tuple, w.collect())) == [("as", ""), ("es", "")]
    p = readers.read_pairs(spark, put(tmp_path / "p", "a|||b\nx\n"))
    assert [tuple(r) for r in p.collect()] == [("a", "b")]
    s = readers.read_lex_src(spark, put(tmp_path / "s", "1,sost.femm.sing,ciasa\nbad\n2,v,a,b\n")).collect()
    assert sorted((r.tag, r.form) for r in s) == [("sost.femm.sing", "ciasa"), ("v", "a,b")]
    t = readers.read_lex_tgt(spark, put(tmp_path / "t", "casa\tcasa\tNOUN-F:s\nx\ty\n")).collect()
    assert [(r.form, r.feat, r.line) for r in t] == [("casa", "NOUN-F:s", 0)]


def test_table_round_trips(spark, tmp_path):
    bt = spark.createDataFrame(ROWS, BITEXT)
    table = train_ttable(bt, iterations=3)
    writers.export_ttable(table, str(tmp_path / "tt"), beam=-1e9)
    back = {(r.e, r.f): r.p for r in readers.read_ttable(spark, str(tmp_path / "tt")).collect()}
    assert back == pytest.approx({(r.e, r.f): r.p for r in table.collect()})
    pt = phrase_table(phrase_counts(extract_phrases(bt)).withColumn("tgt_phrase", F.concat("tgt_phrase", F.lit(', "q"'))))
    writers.write_phrase_csv(pt, str(tmp_path / "csv"))
    csv = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {(r.src, r.top_tgt) for r in csv.collect()} == {(r.src, r.top_tgt) for r in pt.collect()}
    writers.write_phrase_json(pt, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/rows")).count() == pt.count()
    writers.export_corpus(bt, bt.select("row_id"), str(tmp_path / "corpus"))
    assert spark.read.text(str(tmp_path / "corpus/line1")).count() == len(ROWS)


def test_projects_and_snapshots(spark, tmp_path):
    bt = spark.createDataFrame(ROWS, BITEXT)
    path = str(tmp_path / "bt")
    writers.save_bitext(bt, path)
    assert sorted(r.row_id for r in readers.load_bitext(spark, path, 1).collect()) == [1, 5, 7, 9, 11]
    writers.save_bitext(bt.where("project_id = 1 and row_id < 3"), path)
    assert readers.load_bitext(spark, path, 1).count() == 1 and readers.load_bitext(spark, path, 0).count() == 6
    snap = str(tmp_path / "snap")
    writers.save_snapshot({"bitext": bt, "phrases": phrase_counts(extract_phrases(bt))}, snap)
    out = writers.load_snapshot(spark, snap)
    assert set(out) == {"bitext", "phrases"} and out["bitext"].count() == len(ROWS)
    bt.limit(3).write.mode("overwrite").parquet(f"{snap}/bitext")
    with pytest.raises(ValueError, match="manifest"):
        writers.load_snapshot(spark, snap)


def test_a_save_that_fails_leaves_the_last_version(spark, tmp_path):
    bt, path = spark.createDataFrame(ROWS, BITEXT), str(tmp_path / "versions")
    with pytest.raises(ValueError, match="no version"):
        writers.load_version(spark, path)
    assert writers.save_version({"bitext": bt}, path) == 1
    broken = bt.withColumn("score", F.when(F.col("row_id") == 5, F.raise_error(F.lit("no disk")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="no disk"):
        writers.save_version({"extra": bt, "bitext": broken}, path)
    assert set(writers.load_version(spark, path)) == {"bitext"} and writers.load_version(spark, path)["bitext"].count() == len(ROWS)
    assert writers.save_version({"bitext": bt.limit(2)}, path) == 2
    assert writers.load_version(spark, path)["bitext"].count() == 2 and writers.load_version(spark, path, 1)["bitext"].count() == len(ROWS)
    with pytest.raises(ValueError, match="no version 3"):
        writers.load_version(spark, path, 3)


def test_a_capped_stream_equals_caps_by_hand(spark, tmp_path):
    bt = spark.createDataFrame(ROWS, BITEXT)
    parts = [bt.where(f"row_id % 3 = {k}") for k in range(3)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BITEXT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_capped_counts(stream, str(tmp_path / "out"), str(tmp_path / "ck"), max_phrases=12).awaitTermination()
    running = {}
    for part in parts:
        for r in phrase_counts(extract_phrases(part)).collect():
            key = (r.src_phrase, r.tgt_phrase)
            running[key] = running.get(key, 0) + r.num_occurrences
        while len(running) > 12:
            least = min(running.values())
            running = {k: v for k, v in running.items() if v > least}
    got = {(r.src_phrase, r.tgt_phrase): r.num_occurrences for r in spark.read.parquet(str(tmp_path / "out/0")).collect()}
    assert got == running


def test_streams_equal_batches(spark, tmp_path):
    bt = spark.createDataFrame(ROWS, BITEXT)
    bt.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(BITEXT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_phrase_counts(stream).writeStream.outputMode("complete").format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "ck1")).start()
    q.processAllAvailable()
    q.stop()
    want = phrase_counts(extract_phrases(bt)).select("src_phrase", "tgt_phrase", "num_occurrences")
    assert sorted(map(tuple, spark.table("pairs").collect())) == sorted(map(tuple, want.collect()))

    table = train_ttable(bt, iterations=3)
    got = []
    q = stream_force_align(stream, table, 1.0, lambda df, i: got.extend(df.select("row_id", "points").collect()), str(tmp_path / "ck2"))
    q.awaitTermination(120)
    assert sorted(map(tuple, got)) == sorted(map(tuple, force_align(bt, table, 1.0).select("row_id", "points").collect()))
