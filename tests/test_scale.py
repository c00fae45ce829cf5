"""Operators that must not gather hot keys, against plain versions."""

from __future__ import annotations

import hashlib
import random
import time
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from duotext.functions import points as P
from duotext.operators import fixes as fx
from duotext.operators import phrases as ph
from duotext.operators.browse import linked_words
from duotext.operators.hidden import hide
from duotext.operators.index import find_phrases, search_indexed, token_index
from duotext.operators.numbering import numbered
from duotext.operators.prep import vocab
from duotext.operators.tables import percent_text, phrase_table
from duotext.plans import registry
from duotext.sources.readers import read_fixes
from duotext.sources.writers import csv_columns, dense_rows, write_fixes
from duotext.streaming.counts import stream_phrase_counts


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_numbers_are_dense_and_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc") * rng.randrange(1, 4), rng.randrange(50)) for _ in range(500)]
    got = numbered(spark.createDataFrame(rows, "k string, v long").repartition(6), ["k", F.desc("v")], "n").collect()
    assert sorted(r.n for r in got) == list(range(500))
    in_order = [(r.k, -r.v) for r in sorted(got, key=lambda r: r.n)]
    assert in_order == sorted(in_order) and sorted((r.k, r.v) for r in got) == sorted(rows)
    assert numbered(spark.createDataFrame([], "k string"), ["k"]).count() == 0
    words = {r.word: r.id for r in vocab(spark.createDataFrame([(["b", "a"], ["c", "a"]), (["a"], [])], "src array<string>, tgt array<string>")).collect()}
    assert words == {"a": 0, "b": 1, "c": 2}


def test_new_hidden_entries_follow_the_largest_id(spark):
    have = spark.createDataFrame([(7, 1, "a", "b")], "id long, project_id long, src_phrase string, tgt_phrase string")
    more = have.drop("id").unionByName(spark.createDataFrame([(1, "z", ""), (1, "c", "d"), (1, "c", "d")], "project_id long, src_phrase string, tgt_phrase string"))
    assert sorted(tuple(r) for r in hide(have, more).collect()) == [(7, 1, "a", "b"), (8, 1, "c", "d"), (9, 1, "z", "")]


def test_top_targets_of_a_hot_source_are_cut_before_the_shuffle(spark):
    rng = random.Random(2)
    rows = [("hot", f"t{rng.randrange(3000)}", 0, rng.randrange(1, 9)) for _ in range(6000)] + [(f"s{i % 40}", f"t{i % 7}", 0, 1 + i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "src_phrase string, tgt_phrase string, direction int, num_occurrences long").repartition(8)
    table = phrase_table(df, top_k=5)
    sums = defaultdict(lambda: defaultdict(int))
    for s, t, _, n in rows:
        sums[s][t] += n
    for r in table.collect():
        best = sorted(sums[r.src].items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(x["tgt"], x["count"]) for x in r.topk] == best and r.total == sum(sums[r.src].values()) and r.num_tgts == len(sums[r.src])
    assert "Partial" in plan_of(table).split("WindowGroupLimit")[-1] and plan_of(table).count("WindowGroupLimit") >= 2


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = ["the", "the", "the", "a", "b", "c", "d", "rare"]
    rows = [(i % 2, i, [rng.choice(words) for _ in range(rng.randrange(0, 9))], [rng.choice(words).upper() for _ in range(rng.randrange(0, 6))], i % 9 == 0) for i in range(150)]
    return rows, spark.createDataFrame(rows, "project_id long, row_id long, src array<string>, tgt array<string>, deleted boolean")


def holds(line, phrase) -> bool:
    words = phrase.split(" ")
    return any(line[i : i + len(words)] == words for i in range(len(line) - len(words) + 1))


def test_search_by_the_rarest_token(spark, corpus):
    rows, df = corpus
    asked = [(i, i % 2, s, t) for i, (s, t) in enumerate([("the", "A"), ("the the", "THE"), ("the rare", "B"), ("a the b", "THE"), ("none", "A"), ("rare", "THE C"), ("the", "NONE"), ("the the the", "THE THE")])]
    asked += [(20, 1, "the a", None), (21, 0, None, "RARE"), (22, 0, "", "A")]
    got = sorted(tuple(r) for r in find_phrases(token_index(df), spark.createDataFrame(asked, "id long, project_id long, src_phrase string, tgt_phrase string")).collect())
    want = [(i, p, r) for i, p, s, t in asked for q, r, src, tgt, gone in rows if p == q and not gone and (s is None or (s and holds(src, s))) and (t is None or holds(tgt, t))]
    assert got == sorted(want)
    # Whatever the case; an empty phrase asks nothing.
    any_case = spark.createDataFrame([(1, 0, "THE Rare", ""), (2, 1, None, "the"), (3, 1, "", None)], "id long, project_id long, src_phrase string, tgt_phrase string")
    got = sorted(tuple(r) for r in search_indexed(token_index(df, lower=True), any_case).collect())
    assert got == sorted([(1, 0, r) for q, r, src, _, gone in rows if q == 0 and not gone and holds(src, "the rare")] + [(2, 1, r) for q, r, _, tgt, gone in rows if q == 1 and not gone and holds(tgt, "THE")])


def test_a_share_of_a_fix_is_the_lowest_hashes(spark):
    rows = [(f, 0, i) for f, n in ((1, 9000), (2, 1), (3, 10), (4, 70)) for i in range(n)]
    matches = spark.createDataFrame(rows, "fix_id long, project_id long, row_id long")
    fixes = spark.createDataFrame([(1, 37), (2, 10), (3, 0), (4, 100)], "id long, percentage int")
    sampled = fx.sample_rows(matches, fixes, seed=5)
    got = defaultdict(set)
    for r in sampled.collect():
        assert r.row_id not in got[r.fix_id]
        got[r.fix_id].add(r.row_id)
    for f, pct, n in ((1, 37, 9000), (2, 10, 1), (3, 0, 10), (4, 100, 70)):
        lowest = sorted(range(n), key=lambda i: (hashlib.md5(f"{i}/5".encode()).hexdigest(), i))
        assert got[f] == set(lowest[: max(1, n * pct // 100)])


def test_shares_in_text(spark):
    rows = [(1, 8), (13, 16), (1, 3), (2, 3), (5, 5), (1, 2000)]
    got = [r.p for r in spark.createDataFrame(rows, "a long, b long").coalesce(1).select(percent_text(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == ["12.5%", "81.3%", "33.3%", "66.7%", "100.0%", "0.1%"]


def test_long_rows_are_symmetrised_and_extracted_in_linear_time(spark):
    n = 512
    a = [(i, i) for i in range(n)] + [(i, i + 1) for i in range(0, n - 1, 3)]
    b = [(i, i) for i in range(0, n, 2)] + [(i + 1, i) for i in range(0, n - 1, 5)]
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(k, words, words, a, b) for k in range(16)], f"row_id long, src array<string>, tgt array<string>, a {P.POINTS}, b {P.POINTS}")
    began = time.time()
    out = df.withColumn("points", P.grow_diag_final_and(F.col("a"), F.col("b"))).drop("a", "b")
    assert all(len(r.points) > n for r in out.collect())
    assert ph.extract_phrases(out).count() > 16 * n and time.time() - began < 60


def test_fixes_written_as_arrays_are_read(spark, tmp_path):
    rows = [(f"s{i}", f"f{i}", f"t{i}", None if i % 4 == 0 else "x", 0, 50, 3, "fix") for i in range(40)]
    schema = "src_phrase string, src_fix string, tgt_phrase string, tgt_fix string, direction int, percentage int, num_occurrences long, type string"
    write_fixes(spark.createDataFrame(rows, schema), f"file://{tmp_path}/f", per_file=7)
    assert sorted(tuple(r) for r in read_fixes(spark, f"file://{tmp_path}/f").collect()) == sorted(r for r in rows if r[3])


def test_row_ids_are_dense_in_each_project(spark):
    df = spark.createDataFrame([(p, i * 7 + p, f"{p}/{i}") for p in (0, 1, 5) for i in range(6)], "project_id long, row_id long, x string")
    assert sorted(tuple(r) for r in dense_rows(df).collect()) == [(p, i, f"{p}/{i}") for p in (0, 1, 5) for i in range(6)]


def test_shares_are_written_as_their_exact_value_rounds(spark):
    """1/128 lies half way between two texts of six decimals; 3/3200 is a little off it as a double."""
    values = [1 / 128, 3 / 128, 3 / 3200, 0.0, 1.0, 2 / 3]
    table = spark.createDataFrame([("all", f"s{i}", 1, "t", 1, v, 1, v, [("t", 1)]) for i, v in enumerate(values)], "direction string, src string, total long, top_tgt string, top_count long, top_share double, num_tgts long, entropy double, topk array<struct<tgt:string,count:long>>")
    got = {r.src: (r.top_share, r.entropy) for r in csv_columns(table).collect()}
    want = duckdb.sql(f"select printf('%.6f', unnest({values}::double[]))").fetchall()
    assert [got[f"s{i}"] for i in range(len(values))] == [(w, w) for w, in want] and got["s0"][0] == "0.007812"


def test_searched_words_may_have_letters_without_capitals(spark, tmp_path):
    """The query in capitals against its SQL."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Groß{c % 2} Straße ist da {c}" if t % 2 == 0 else f"Ja {c} gut") for c in range(4) for t in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["qry2_indexed_search"]).fetchall()
    assert want and sorted(tuple(r) for r in registry.QUERIES["qry2_indexed_search"](spark, str(tmp_path)).select("id", "project_id", "row_id").collect()) == sorted(want)


def test_a_project_is_no_task_of_its_own(spark):
    """Numbers of a project's first row are broadcast, and a streamed batch of one file is dealt out before extraction."""
    df = spark.range(90).selectExpr("id % 3 as project_id", "id as row_id", "array('a') as src", "array('b') as tgt", "array(named_struct('s', 0, 't', 0)) as points")
    dense = dense_rows(df)
    assert "BroadcastHashJoin" in plan_of(dense) and "SortMergeJoin" not in plan_of(dense)
    assert sorted((r.project_id, r.row_id) for r in dense.collect()) == [(p, i) for p in range(3) for i in range(30)]
    counts = plan_of(stream_phrase_counts(df.coalesce(1)))
    assert "hashpartitioning(row_id" in counts
    words = linked_words(df)
    assert plan_of(words).split("== Physical Plan ==")[-1].count("Exchange") == 1 and words.count() == 90


def test_extraction_is_done_once_for_fixes(spark, tmp_path, monkeypatch):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"one two {c % 2}") for c in range(8) for t in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("fix1_match", "fix2_sample", "phr6_drop_ignored", "fix7_augment"):
        made = registry.QUERIES[name](spark, str(tmp_path))
        assert "array_sort(transform(points" not in plan_of(made)  # the index of links, with which extraction begins
        cols = made.columns
        cur = con.execute(registry.ORACLES[name])
        names = [x[0] for x in cur.description]
        assert sorted(tuple(r) for r in made.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def test_extraction_of_many_rows_at_once_is_that_of_each_row(spark):
    # Nested lambdas took each row by itself; flat arrays must keep rows apart, also where links lead behind the last word.
    rng = random.Random(12)
    rows = [(0, [], [], []), (1, ["a"], ["b"], [(0, 0), (5, 0), (0, 7)]), (2, ["#NB", "x", "#NB"], ["y"], [(0, 0), (1, 0), (2, 0)]), (3, ["a", "b"], ["c"], [])]
    for i in range(4, 40):
        n, m = rng.randrange(1, 9), rng.randrange(1, 9)
        words = lambda k: [rng.choice(["u", "v", "w", "#NB", ",", "#BLANK"]) for _ in range(k)]
        rows.append((i, words(n), words(m), [(rng.randrange(n), rng.randrange(m)) for _ in range(rng.randrange(8))]))
    df = spark.createDataFrame([(i, s, t, [{"s": a, "t": b} for a, b in p]) for i, s, t, p in rows], "row_id long, src array<string>, tgt array<string>, points array<struct<s:int,t:int>>")

    def strip(words):
        while words and words[0] in ("#NB", "#BLANK"):
            words = words[1:]
        while words and words[-1] in ("#NB", "#BLANK"):
            words = words[:-1]
        return " ".join(words)

    ok = lambda x: x != "" and not {x[0], x[-1]} & set("#,")
    want = []
    for i, src, tgt, links in rows:
        for back in (False, True):
            mine, other, at = (tgt, src, [(t, s) for s, t in links]) if back else (src, tgt, links)
            for k in (1, 2, 3):
                for a in range(len(mine) - k + 1):
                    to = [y for x, y in at if a <= x < a + k]
                    if to:
                        b0, b1 = min(to), max(to)
                        home = [x for x, y in at if b0 <= y <= b1]
                        x, y = strip(mine[a : a + k]), strip(other[b0 : b1 + 1])
                        if min(home) == a and max(home) == a + k - 1 and ok(x) and ok(y):
                            want.append((i, y, x, -1, b0, a) if back else (i, x, y, 0, a, b0))
    assert sorted(tuple(r) for r in ph.extract_phrases(df.repartition(3)).collect()) == sorted(want)
    pairs = sorted({r[:3] for r in want})
    assert sorted((r.src_phrase, r.tgt_phrase) for r in ph.row_phrases(df).collect()) == sorted(r[1:] for r in pairs)
    assert "lambda" not in ph.extract_phrases(df)._jdf.queryExecution().executedPlan().toString()
