"""Odd rows through the operators that have an SQL oracle for ordinary ones."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duotext.llm.common import BLANKS
from duotext.llm.exact import exact_dedup, exact_groups
from duotext.llm.graph import components
from duotext.llm.lines import dedup_lines
from duotext.llm.mixing import mix_plan, mix_sources, source_targets
from duotext.llm.neardup import near_components, near_dedup, one_permutation
from duotext.llm.urls import judge_urls

SCHEMA = "doc_id long, text string, source string, lang string, kept boolean, digest string, size long, hash string"
LONG = " ".join(f"w{i}" for i in range(30000))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, None, True, "x", 1, "y") for d, t, s in rows], SCHEMA)


ODD = [(1, "a b", "s"), (2, "ab", None), (2, "ab", None), (3, " a\tb ", "s"), (None, "ab", "s"), (5, None, "s"), (6, " \n", "s"), (7, LONG, "t"), (8, LONG + " x", "t"), (9, "é", "")]


def test_exact_groups_and_weak_digests(spark):
    df = frame(spark, ODD).repartition(3)
    for digest in (None, lambda c: F.unhex(F.md5(F.substring(c, 1, 1))), lambda c: F.lit(b"0")):
        out = exact_groups(df, **({"digest": digest} if digest else {})).collect()
        got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in out)
        assert got == [(0, 3, 5, False), (1, 3, 5, False), (2, 3, 5, False), (2, 3, 5, False), (3, 3, 5, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True)]
    assert sorted(r.doc_id for r in exact_dedup(df).collect()) == [3, 6, 7, 8, 9]
    assert exact_groups(df.where("doc_id > 99")).count() == 0
    same = frame(spark, [(1, "a", "s")] * 3)
    assert exact_dedup(same).count() == 1 and exact_dedup(same).columns == same.columns


def test_exact_group_of_a_third_of_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")).repartition(7)
    out = exact_groups(df)
    assert out.where("keep_id = 0").count() == 1000 and out.where("kept").count() == 2001


def test_mixing_targets_and_odd_rows(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 300, "d": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
        free, left = free - over, left - sum(2 * sizes[s] for s in over)
    assert got == pytest.approx(target)

    df = frame(spark, ODD)
    plan = mix_plan(df).collect()
    assert len(plan) == len(ODD) and all(0 <= r.copies <= 2 for r in plan)
    mixed = mix_sources(df)
    copies = Counter()
    for r in plan:
        copies[r.doc_id] += r.copies
    assert mixed.columns == df.columns and Counter(r.doc_id for r in mixed.collect()) == +copies
    assert mix_plan(df.where("doc_id > 99")).count() == 0 and mix_sources(df.where("doc_id > 99")).count() == 0


def test_mixing_is_near_targets_whatever_the_partitions(spark):
    df = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + pow(id % 97, 2) as int))").alias("text"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 5))").alias("source")
    )
    one, two = (mix_plan(df.repartition(n)).select("doc_id", "copies").collect() for n in (2, 9))
    assert sorted(one) == sorted(two)
    for r in mix_plan(df).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target


def test_lines_of_odd_rows(spark):
    line = "a line that is long enough to be a key of its own"
    rows = [(i, f"{line}\n{i}\n \t{line.upper()}", "s") for i in range(6)] + [(None, line, "s"), (7, None, "s"), (8, "", "s"), (9, "é" * 39 + "\n" + "é" * 40, "s"), (10, LONG, "s")]
    out = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(frame(spark, rows)).collect()}
    assert out[5] == (3, 0, rows[5][1]) and out[0] == (3, 2, "0") and out[None] == (1, 1, "")
    assert out[7] == out[8] == (1, 0, "") and out[10] == (1, 0, LONG) and out[9][1] == 0
    assert dedup_lines(frame(spark, rows).where("doc_id > 99")).count() == 0
    twice = frame(spark, [(1, line, "s")] * 5)
    assert [r.n_dropped for r in dedup_lines(twice).collect()] == [0] * 5


def test_lines_of_repeated_ids_beside_others(spark):
    line = "a line that is long enough to be a key of its own"
    two = frame(spark, [(1, line, "s")] * 4 + [(2, line, "s")])
    assert [r.n_dropped for r in dedup_lines(two).collect()] == [0] * 5
    many = frame(spark, [(1, line, "s")] * 4 + [(i, line, "s") for i in range(2, 6)] * 2)
    assert sorted((r.doc_id, r.n_dropped) for r in dedup_lines(many).collect()) == sorted([(1, 1)] * 4 + [(i, int(i < 5)) for i in range(2, 6)] * 2)


@pytest.mark.parametrize("fanout", [2, 3])
def test_runs_hold_a_line_once_whatever_the_batches(spark, fanout):
    rng = np.random.default_rng(fanout)
    lines = [f"line number {i} of those that many documents share" for i in range(30)]
    rows = [(i, "\n".join(lines[j] for j in rng.integers(0, 30, 6)), "s") for i in range(60)]
    out = {r.doc_id: (r.n_dropped, r.kept_text) for r in dedup_lines(frame(spark, rows), n_batches=7, fanout=fanout).collect()}
    holders = {x: [d for d, t, _ in rows if x in t.split("\n")] for x in lines}
    for d, t, _ in rows:
        stay = [x for x in t.split("\n") if len(holders[x]) < 5 or max(holders[x]) == d]
        assert out[d] == (6 - len(stay), "\n".join(stay))


def test_near_components_of_odd_rows(spark):
    base = [f"word{i}" for i in range(200)]
    rows = [*ODD, (20, " ".join(base), "s"), (21, " ".join(base).upper(), "s"), (22, " ".join(base[:195]), "s"), (23, " ".join(["z", *base[::-1]]), "s"), (24, "a  B", "s")]
    df = frame(spark, rows).repartition(3)
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_components(df).collect())
    want = {0: 2, 1: 1, 2: 2, 3: 1, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 20: 20, 21: 20, 22: 20, 23: 23, 24: 1}
    assert [(d, c) for d, _, c, _ in out] == [(d or 0, want[d or 0]) for d in sorted(r[0] or 0 for r in rows)]
    assert all(k == (d == c) for d, _, c, k in out)
    assert sorted(r.doc_id for r in near_dedup(df).collect()) == [1, 2, 5, 6, 7, 9, 20, 23]
    assert near_components(df.where("doc_id > 99")).count() == 0


def test_one_permutation_estimates_similarity():
    rng = np.random.default_rng(2)
    both = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    a, b = np.unique(both[:2700]), np.unique(both[300:])
    agree = (one_permutation(a, 1024) == one_permutation(b, 1024)).mean()
    assert abs(agree - 2400 / 3000) < 0.06
    few = np.unique(both[:3])
    assert set(one_permutation(few, 128).tolist()) <= set(few.tolist())


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 200)]
    out = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(7, 7)], "u long, v long")).collect()}
    assert out == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 300), 100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_urls_of_odd_rows(spark):
    urls = [None, "", "no host", "http://", "HTTP://A.Example.COM", "http://x.org/a\nb?c#d", "ftp://x://y/z", "http://b.net/es/1", "http://net/fr/", "http://www.example.com/en/", "http://h.org/" + "d/" * 500]
    df = spark.createDataFrame([(i, u, None, "k") for i, u in enumerate(urls)], "page_id long, url string, bad boolean, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.com", "", None, "allow") and got[5] == ("x.org", "/a\nb", None, "allow") and got[6] == ("x:", "//y/z", None, "allow")
    assert got[7][2:] == ("net/es/", "block") and got[8][2:] == ("net/fr/", "block") and got[9][2:] == ("www.example.com/en/", "allow")
    assert got[10][3] == "allow" and judge_urls(df.where("page_id > 99")).count() == 0
    bad = spark.createDataFrame([(i, f"http://h.org/{'bad' if i % 2 else 'good'}/{i}", i % 2 == 1) for i in range(200)], "page_id long, url string, bad boolean")
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in judge_urls(bad).collect())


def test_hashes_are_of_the_normalised_text(spark):
    r = exact_groups(frame(spark, [(1, "a\x0b b\r", "s")])).select(F.lower(F.hex("digest")).alias("h")).first()
    assert r.h == hashlib.sha256("a\x0b b\r".translate(dict.fromkeys(map(ord, BLANKS))).encode()).hexdigest()
