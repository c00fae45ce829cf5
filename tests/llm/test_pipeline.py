from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from duotext.llm.common import BLANKS
from duotext.llm.quality import quality_scores
from duotext.scratch import written


def slow_near_kept(rows):
    """Brute force over all pairs of sets."""
    sets = {}
    for r in rows:
        w = r.text.encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holders = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            holders[x].add(d)
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, s in sets.items():
        for e in {e for x in s for e in holders[x] if e < d}:
            common = len(s & sets[e])
            if 100 * common >= 75 * (len(s) + len(sets[e]) - common):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d for d in sets if find(d) == d}


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]

    good = written(stages["quality"](spark, docs, d), "t")
    kept = {r.doc_id for r in quality_scores(docs).where("kept").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept

    exact = written(stages["exact_dedup"](spark, good, d), "t")
    groups = defaultdict(list)
    for r in good.collect():
        groups[r.text.translate(dict.fromkeys(map(ord, BLANKS)))].append((-len(r.text), r.doc_id))
    assert sorted(r.doc_id for r in exact.collect()) == sorted(min(g)[1] for g in groups.values())

    near = written(stages["near_dedup"](spark, exact, d), "t")
    assert {r.doc_id for r in near.collect()} == slow_near_kept(exact.collect())

    mixed = written(stages["mixing"](spark, near, d), "t")
    size = lambda t: len(t.encode().split())
    by = {r.doc_id: r for r in near.collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(copies) <= set(by) and max(copies.values()) <= 2
    taken = sum(n * size(by[i].text) for i, n in copies.items())
    total = sum(size(r.text) for r in by.values())
    assert abs(taken - 1.5 * total) < 0.1 * total

    pieces = stages["packing"](spark, mixed, d).collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == copies


def test_stages_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, "w " * 200, "en", "a", 9), (2, "w " * 200, "en", "a", 9), (3, "x" * 100000, None, "a", 1)]
    words = " ".join(f"word{i} of{i % 7}" for i in range(300))
    rows += [(10, words, "en", "a", 1), (10, words, "en", "a", 1), (11, words + " ", "en", None, 1), (12, words + " more", "en", "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for odd in (df, df.where("doc_id > 99"), df.withColumn("kept", df.doc_id).withColumn("digest", df.text)):
            out = stage(spark, odd, "")
            n = out.count()
            if name != "packing":
                assert out.columns == odd.columns
            if name == "exact_dedup" and odd is df:
                assert sorted(r.doc_id or 0 for r in out.collect()) == [1, 2, 3, 11, 12]
            if name == "near_dedup" and odd is df:
                assert 10 in [r.doc_id for r in out.collect()] and n < len(rows)
