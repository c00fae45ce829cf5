from __future__ import annotations

import math
import re
import statistics
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from duotext.llm import quality
from duotext.llm.quality import BITS, kneser_ney, quality_filter, quality_scores, stretches, trigram_codes, word_stats


def slow_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def slow_kneser_ney(counts):
    """Dictionary version of the model: counts by (a, b, c) to log-probabilities."""
    levels = [Counter(counts), Counter(), Counter()]
    for a, b, c in counts:
        levels[1][b, c] += 1
    for b, c in levels[1]:
        levels[2][(c,)] += 1

    def cut(level):
        n = [sum(1 for v in level.values() if v == k) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) if n[k] and n[k + 1] else 0.5 for k in (1, 2, 3)]

    cuts = [cut(x) for x in levels]
    below = [defaultdict(list) for _ in levels]
    for i, level in enumerate(levels):
        for g, v in level.items():
            below[i][g[:-1]].append(v)

    def p(i, gram):
        if i == 3:
            return 1 / len(levels[2])
        after = below[i].get(gram[:-1])
        lower = p(i + 1, gram[1:])
        if not after:
            return lower
        v = levels[i].get(gram, 0)
        return (v - cuts[i][min(v, 3)]) / sum(after) + sum(cuts[i][min(x, 3)] for x in after) / sum(after) * lower

    return lambda gram: math.log(p(0, gram))


def test_model_equals_the_dictionary_version(spark):
    rng = np.random.default_rng(3)
    seen = {m: Counter(tuple(map(int, rng.zipf(1.6, 3) % 50000)) for _ in range(2000)) for m in ("+en", "=none")}
    rows = [(m, (a << 2 * BITS) | (b << BITS) | c, n) for m, counts in seen.items() for (a, b, c), n in counts.items()]
    got = {(r.model, r.code): r.p for r in kneser_ney(spark.createDataFrame(rows, "model string, code long, n long")).collect()}
    assert len(got) == len(rows)
    for m, counts in seen.items():
        slow = slow_kneser_ney(counts)
        for a, b, c in counts:
            assert math.log(got[m, (a << 2 * BITS) | (b << BITS) | c]) == pytest.approx(slow((a, b, c)), abs=1e-9)


def test_stats_equal_brute_force(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    for text in [*[r.text for r in rows], "", " \n\n a\x0bb\fc ", "a a a a", "x\nx\n \n \nx y", "é# b"]:
        assert word_stats(text) == slow_stats(text)


def test_query_follows_counts_and_bands(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    got = {r.doc_id: r for r in quality.query_quality(spark, sf_small).collect()}
    assert set(got) == {r.doc_id for r in docs}
    slow = {}
    for lang in {r.lang for r in docs}:
        slow[lang] = slow_kneser_ney(Counter(g for r in docs if r.lang == lang for g in trigrams(r.text or "")))
    cached = {}
    for r in docs:
        g, n = got[r.doc_id], slow_stats(r.text or "")
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == n
        assert g.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        values = []
        for gram in trigrams(r.text or ""):
            if (r.lang, gram) not in cached:
                cached[r.lang, gram] = -slow[r.lang](gram)
            values.append(cached[r.lang, gram])
        if not values:
            continue
        k = max(1, round(len(values) / 64))
        parts = [values[i * len(values) // k : (i + 1) * len(values) // k] for i in range(k)]
        score = statistics.median(sum(p) / len(p) for p in parts)
        assert g.score == pytest.approx(score, abs=1e-6)
        assert g.word_score == pytest.approx(math.log(score * (n[1] + max(n[0], 1)) / max(n[0], 1)), abs=1e-6)
        inside = g.lower <= g.score <= g.upper and g.word_lower <= g.word_score <= g.word_upper
        assert g.kept == (not g.base_failed and inside)


def trigrams(text):
    points = [0, 0, *(ord(c) + 1 for c in text)]
    return [tuple(points[i : i + 3]) for i in range(len(text))]


def test_codes_hold_three_code_points():
    assert trigram_codes("a\U0010ffff").tolist() == [98, (98 << BITS) | 0x110000]
    assert stretches(1).tolist() == [0] and stretches(129).tolist() == [0, 64] and stretches(0).tolist() == [0]


def test_models_too_large_to_ship_give_the_same_scores(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/documents.parquet").where("doc_id < 40")
    rows = rows.unionByName(rows.where("doc_id < 3")).unionByName(rows.where("doc_id = 5").selectExpr("*").replace("en", "xx", ["lang"]))
    shipped, joined = (sorted(quality_scores(rows, most_shipped=n).select("doc_id", "score", "kept").collect(), key=str) for n in (1 << 20, 0))
    assert [(a.doc_id, a.kept) for a in shipped] == [(b.doc_id, b.kept) for b in joined]
    assert [a.score for a in shipped] == pytest.approx([b.score for b in joined], abs=1e-9)


def test_junk_goes_and_clean_text_stays(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.query_quality(spark, d).join(labels, "doc_id").where("not base_failed").collect()
    clean, junk = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(not r.kept for r in junk) >= 0.8 * len(junk)


def test_nulls_empty_tables_and_clashing_columns(spark):
    rows = [(1, None, None, True), (2, "", "en", True), (None, "a " * 60, None, True), (4, "b", "xx", False), (4, "b", "xx", False), (5, "w" * 100000, "en", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean")
    out = quality_scores(df).collect()
    assert len(out) == 6 and not any(r.kept for r in out)
    assert quality_filter(df).count() == 0
    assert quality_scores(df.where("doc_id < 0")).count() == 0
    assert quality_filter(df.where("doc_id < 0")).columns == df.columns


def test_counting_many_short_texts_is_linear():
    import time

    texts = [f"text {i:035d}" for i in range(100_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["+en"] * len(texts)), pa.array(texts)], ["model", "text"])
    began = time.time()
    got = sum(pa.compute.sum(b.column(2)).as_py() for b in quality._count(iter([batch])))
    assert got == sum(map(len, texts)) and time.time() - began < 20
