"""Operators against small hand-written models and invariants."""

from __future__ import annotations

import math
import random
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from duotext.functions import points as P
from duotext.functions import text as T
from duotext.functions.mathx import digamma
from duotext.operators import em
from duotext.operators import fixes as fx
from duotext.operators import phrases as ph
from duotext.operators.prep import cap_rows, filter_bitext, vocab

PTS = P.POINTS


def slow_grow(a, b, final=None):
    union = sorted(set(a) | set(b))
    got = sorted(set(a) & set(b))
    while True:
        n = len(got)
        for x in union:
            near = any(abs(q[0] - x[0]) <= 1 and abs(q[1] - x[1]) <= 1 for q in got)
            row, col = any(q[0] == x[0] for q in got), any(q[1] == x[1] for q in got)
            if x not in got and near and not (row and col):
                got.append(x)
        if len(got) == n:
            break
    for side in (a, b) if final else ():
        for x in sorted(side):
            row, col = any(q[0] == x[0] for q in got), any(q[1] == x[1] for q in got)
            if x not in got and not ((row and col) if final == "or" else (row or col)):
                got.append(x)
    return sorted(got)


def test_symmetrisation_against_a_model(spark):
    rng = random.Random(4)
    side = lambda: sorted({(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(9))})
    rows = [(i, side(), side()) for i in range(150)] + [(150, [], []), (151, [(0, 0)], []), (152, [(0, 0), (1, 1), (2, 2)], [(0, 0)])]
    df = spark.createDataFrame(rows, f"row_id long, a {PTS}, b {PTS}")
    out = df.select("row_id", *[f(F.col("a"), F.col("b")).alias(n.replace("-", "_")) for n, f in P.SYMMETRISE.items()]).collect()
    for r, (_, a, b) in zip(sorted(out, key=lambda r: r.row_id), rows, strict=True):
        as_set = lambda c: [tuple(x) for x in c]
        assert as_set(r.grow_diag) == slow_grow(a, b)
        assert as_set(r.grow_diag_final) == slow_grow(a, b, "or")
        assert as_set(r.grow_diag_final_and) == slow_grow(a, b, "and")
        assert set(as_set(r.intersect)) <= set(as_set(r.grow_diag)) <= set(as_set(r.grow_diag_final_and)) <= set(as_set(r.union))


def slow_em(rows, steps):
    p = defaultdict(lambda: 1.0)
    for _ in range(steps):
        c, total = defaultdict(float), defaultdict(float)
        for src, tgt in rows:
            for f in tgt:
                z = sum(p[e, f] for e in ["<eps>", *src])
                for e in ["<eps>", *src]:
                    c[e, f] += p[e, f] / z
                    total[e] += p[e, f] / z
        p = defaultdict(float, {(e, f): v / total[e] for (e, f), v in c.items()})
    return p


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(8)
    words = ["a", "b", "c", "d", "e"]
    rows = [(i, src := [rng.choice(words) for _ in range(rng.randrange(1, 6))], [w.upper() for w in src]) for i in range(40)]
    return rows, spark.createDataFrame([*rows, (99, [], ["A"]), (98, ["a"], [])], "row_id long, src array<string>, tgt array<string>")


def test_em_and_viterbi_against_a_model(small):
    rows, df = small
    table = em.train_ttable(df, iterations=4)
    want = slow_em([(s, t) for _, s, t in rows], 3)
    got = {(r.e, r.f): r.p for r in table.collect()}
    assert got == pytest.approx(dict(want), abs=1e-12)
    by_e = defaultdict(float)
    for (e, _), p in got.items():
        by_e[e] += p
    assert all(abs(v - 1) < 1e-9 for v in by_e.values())
    links = {r.row_id: [tuple(x) for x in r.points] for r in em.viterbi(df, table).collect()}
    assert links[98] == links[99] == []
    for i, s, t in rows:
        best = []
        for j, f in enumerate(t):
            k = min(range(len(s) + 1), key=lambda k: (-round(want[(["<eps>", *s])[k], f], 12), k))
            best += [(k - 1, j)] if k else []
        assert links[i] == sorted(best)


def test_likelihood_never_falls(small):
    _, df = small
    pairs = em.cooccurrences(df)
    ll = [em.em_metrics(pairs, df, em.train_ttable(df, iterations=k)).first().log_likelihood for k in (2, 3, 4)]
    assert ll[0] <= ll[1] <= ll[2]


def test_alignment_of_both_directions_is_mostly_diagonal(small):
    _, df = small
    out = em.align_bitext(df.where("size(src) > 0 and size(tgt) > 0"))
    ref = df.withColumn("points", F.transform(F.sequence(F.lit(0), F.size("src") - 1), lambda i: P.point(i, i))).where("size(src) > 0 and size(tgt) > 0")
    assert em.alignment_fmeasure(out, ref).first().precision > 0.6


def test_digamma(spark):
    got = [r.d for r in spark.createDataFrame([(1.0,), (0.01,), (7.5,), (100.0,)], "x double").select(digamma(F.col("x")).alias("d")).collect()]
    assert got == pytest.approx([-0.5772156649, -100.5608854579, 1.9467575, 4.6001618527], abs=1e-6)


def slow_balance(xs, ys):
    if not xs or not ys:
        return []
    long, short = (ys, xs) if len(xs) < len(ys) else (xs, ys)
    size, more = divmod(len(long), len(short))
    of = [i for i in range(len(short)) for _ in range(size + (i < more))]
    return [(short[g], v) if len(xs) < len(ys) else (v, short[g]) for g, v in zip(of, long, strict=True)]


def test_repair_against_a_model(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        pts = sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(rng.randrange(10))})
        rows.append((i, pts, rng.randrange(5), rng.randrange(1, 4), rng.randrange(0, 5)))
    df = spark.createDataFrame(rows, f"i long, p {PTS}, start int, old int, new int")
    args = (F.col("p"), F.col("start"), F.col("old"), F.col("new"))
    out = df.select("i", P.repair_points(*args, "s").alias("s"), P.repair_points(*args, "t").alias("t")).collect()
    for r, (_, pts, start, old, new) in zip(sorted(out, key=lambda r: r.i), rows, strict=True):
        for side, got in ((0, r.s), (1, r.t)):
            want = list(pts)
            if new != old:
                shift = lambda x: tuple(v + new - old if k == side else v for k, v in enumerate(x))  # noqa: E731, B023
                inside = [x[1 - side] for x in pts if start <= x[side] < start + old]
                fresh = list(range(start, start + new))
                dealt = slow_balance(fresh, inside) if side == 0 else slow_balance(inside, fresh)
                want = [x for x in pts if x[side] < start] + [shift(x) for x in pts if x[side] >= start + old] + dealt
            assert sorted(map(tuple, got)) == sorted(want)


def test_tokenise_round_trip_and_edges(spark):
    cases = ["Hello, world!", "a..b", "(a) b", "a ( b", "x -- y", "'tis", "...", "é", "« a »", "don't (stop) now: 1/2"]
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    for r in df.select("x", T.detokenise(T.tokenise(F.col("x"))).alias("y"), T.tokenise(F.col("x")).alias("t")).collect():
        assert r.y == r.x
    first = df.where("x = 'Hello, world!'").select(T.tokenise(F.col("x")).alias("t")).first().t
    assert first == "Hello #NB , world #NB !"
    odd = spark.createDataFrame([("",), ("  ",), ("\t",), (None,)], "x string").select(T.tokens(T.tokenise(F.col("x"))).alias("t")).collect()
    assert [r.t for r in odd] == [[], [], [], None]


def test_filter_limits_and_vocab(spark):
    rows = [(0, "", "x"), (1, "a" * 2000, "x"), (2, "a" * 2001, "x"), (3, "a " * 511 + "a", "x"), (4, "a " * 512 + "a", "x"), (5, " a ", "b")]
    df = spark.createDataFrame(rows, "row_id long, src_raw string, tgt_raw string")
    assert sorted(r.row_id for r in filter_bitext(df).collect()) == [1, 3, 5]
    assert [r.row_id for r in cap_rows(df, 2).collect()] == [0, 1]
    v = vocab(spark.createDataFrame([(["b", "a"], ["c", "ba"])], "src array<string>, tgt array<string>")).collect()
    assert {r.word: r.id for r in v} == {"a": 0, "b": 1, "ba": 2, "c": 3}


def test_fixes_change_matched_rows_only(spark):
    pts = [(0, 0), (1, 1), (2, 2)]
    rows = [(0, 1, ["the", "red", "car"], ["il", "rosso", "auto"], pts, 0.5, False), (0, 2, ["a", "car", "car"], ["un", "auto", "auto"], pts, 0.5, False)]
    bt = spark.createDataFrame(rows, f"project_id long, row_id long, src array<string>, tgt array<string>, points {PTS}, score double, deleted boolean")
    occ = ph.extract_phrases(bt).withColumn("project_id", F.lit(0).cast("long"))
    fixes = spark.createDataFrame(
        [(1, 0, "car", "car", "auto", "bella auto", 0, 100, "fix"), (2, 0, "car", "van", "auto", "", 0, 100, "augment"), (3, 0, "nosuch", "x", "auto", "y", 0, 100, "fix")],
        "id long, project_id long, src_phrase string, src_fix string, tgt_phrase string, tgt_fix string, direction int, percentage int, type string",
    )
    out = {r.row_id: r for r in fx.apply_changes(bt, occ, fixes).collect()}
    assert sorted(out) == [1, 2, 3, 4]
    assert out[1].tgt == ["il", "rosso", "bella", "auto"] and [tuple(p) for p in out[1].points] == [(0, 0), (1, 1), (2, 2), (2, 3)]
    assert out[2].tgt == ["un", "bella", "auto", "bella", "auto"]
    assert out[3].src == ["the", "red", "van"] and out[4].src == ["a", "car", "van"] and out[3].score == 0.0


def test_fixes_are_typed_as_text_and_the_project_follows(spark):
    # A fix typed with an apostrophe meets the tokens of the corpus, and what it writes is tokens again.
    src, tgt = ["l", "#NB", "'", "#NB", "amico", "va"], ["the", "friend", "goes"]
    pts = [(0, 0), (2, 0), (4, 1), (5, 2)]
    bt = spark.createDataFrame([(0, 1, src, tgt, pts, 0.5, False), (0, 2, ["va"], ["goes"], [(0, 0)], 0.5, False)], f"project_id long, row_id long, src array<string>, tgt array<string>, points {PTS}, score double, deleted boolean")
    occ = ph.extract_phrases(bt, max_len=5).withColumn("project_id", F.lit(0).cast("long"))
    phrases = ph.phrase_counts(occ).select(F.lit(0).cast("long").alias("project_id"), *ph.PAIR, "direction", "num_occurrences", (F.col("src_phrase") == "va").alias("ignore"))
    fixes = spark.createDataFrame(
        [(1, 0, "l'amico", "l'amica, poi", "the friend", "the friend", 0, 100, "fix")],
        "id long, project_id long, src_phrase string, src_fix string, tgt_phrase string, tgt_fix string, direction int, percentage int, type string",
    )
    assert [r.row_id for r in fx.match_fix(bt, occ, fixes).collect()] == [1]
    after = fx.apply_project(bt, occ, phrases, fixes, fixes.limit(0), max_len=5)
    rows = {r.row_id: r for r in after.bitext.collect()}
    assert rows[1].src == ["l", "#NB", "'", "#NB", "amica", "#NB", ",", "poi", "va"] and rows[2].src == ["va"]
    got = {(r.src_phrase, r.tgt_phrase): (r.num_occurrences, r.ignore) for r in after.phrases.collect()}
    assert got["va", "goes"] == (2, True) and not any("amico" in s for s, _ in got)
    want = {(r.src_phrase, r.tgt_phrase) for r in ph.extract_phrases(after.bitext, max_len=5).collect()}
    assert set(got) == want
    assert [r.src_fix for r in fx.list_fixes(after.history, 0).collect()] == ["l'amica, poi"]
    assert [tuple(r) for r in fx.count_fixes(after.history).collect()] == [(0, 1)]


def test_query_tokens_against_a_stack(spark):
    texts = ["a  b", "a, b", "l'amico", " x", "x ", "..", ". .", "a .  b", "  ", "", "ﬁn", "e\u0301", "l #NB ' #NB amico", "€5", "a,  ,b"]
    wide = ["'", "!", ",", ".", "€", "?"]

    def model(t):
        if not t.strip():
            return ""
        t = unicodedata.normalize("NFKC", t)
        for s in wide:
            t = t.replace(s, f" #NB {s} #NB ")
        out = []
        for x in t.split(" "):
            x = x if x.strip() else "#BLANK"
            if out and {out[-1], x} == {"#NB", "#BLANK"}:
                out.pop()
            else:
                out.append(x)
        return " ".join(out)

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.tokenise_query(F.col("t")).alias("q")).collect()
    assert {r.i: r.q for r in got} == {i: model(t) for i, t in enumerate(texts)}
    assert spark.createDataFrame([("Perche\u0301 ",)], "t string").select(T.norm_token(F.col("t"))).first()[0] == "perch\u00e9"


def test_merge_pending_and_history(spark):
    rows = [(1, "a", "x", "t", "y", 0), (2, "a", "z", "t", "y", 0), (3, "", "", "", "", 0)]
    f = spark.createDataFrame(rows, "id long, src_phrase string, src_fix string, tgt_phrase string, tgt_fix string, direction int")
    assert sorted(r.id for r in fx.merge_pending(f).collect()) == [2, 3]
    assert fx.save_fixes(f.where("id = 1"), f.where("id > 1")).count() == 2


def test_entropy_bounds(spark, sf_small):
    import __spark_entry__

    for r in __spark_entry__.queries()["tab2_phrase_table_all"](spark, sf_small).collect():
        assert 0 <= r.entropy <= math.log(r.num_tgts) + 1e-6 and 0 < r.top_share <= 1
