"""Phrase extraction: narrow per row, then one aggregate over pairs.

Spans are made, projected and checked inside each row: by an Arrow function for many rows at once, as nested lambdas
cost many times what is done in them. Rows are dealt out once before, as a small file would be one task; the only large shuffle is
the grouping of pairs, combined before it.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, NO_BLANK, detokenise, strip_markers
from ..scratch import spread

PAIR = ["src_phrase", "tgt_phrase"]


def _reach(side: str, of: str, to: str) -> Column:
    """``struct<low, high>``: per position of ``side`` the least and the greatest position it is linked to, null without
    a link. Links are sorted once; the first and the last of each position, and the positions without any, sorted, are
    the index."""
    n = F.size(side)
    links = F.array_sort(F.transform("points", lambda p: F.struct(p[of].alias("at"), p[to].alias("to"))))
    at = lambda x, i: F.get(x, i)["at"]

    def dense(x: Column) -> Column:
        firsts = F.filter(x, lambda p, i: (i == 0) | (at(x, i - 1) != p["at"]))
        lasts = F.filter(x, lambda p, i: (i == F.size(x) - 1) | (at(x, i + 1) != p["at"]))
        held = F.zip_with(firsts, lasts, lambda a, b: F.struct(a["at"].alias("at"), a["to"].alias("low"), b["to"].alias("high")))
        none = F.lit(None).cast("int")
        free = F.array_except(F.sequence(F.lit(0), n - 1), F.transform(x, lambda p: p["at"]))
        return F.array_sort(F.concat(held, F.transform(free, lambda i: F.struct(i.alias("at"), none.alias("low"), none.alias("high")))))

    # The outer transform binds the links, and their index: they would be sorted again for each position otherwise.
    index = F.when(n > 0, F.get(F.transform(F.array(links), dense), F.lit(0)))
    ends = lambda x: F.struct(F.transform(x, lambda p: p["low"]).alias("low"), F.transform(x, lambda p: p["high"]).alias("high"))
    return F.get(F.transform(F.array(index), ends), F.lit(0))


def indexed(df: DataFrame) -> DataFrame:
    """``df (src, tgt, points)`` with the reach of each position: ``t_low, t_high, s_low, s_high``."""
    out = df.withColumns({"_t": _reach("src", "s", "t"), "_s": _reach("tgt", "t", "s")})
    return out.withColumns({f"{to}_{end}": F.col(f"_{to}.{end}") for to in "ts" for end in ("low", "high")}).drop("_t", "_s")


def spans_of(side: str | Column, min_len: int, max_len: int) -> Column:
    """``array<struct<a0, a1>>`` of all spans (inclusive) of a side."""
    n = F.size(side)
    starts = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), lambda a: F.struct(a.alias("a0"), (a + k - 1).alias("a1"))))
    return F.flatten(F.filter(F.transform(F.sequence(F.lit(min_len), F.lit(max_len)), starts), lambda x: x.isNotNull()))


def within(reach: str | Column, lo: Column, hi: Column) -> Column:
    return F.slice(F.col(reach) if isinstance(reach, str) else reach, lo + 1, hi - lo + 1)


def project_spans(df: DataFrame, min_len: int = 1, max_len: int = 3) -> DataFrame:
    """Source spans ``s0..s1`` (inclusive) with the outermost target links ``t0..t1``. Each row's links
    are indexed by position once, before its spans are made."""
    spans = indexed(df).drop("points").withColumn("span", F.explode(spans_of("src", min_len, max_len)))
    spans = spans.withColumns({"s0": F.col("span.a0"), "s1": F.col("span.a1")})
    reach = {"t0": F.array_min(within("t_low", F.col("s0"), F.col("s1"))), "t1": F.array_max(within("t_high", F.col("s0"), F.col("s1")))}
    return spans.withColumns(reach).drop("span", "t_low", "t_high").where("t0 is not null")


def consistent() -> Column:
    """The target span's links lead back to exactly the source span."""
    t0, t1 = F.col("t0"), F.col("t1")
    return (F.array_min(within("s_low", t0, t1)) == F.col("s0")) & (F.array_max(within("s_high", t0, t1)) == F.col("s1"))


def phrase_text(arr: str | Column, start: str | Column, end: str | Column) -> Column:
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return strip_markers(F.array_join(within(arr, start, end), " "))


def valid_phrase(col: Column, rule: str = "edge") -> Column:
    """``edge``: neither end is ASCII punctuation. ``not_only``: something else than punctuation."""
    if rule == "edge":
        return col.rlike(r"^[^\p{Punct}](.*[^\p{Punct}])?$")
    return col.rlike(r"[^\p{Punct}\s]")


def _stripped(col: Column) -> Column:
    """:func:`strip_markers` where there may be something to strip: a marker at an end, or before a last line break."""
    ends = [f(F.lit(marker)) for marker in (NO_BLANK, BLANK) for f in (col.startswith, col.endswith)]
    return F.when(functools.reduce(operator.or_, ends) | F.right(col, F.lit(1)).isin(*"\n\r\x85\u2028\u2029"), strip_markers(col)).otherwise(col)


class _Side:
    """A side of a batch of rows, flat: its words, and the least and the greatest position on the other side that each position is
    linked to. Positions that only links have, behind a row's last word, hold no word."""

    def __init__(self, words: pa.ListArray, row: np.ndarray, at: np.ndarray, to: np.ndarray):
        self.n = np.asarray(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False), np.int64)
        self.words, self.word_from = words.flatten().to_pylist(), np.cumsum(self.n) - self.n
        size = self.n.copy()
        np.maximum.at(size, row, at + 1)
        self.begin = np.cumsum(size) - size
        self.low, self.high = np.full(int(size.sum()), _NOWHERE), np.full(int(size.sum()), -1)
        np.minimum.at(self.low, self.begin[row] + at, to)
        np.maximum.at(self.high, self.begin[row] + at, to)

    def text(self, row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[str]:
        begin = self.word_from[row]
        ends = zip((begin + np.minimum(lo, self.n[row])).tolist(), (begin + np.minimum(hi + 1, self.n[row])).tolist(), strict=True)
        return [" ".join([w for w in self.words[a:b] if w is not None]) for a, b in ends]


_NOWHERE = 1 << 40


def _outermost(low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least of ``low`` and the greatest of ``high`` from each ``lo`` to its ``hi``: of two runs of a power of two that cover them."""
    least, most = np.empty(len(lo), np.int64), np.empty(len(lo), np.int64)
    level, width = np.frexp((hi - lo + 1).astype(float))[1] - 1, 1
    for k in range(int(level.max(initial=-1)) + 1):
        mine = np.flatnonzero(level == k)
        a, b = lo[mine], hi[mine] - width + 1
        least[mine], most[mine] = np.minimum(low[a], low[b]), np.maximum(high[a], high[b])
        low, high = np.minimum(low[:-width], low[width:]), np.maximum(high[:-width], high[width:])
        width *= 2
    return least, most


def _spans(side: _Side, other: _Side, min_len: int, max_len: int) -> tuple[np.ndarray, ...]:
    """``row, a0, b0, b1, a1, both`` of the spans ``a0..a1`` of a side with links: the outermost of these on the other, and whether they
    lead back to exactly the span."""
    row_of = np.repeat(np.arange(len(side.n)), side.n)
    a = np.arange(len(row_of)) - side.word_from[row_of]
    at, found = side.begin[row_of] + a, []
    low, high = side.low[at], side.high[at]
    for k in range(1, max_len + 1):
        if k > 1:
            # Spans that go on in their row take the next position.
            on = a + k <= side.n[row_of]
            row_of, a, at = row_of[on], a[on], at[on]
            low, high = np.minimum(low[on], side.low[at + k - 1]), np.maximum(high[on], side.high[at + k - 1])
        if k >= min_len:
            held = high >= 0
            found.append((row_of[held], a[held], low[held], high[held], a[held] + k - 1))
    row, a0, b0, b1, a1 = (np.concatenate(x) for x in zip(*found, strict=True))
    least, most = _outermost(other.low, other.high, other.begin[row] + b0, other.begin[row] + b1)
    return row, a0, b0, b1, a1, (least == a0) & (most == a1)


#: Rows that a task looks at together.
TOGETHER = 1024


def _found(min_len: int, max_len: int, consistent_only: bool, by_row: bool):
    """Spans of both passes with their texts on both sides: a row each, or all of a row as one array."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = batch.column("points")
        links, row = points.flatten(), np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False))
        s, t = (np.asarray(pc.fill_null(links.field(c), -1).to_numpy(zero_copy_only=False), np.int64) for c in "st")
        ok = (s >= 0) & (t >= 0)
        row, s, t = row[ok], s[ok], t[ok]
        src, tgt = _Side(batch.column("src"), row, s, t), _Side(batch.column("tgt"), row, t, s)
        parts = []
        for back in (False, True):
            row, a0, b0, b1, a1, both = _spans(*((tgt, src) if back else (src, tgt)), min_len, max_len)
            keep = both if consistent_only else np.ones(len(row), bool)
            row, a0, b0, b1, a1, both = (x[keep] for x in (row, a0, b0, b1, a1, both))
            (s0, s1), (t0, t1) = ((b0, b1), (a0, a1)) if back else ((a0, a1), (b0, b1))
            parts.append((row, s0, s1, t0, t1, np.full(len(row), back), both))
        row, s0, s1, t0, t1, back, both = (np.concatenate(x) for x in zip(*parts, strict=True))
        if by_row:
            order = np.argsort(row, kind="stable")
            row, s0, s1, t0, t1 = (x[order] for x in (row, s0, s1, t0, t1))
        pair = [pa.array(src.text(row, s0, s1), pa.string()), pa.array(tgt.text(row, t0, t1), pa.string())]
        if by_row:
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1))
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(pair, PAIR))], ["pairs"])
        rest = [pa.array(back), pa.array(both), pa.array(s0, pa.int32()), pa.array(t0, pa.int32())]
        return pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(row)), *pair, *rest], ["row_id", *PAIR, "back", "both", "s_start", "t_start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                yield of(batch.slice(a, TOGETHER))

    return run


_KEEP = ["row_id", *PAIR, "direction", "s_start", "t_start"]


def _emitted(df: DataFrame, min_len: int, max_len: int, rule: str, ahead, back, consistent_only: bool) -> DataFrame:
    """Both passes over the rows, from one index of their links. ``ahead`` and ``back`` give the direction of a phrase of their
    pass, null for one that is not emitted."""
    rows = spread(df.select("row_id", "src", "tgt", "points"), "row_id")
    schema = f"row_id {dict(rows.dtypes)['row_id']}, src_phrase string, tgt_phrase string, back boolean, both boolean, s_start int, t_start int"
    found = rows.mapInArrow(_found(min_len, max_len, consistent_only, False), schema)
    direction = F.when(F.col("back"), back(F.col("both"))).otherwise(ahead(F.col("both")))
    found = found.withColumns({**{c: _stripped(F.col(c)) for c in PAIR}, "direction": direction})
    return found.where(F.col("direction").isNotNull() & valid_phrase(F.col("src_phrase"), rule) & valid_phrase(F.col("tgt_phrase"), rule)).select(_KEEP)


def row_phrases(df: DataFrame, min_len: int = 1, max_len: int = 3, rule: str = "edge") -> DataFrame:
    """``src_phrase, tgt_phrase``: the consistent pairs of both passes, once a row."""
    rows = spread(df.select("row_id", "src", "tgt", "points"), "row_id")
    found = rows.mapInArrow(_found(min_len, max_len, True, True), "pairs array<struct<src_phrase:string,tgt_phrase:string>>")
    stripped = F.transform("pairs", lambda x: F.struct(*[_stripped(x[c]).alias(c) for c in PAIR]))
    valid = F.filter(stripped, lambda x: valid_phrase(x["src_phrase"], rule) & valid_phrase(x["tgt_phrase"], rule))
    return found.select(F.explode(F.array_distinct(valid)).alias("p")).select("p.*")


def extract_phrases(df: DataFrame, min_len: int = 1, max_len: int = 3, rule: str = "edge") -> DataFrame:
    """Consistent pairs of both passes: ``row_id, src_phrase, tgt_phrase, direction, s_start, t_start``;
    direction 0 in the forward pass, -1 in the reverse pass."""
    return _emitted(df, min_len, max_len, rule, lambda both: F.when(both, 0), lambda both: F.when(both, -1), True)


def extract_directed(df: DataFrame, min_len: int = 1, max_len: int = 3, rule: str = "not_only") -> DataFrame:
    """Inconsistent spans too: forward ones get direction 1, reverse ones -1, consistent ones 0 once."""
    return _emitted(df, min_len, max_len, rule, lambda both: F.when(both, 0).otherwise(1), lambda both: F.when(~both, -1), False)


def drop_ignored(occ: DataFrame, hidden: DataFrame) -> DataFrame:
    """Without pairs that are in ``hidden`` exactly or in lower case."""
    exact = hidden.select(*PAIR).distinct()
    lower = hidden.select(F.lower("src_phrase").alias("_s"), F.lower("tgt_phrase").alias("_t")).distinct()
    kept = occ.join(exact, PAIR, "left_anti")
    return kept.join(lower, (F.lower(kept["src_phrase"]) == lower["_s"]) & (F.lower(kept["tgt_phrase"]) == lower["_t"]), "left_anti")


def score_gate(df: DataFrame, threshold: float) -> DataFrame:
    """Rows up to the threshold are extracted."""
    return df.where(F.col("score") <= threshold)


def only_below(occ: DataFrame, threshold: float) -> DataFrame:
    """Pairs that occur only in rows below the threshold (``occ`` carries the row's score)."""
    high = occ.where(F.col("score") >= threshold).select(*PAIR).distinct()
    return occ.where(F.col("score") < threshold).join(high, PAIR, "left_anti")


def block_low(occ: DataFrame, threshold: float) -> DataFrame:
    """Pairs seen in rows below the threshold are not taken from the other rows."""
    low = occ.where(F.col("score") < threshold).select(*PAIR).distinct()
    return occ.where(F.col("score") >= threshold).join(low, PAIR, "left_anti")


def phrase_counts(occ: DataFrame) -> DataFrame:
    """Per pair: ``direction`` (0 if the forward pass saw it, else -1), ``num_occurrences`` (rows) and
    ``num_emissions``. Rows are counted in two steps, so no pair gathers its rows in memory."""
    by_row = occ.groupBy(*PAIR, "row_id").agg(F.max("direction").alias("direction"), F.count(F.lit(1)).alias("k"))
    return by_row.groupBy(*PAIR).agg(
        F.max("direction").alias("direction"), F.count(F.lit(1)).alias("num_occurrences"), F.sum("k").alias("num_emissions")
    )


def count_filter(counts: DataFrame, min_occ: int = 2, max_occ: int = 300) -> DataFrame:
    return counts.where(F.col("num_occurrences").between(min_occ, max_occ))


def cap_phrases(counts: DataFrame, max_phrases: int = 500_000) -> DataFrame:
    """Drop whole count classes from the lowest up until at most ``max_phrases`` are left. The
    threshold comes from the histogram of counts, one row a class."""
    classes = counts.groupBy("num_occurrences").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(F.desc("num_occurrences")).rowsBetween(Window.unboundedPreceding, 0))
    kept = classes.withColumn("upto", upto).where(F.col("upto") <= max_phrases).agg(F.min("num_occurrences").alias("least"))
    return counts.crossJoin(F.broadcast(kept)).where(F.col("num_occurrences") >= F.col("least")).drop("least")


def top_phrases(counts: DataFrame, n: int = 100_000) -> DataFrame:
    return counts.orderBy(F.desc("num_occurrences"), *PAIR).limit(n)


def common_rows(ahead: DataFrame, back: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that both directions give for a pair, and what is left of each direction."""
    key = [*PAIR, "row_id"]
    a, b = ahead.select(key).distinct(), back.select(key).distinct()
    return a.join(b, key), a.join(b, key, "left_anti"), b.join(a, key, "left_anti")


def extraction_stats(occ: DataFrame) -> DataFrame:
    counts = phrase_counts(occ)
    return counts.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(F.col("direction") == 0).alias("both_directions"),
        F.sum("num_occurrences").alias("occurrences"),
        F.max("num_occurrences").alias("most"),
        F.count_if(F.col("num_occurrences") == 1).alias("once"),
    )


def occurrences_of(occ: DataFrame, bitext: DataFrame, src: str, tgt: str, limit: int = 1000, offset: int = 0) -> DataFrame:
    """A page of the rows of a pair, with the pair's total."""
    rows = occ.where((F.col("src_phrase") == src) & (F.col("tgt_phrase") == tgt)).select("row_id").distinct()
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy("row_id").offset(offset).limit(limit)
    return page.join(bitext, "row_id").crossJoin(F.broadcast(total))


def phrases_of_rows(occ: DataFrame, counts: DataFrame) -> DataFrame:
    """The phrases of each row with their counts; for one row, filter ``occ`` by its id first."""
    return occ.select("row_id", *PAIR).distinct().join(counts, PAIR)


def list_phrases(counts: DataFrame, symmetric: bool = False) -> DataFrame:
    """All phrases, detokenised, most frequent first."""
    rows = counts.where("direction = 0") if symmetric else counts
    return rows.withColumns({c: detokenise(F.col(c)) for c in PAIR}).orderBy(F.desc("num_occurrences"), *PAIR)
