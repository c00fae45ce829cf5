"""Alignment points ``array<struct<s int, t int>>`` as column expressions."""

from __future__ import annotations

import heapq
import itertools

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<s:int,t:int>>"


def none() -> Column:
    return F.array().cast(POINTS)


def point(s: Column, t: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), t.cast("int").alias("t"))


def parse_points(col: Column) -> Column:
    """Read ``0-0 1-2``; text before a last ``|||`` is skipped, malformed pairs are dropped."""
    pairs = F.filter(F.split(F.element_at(F.split(col, r"\|\|\|"), -1), r"\s+"), lambda x: x.rlike(r"^\d+-\d+$"))
    return F.transform(pairs, lambda x: point(F.split_part(x, F.lit("-"), F.lit(1)), F.split_part(x, F.lit("-"), F.lit(2))))


def valid_alignment(col: Column) -> Column:
    return col.rlike(r"^[0-9]+-[0-9]+(\s+[0-9]+-[0-9]+)*$")


def format_points(p: Column) -> Column:
    return F.array_join(F.transform(p, lambda x: F.concat_ws("-", x["s"], x["t"])), " ")


def normalise(p: Column) -> Column:
    return F.array_sort(F.array_distinct(p))


def invert(p: Column) -> Column:
    return F.transform(p, lambda x: point(x["t"], x["s"]))


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


_AROUND = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]


def _grown(a: list, b: list, final: str | None) -> list:
    """Passes over the union in order, each adding points next to one held, until one adds nothing. A point is
    looked at when it gets a neighbour: later in the same pass if it comes behind that one, else in the next
    pass. So the work is linear in the links but for the order."""
    first, second = set(a), set(b)
    held, union = first & second, first | second
    rows, cols = {s for s, _ in held}, {t for _, t in held}

    def add(x) -> None:
        held.add(x)
        rows.add(x[0])
        cols.add(x[1])

    waiting = lambda x: [y for d in _AROUND if (y := (x[0] + d[0], x[1] + d[1])) in union and y not in held]
    now, later = sorted({y for x in held for y in waiting(x)}), []
    while now:
        while now:
            x = heapq.heappop(now)
            # A taken row and column stay taken.
            if x in held or (x[0] in rows and x[1] in cols):
                continue
            add(x)
            for y in waiting(x):
                heapq.heappush(now if y > x else later, y)
        now, later = later, []
    for side in (first, second) if final else ():
        for x in sorted(side):
            row, col = x[0] in rows, x[1] in cols
            if x not in held and not ((row and col) if final == "or" else (row or col)):
                add(x)
    return sorted(held)


def _tuples(points: pa.ListArray) -> list[list | None]:
    """The points of each row as pairs."""
    flat = points.flatten()
    pairs = list(zip(flat.field("s").to_pylist(), flat.field("t").to_pylist(), strict=True))
    out, at = [], 0
    for n in points.value_lengths().to_pylist():
        out.append(None if n is None else pairs[at : at + n])
        at += n or 0
    return out


def _grow(final: str | None):
    """The heuristic as a column: rows of links in Arrow batches, as each step depends on the one before."""

    @F.arrow_udf(POINTS)
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = [None if x is None or y is None else _grown(x, y, final) for x, y in zip(_tuples(a), _tuples(b), strict=True)]
        offsets = pa.array([0, *itertools.accumulate(len(x or ()) for x in out)], pa.int32())
        ends = [pa.array([p[i] for x in out for p in x or ()], pa.int32()) for i in (0, 1)]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(ends, ["s", "t"]), mask=pa.array([x is None for x in out]))

    return run


def grow_diag(a: Column, b: Column) -> Column:
    """From the intersection, points of the union next to one held, with a free row or column; in
    passes over the union in order, until a pass adds nothing."""
    return _grow(None)(a, b)


def grow_diag_final(a: Column, b: Column) -> Column:
    """Then points of each direction with a free row or column."""
    return _grow("or")(a, b)


def grow_diag_final_and(a: Column, b: Column) -> Column:
    """Then points of each direction with a free row and a free column."""
    return _grow("and")(a, b)


SYMMETRISE = {
    "intersect": intersect,
    "union": union,
    "grow-diag": grow_diag,
    "grow-diag-final": grow_diag_final,
    "grow-diag-final-and": grow_diag_final_and,
}


def balanced_group(q: Column, n: Column, k: Column) -> Column:
    """The group of item ``q`` when ``n`` items go into ``k`` groups, the first ``n % k`` one larger."""
    small = F.floor(n / k).cast("int")
    large = (n % k).cast("int")
    early = large * (small + 1)
    return F.when(q < early, F.floor(q / (small + 1))).otherwise(large + F.floor((q - early) / F.greatest(small, F.lit(1)))).cast("int")


def balance(xs: Column, ys: Column) -> Column:
    """Pairs of two lists: the longer one is dealt in order over the shorter one."""
    n, k = F.size(xs), F.size(ys)
    by_y = F.transform(ys, lambda y, q: point(F.element_at(xs, balanced_group(q, k, n) + 1), y))
    by_x = F.transform(xs, lambda x, q: point(x, F.element_at(ys, balanced_group(q, n, k) + 1)))
    return F.when((n == 0) | (k == 0), none()).when(n < k, by_y).otherwise(by_x)


def repair_points(p: Column, start: Column, old_len: Column, new_len: Column, side: str) -> Column:
    """After ``old_len`` tokens at ``start`` became ``new_len`` on ``side`` (s or t): points before
    stay, points behind shift, those inside are dealt evenly over the new tokens."""
    key, end, delta = side, start + old_len, new_len - old_len
    before = F.filter(p, lambda x: x[key] < start)
    moved = lambda x: x[key] + delta
    after = F.transform(F.filter(p, lambda x: x[key] >= end), lambda x: point(moved(x), x["t"]) if side == "s" else point(x["s"], moved(x)))
    inside = F.filter(p, lambda x: (x[key] >= start) & (x[key] < end))
    fresh = F.when(new_len > 0, F.sequence(start, start + new_len - 1)).otherwise(F.array().cast("array<int>"))
    dealt = balance(fresh, F.transform(inside, lambda x: x["t"])) if side == "s" else balance(F.transform(inside, lambda x: x["s"]), fresh)
    return F.when(delta == 0, p).otherwise(F.concat(before, after, dealt))
