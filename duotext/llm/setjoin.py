"""Components of similar shingle sets, from buckets that hold them: shared by near dedup and the n-gram join.

Sets are nodes, buckets are what similar sets are known to share. A bucket gives star
edges only: each of its sets to the bucket's least. Pairs are confirmed on the full sets. First
one pair per set, to the least hub of its buckets, which gives trees; a pair inside one component can't
change a component. Buckets that hold several components then get hubs, ``growth`` times as many each
round, and each hub is paired with all later sets of other components, until each bucket is one
component or all pairs of its components were asked: no pair that shares a bucket is lost. Sets
are hubs in the order of how many others share their buckets.

Pairs that are proven too different reach no full set: by their sizes (and by where in their sets the shared
shingle stands, if the buckets say so), then by odd sketches of 512 bits, then, for larger sets, by sketches of as many bits as a
set has shingles. So crowded buckets of unlike sets make few pairs, however large their sets are.

Keys that a third of all rows may hold (a set, a bucket, a hub, a component) are dealt over tasks by
salts or by ``attach``; what is broadcast is fewer than a thousand rows of numbers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import bucketed, discard, written
from .common import attach
from .graph import components, follow, renamed
from .words import shingle_hashes, word_hashes, words_of


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(word_hashes(words_of(text)), width))


def set_key(sorted_set: np.ndarray) -> tuple[int, int]:
    """128 bits of hash as two signed numbers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(sorted_set.tobytes()))


def odd_sketch(sorted_set: np.ndarray) -> np.ndarray:
    """512 bits, each telling whether an odd number of shingles falls on it. Where the sketches of two sets
    differ, an odd number of the shingles that only one of them has falls: they differ in at
    least as many shingles as their sketches do in bits."""
    bit = np.bincount((sorted_set & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(bit.astype(np.uint8)).view(np.int64)


def halves(keys: list[tuple]) -> list[pa.Array]:
    return [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]


#: Sets of more shingles have a second sketch.
NARROW = 512


def wide_sketch(sorted_set: np.ndarray) -> np.ndarray | None:
    """An odd sketch of as many bits as the set has shingles, up to the next power of two. One of half the bits
    is its two halves, xored."""
    if len(sorted_set) <= NARROW:
        return None
    bits = 1 << (len(sorted_set) - 1).bit_length()
    odd = np.bincount((sorted_set & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def differing_bits(a: np.ndarray, b: np.ndarray) -> int:
    """In how many bits two sketches differ at least; the longer one is folded to the length of the shorter."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        half = len(a) // 2
        a = a[:half] ^ a[half:]
    # Of signed numbers it counts the bits of the absolute value.
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), width) for text in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*halves([set_key(own) for own in sets]), pa.array([own.tobytes() for own in sets], pa.binary()), pa.array([wide_sketch(own) for own in sets], pa.list_(pa.int64()))],
                ["k1", "k2", "set", "wide"],
            )

    return run


def _unlike(percent: int):
    """Drops pairs whose wide sketches ``a, b`` prove them too different; ``both`` is the sum of their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([x.values.to_numpy() for x in batch.column(name)] for name in ("a", "b"))
            ok = [(100 + percent) * differing_bits(x, y) <= (100 - percent) * n for x, y, n in zip(a, b, batch.column("both").to_pylist(), strict=True)]
            yield batch.select(["u", "v", "ru", "rv"]).filter(pa.array(ok, pa.bool_()))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                # A union is as large as the larger set at least.
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _with_both(pairs: DataFrame, table: DataFrame, col: str, salts: int) -> DataFrame:
    """The pairs ``u, v`` with ``col`` of both as ``a, b``. ``v`` may be the hub of very many pairs: its value
    is sent once for each salt that its pairs have."""
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(salts)))
    hubs = dealt.select("v", "salt").distinct().join(table.select(F.col("node").alias("v"), F.col(col).alias("b")), "v")
    mine = dealt.join(table.select(F.col("node").alias("u"), F.col(col).alias("a")), "u")
    return mine.join(hubs, ["v", "salt"]).drop("salt")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, salts: int) -> DataFrame:
    """Links ``u, v`` between the roots ``ru, rv`` of the pairs ``u, v`` whose full sets are similar."""
    return _with_both(pairs, sets, "set", salts).select("ru", "rv", "a", "b").mapInArrow(_confirm(percent), "u long, v long")


def _told_apart(pairs: DataFrame, sets: DataFrame, percent: int, salts: int) -> DataFrame:
    """``u, v, ru, rv`` of the pairs ``u, v, ru, rv, both, large`` that wide sketches don't rule out, where both sets have one."""
    cols = ["u", "v", "ru", "rv"]
    left = _with_both(pairs.where("large").drop("large"), sets, "wide", salts).mapInArrow(_unlike(percent), "u long, v long, ru long, rv long")
    return pairs.where("not large").select(cols).unionByName(left)


def _linked(apart: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, salts: int) -> DataFrame:
    """``roots`` after the pairs ``u, v, ru, rv`` were asked."""
    links = written(_confirmed(apart, sets, percent, salts), "near-links")
    out = roots if links.isEmpty() else written(renamed(roots, components(links)), "near-roots")
    discard(links)
    return out


def _divided(members: DataFrame, roots: DataFrame, tried: int) -> DataFrame:
    """The rows ``bucket, u, root, members`` of the buckets that hold several components and sets that
    were no hubs, apart from one."""
    placed = members.join(roots.select(F.col("node").alias("u"), "root"), "u")
    groups = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), (F.min("root") != F.max("root")).alias("several"))
    groups = groups.select("bucket", "n", F.when(F.col("several") & (F.col("n") > tried + 1), F.col("n")).alias("members"))
    return written(attach(placed, groups, ["bucket"], "n").where("members is not null"), "near-divided")


def _around_hubs(groups: DataFrame, sketches: DataFrame, tried: int, upto: int, percent: int, salts: int) -> DataFrame:
    """Pairs ``u, v, ru, rv, both, large`` of each bucket's sets ``tried + 1`` to ``upto`` with the later sets of other
    components: an earlier set was a hub before. A large bucket is dealt by salts. Pairs that sizes
    or sketches rule out are not made: similar sets differ in few shingles, so in few bits. ``at`` is how many
    shingles of a set stand before those that it may share with others of the bucket."""
    shares = F.least(F.lit(salts), 1 + F.floor(F.col("members") / 256)).cast("int")
    share = F.pmod(F.xxhash64("u"), shares).cast("int")
    rows = groups.join(sketches.withColumnRenamed("node", "u"), "u")
    # The first of each share, then the first of those: a large bucket is sorted in parts.
    first = groups.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", share).orderBy("u"))).where(F.col("rank") <= upto)
    hubs = first.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("u")))
    hubs = hubs.where((F.col("rank") <= upto) & (F.col("rank") > tried)).drop("rank")
    hubs = hubs.join(sketches.withColumnRenamed("node", "u"), "u").select(
        "bucket", F.col("u").alias("v"), F.col("root").alias("rv"), F.col("at").alias("vat"), F.col("size").alias("vsize"), F.col("odd").alias("vodd"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("salt")
    )
    rows = rows.select("bucket", "u", F.col("root").alias("ru"), "at", "size", "odd", share.alias("salt"))
    both = F.col("size") + F.col("vsize")
    # What they have in common is at most what the shorter rest holds.
    apart = (F.col("u") > F.col("v")) & (F.col("ru") != F.col("rv")) & ((100 + percent) * F.least(F.col("size") - F.col("at"), F.col("vsize") - F.col("vat")) >= percent * both)
    bits = sum((F.bit_count(F.col("odd")[i].bitwiseXOR(F.col("vodd")[i])) for i in range(8)), F.lit(0))
    near = (100 + percent) * bits <= (100 - percent) * both
    large = F.least("size", "vsize") > NARROW
    return rows.join(hubs, ["bucket", "salt"]).where(apart & near).select("u", "v", "ru", "rv", both.alias("both"), large.alias("large")).distinct()


def _owned(width: int):
    """The sets that have the key which their owner gave: an id may stand for other texts as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets, wide = [], [], []
            for text, node, *key in zip(*(batch.column(c) for c in ("text", "node", "k1", "k2")), strict=True):
                own = shingle_set(text.as_py(), width)
                if set_key(own) == tuple(k.as_py() for k in key):
                    nodes.append(node.as_py())
                    sets.append(own.tobytes())
                    wide.append(wide_sketch(own))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()), pa.array(wide, pa.list_(pa.int64()))], ["node", "set", "wide"])

    return run


def _full_sets(texts: DataFrame, firsts: DataFrame, width: int) -> DataFrame:
    """``node, set, wide`` by the new ids, from the texts of the nodes' first rows. Merge joins: the plan is the
    same at every size."""
    owners = firsts.select("doc_id", F.col("id").alias("node"), "k1", "k2")
    several = written(owners.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("holder")), "near-holders")
    one = owners
    if not several.isEmpty():
        one = owners.join(several, owners["doc_id"].eqNullSafe(several["holder"]), "left_anti")
    # The rows of a text that repeats are one node's.
    sets = texts.join(one.hint("merge"), "doc_id").select("text", "node", "k1", "k2").mapInArrow(_owned(width), "node long, set binary, wide array<long>")
    if not several.isEmpty():
        # An id of several nodes, or none: its texts are told apart by their sets.
        held = texts.join(several.hint("merge"), texts["doc_id"].eqNullSafe(several["holder"]), "left_semi").select("text")
        more = held.mapInArrow(_sets(width), "k1 long, k2 long, set binary, wide array<long>").join(owners.drop("doc_id").hint("merge"), ["k1", "k2"])
        sets = sets.unionByName(more.select("node", "set", "wide"))
    return sets.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node").dropDuplicates(["node"])


def set_components(texts: DataFrame, signed: DataFrame, nodes: DataFrame, firsts: DataFrame, shared: DataFrame, width: int, percent: int, salts: int, growth: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``signed``.

    ``signed`` (``doc_id, n_shingles, k1, k2, row``) has the key of each document's set; ``nodes`` (``k1, k2, node, copies,
    least``) has each set, numbered by its first row, ``firsts`` those rows; ``shared`` (``bucket, node, at,
    members``) holds the sets of the buckets of several."""
    # Sets are hubs in the order of how many others share their buckets: the original of many copies
    # comes first, and its copies meet it before they meet each other. Ids follow that order.
    crowds = shared.groupBy("node").agg(F.sum("members").alias("crowd")).orderBy(F.desc("crowd"), "node")
    wanted = written(crowds.select("node", F.monotonically_increasing_id().alias("id")), "near-wanted")
    firsts = written(firsts.join(wanted.hint("merge"), "node").select("node", "id", "doc_id", "n_shingles", "k1", "k2", "odd"), "near-firsts")
    sets = bucketed(_full_sets(texts, firsts, width), "near-sets", ["node"], dealt=True)
    sketches = bucketed(firsts.select(F.col("id").alias("node"), F.col("n_shingles").alias("size"), "odd"), "near-sketches", ["node"])
    shared = written(shared.join(wanted.hint("merge"), "node").select("bucket", F.col("id").alias("u"), "at", "members"), "near-shared")

    # One pair a set, to the first hub of its buckets: the links are trees.
    least = written(shared.groupBy("bucket").agg(F.min("u").alias("hub"), F.count(F.lit(1)).alias("n")), "near-least")
    first = attach(shared, least, ["bucket"], "n").where("u != hub").groupBy("u").agg(F.min("hub").alias("v"))
    first = written(first, "near-first")
    trees = _confirmed(first.select("u", "v", F.col("u").alias("ru"), F.col("v").alias("rv")), sets, percent, salts)
    trees = follow(trees.select(F.col("u").alias("node"), F.col("v").alias("parent")))
    roots = written(wanted.select(F.col("id").alias("node")).join(trees, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-roots")
    asked, tried, hubs = first, 0, 2
    groups = _divided(shared.select("bucket", "u", "at"), roots, tried)
    while not groups.isEmpty():
        more = written(_around_hubs(groups, sketches, tried, tried + hubs, percent, salts).join(asked, ["u", "v"], "left_anti"), "near-more")
        new = _linked(_told_apart(more, sets, percent, salts), roots, sets, percent, salts)
        asked, tried, hubs = asked.unionByName(more.select("u", "v")), tried + hubs, growth * hubs
        then = groups.where(F.col("members") > tried + 1) if new is roots else _divided(groups.select("bucket", "u", "at"), new, tried)
        roots, groups = new, then
    discard(sets, sketches, shared)

    roots = roots.withColumnRenamed("node", "id").join(wanted, "id").select("node", "root")
    linked = written(nodes.join(roots, "node"), "near-linked")
    best = written(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")), "near-best")
    named = attach(linked, best, ["root"], "n").select("k1", "k2", "copies", "component_id")
    copies = nodes.where("copies > 1").join(wanted, "node", "left_anti").select("k1", "k2", "copies", F.col("least").alias("component_id"))
    out = attach(signed.select("doc_id", "n_shingles", "k1", "k2"), written(named.unionByName(copies), "near-named"), ["k1", "k2"], "copies")
    # A document that is alone with its set, or whose component has no id at all, keeps its own.
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
