"""N-gram Jaccard join: a grouped prefix join over the sets of distinct word n-grams.

Two sets whose Jaccard similarity reaches the threshold share an n-gram among the first few of each, in any
order that holds for all sets: their prefixes. The order here is from rare to frequent, so that the lists of sets
that share an n-gram of their prefixes are short.

1. Order. Each task counts the n-grams of up to ``FLUSH`` set members at a time and hands on those that occur more
   than once; the ``common`` most frequent ones of all tasks get their rank, all others come before them by hash. The table of ranks
   is at most ``common`` numbers. It decides on the length of lists only: any order gives the same links.
2. Grouping. Documents with equal sets are one node; nodes with identical prefixes and size are one group, and only
   groups have entries in the lists of n-grams.
3. Group pairs. An n-gram that one group alone has in its prefix pairs nothing. The lists of the others are cut by size class: sizes
   of similar sets are in the same or in adjacent classes, so a group has an entry in its own class and in the
   next one, and an entry alone in its class goes.
4. Members. What is left is expanded to the groups' members, and a group of several members is a list of its
   own. Pairs are filtered by size, by the position of the shared n-gram and by sketches, and verified on full
   sets (``setjoin``), until each list is one component or all its pairs were asked. So no link between different sets is
   lost, and no group of many members makes all its pairs.

Defined results: documents without words are linked with nothing; null text has no words; fewer words than an
n-gram's are one n-gram as a whole; documents with equal sets are linked; a component's id is its smallest id (null only
where all its ids are); rows that repeat are linked; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import discard, written
from .common import attach
from .setjoin import halves, odd_sketch, set_components, set_key, shingle_set

#: Set members that a task counts at a time.
FLUSH = 4_000_000


def _counted(width: int):
    """``gram, n`` of the n-grams that a task meets more than once among different sets."""

    def flush(sets: dict) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
        many = n > 1
        return pa.RecordBatch.from_arrays([pa.array(grams[many].view(np.int64)), pa.array(n[many], pa.int64())], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = {}, 0
        for batch in batches:
            for text in batch.column(0):
                own = shingle_set(text.as_py(), width)
                key = set_key(own)
                if key not in sets:
                    sets[key] = own
                    size += len(own)
                if size >= FLUSH:
                    yield flush(sets)
                    sets, size = {}, 0
        yield flush(sets)

    return run


def common_grams(texts: DataFrame, width: int, common: int) -> np.ndarray:
    """The most frequent n-grams, from less to more frequent: whole classes of equal counts, at most ``common`` n-grams."""
    counts = texts.select("text").mapInArrow(_counted(width), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "join-common")
    classes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("grams"))  # one row a count
    upto = F.sum("grams").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    least = classes.withColumn("upto", upto).where(F.col("upto") <= common).agg(F.min("n").alias("least")).first()["least"]
    top = counts.where(F.lit(False) if least is None else F.col("n") >= least).toArrow()
    discard(counts)
    grams, n = (top.column(c).to_numpy() for c in ("gram", "n"))
    return grams[np.lexsort((grams, n))].view(np.uint64)


def prefix_of(sorted_set: np.ndarray, percent: int, known: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first n-grams of a set in the common order: as many as it may lack of a similar set, and one. ``known`` is
    sorted; ``ranks`` are the ranks of its n-grams."""
    n = len(sorted_set)
    rank = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, sorted_set), len(known) - 1)
        rank = np.where(known[at] == sorted_set, ranks[at], 0)
    order = np.lexsort((sorted_set, rank))
    return sorted_set[order[: n - (percent * n + 99) // 100 + 1]]


def _keyed(width: int, percent: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        by_gram = np.argsort(common)
        known, ranks = common[by_gram], by_gram + 1
        for batch in batches:
            sizes, keys, groups, prefixes, odd = [], [], [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), width)
                prefix = prefix_of(own, percent, known, ranks) if len(own) else own
                sizes.append(len(own))
                keys.append(set_key(own) if len(own) else (None, None))
                groups.append(xxhash.xxh3_128_digest(len(own).to_bytes(8, "little") + prefix.tobytes()))
                prefixes.append(prefix.view(np.int64))
                odd.append(odd_sketch(own))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (prefixes, odd)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *halves(keys), pa.array(groups, pa.binary()), *lists],
                ["doc_id", "n_shingles", "k1", "k2", "alike", "prefix", "odd"],
            )

    return run


def _crowded(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key others have as well, with their number as ``members``."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("members", F.col("n"))
    return attach(rows, written(counts, "join-counts"), [key], "n").where("members is not null")


def _entries(prefixes: DataFrame, firsts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``group, node, size`` of all nodes, and ``bucket, group, at, size``: the groups' entries in the lists that pair them."""
    groups = firsts.groupBy("alike").agg(F.min("node").alias("group"), F.count(F.lit(1)).alias("size"), F.min("n_shingles").alias("n_shingles"))
    groups = written(groups, "join-groups")
    named = attach(firsts.select("alike", "node"), groups.select("alike", "size", "group", F.col("size").alias("n")), ["alike"], "size")
    named = written(named.select("group", "node", F.col("n").alias("size")), "join-named")
    leaders = prefixes.select(F.col("row").alias("group"), "prefix").join(groups.select("group").hint("merge"), "group", "left_semi")
    lists = leaders.select("group", F.posexplode("prefix").alias("at", "gram"))
    lists = written(_crowded(lists, "gram").drop("members"), "join-lists")
    # A similar set is at most 100 / percent times as large: its class is the same or the next one.
    size_class = F.floor(F.log("n_shingles") / F.log(F.lit(100 / percent)) + 1e-9)
    sized = lists.join(groups.select("group", "size", "n_shingles").hint("merge"), "group")
    classed = sized.select(F.explode(F.array(size_class, size_class + 1)).alias("class"), "gram", "group", "at", "size")
    entries = written(_crowded(classed.select(F.xxhash64("gram", "class").alias("bucket"), "group", "at", "size"), "bucket").drop("members"), "join-entries")
    discard(groups, lists)
    return named, entries


def _expanded(named: DataFrame, entries: DataFrame, salts: int) -> DataFrame:
    """``bucket, node, at``: the members of the groups of each list, and each group of several as a list of its own.
    A large group's members are dealt by salts."""
    alone = entries.where("size = 1").select("bucket", F.col("group").alias("node"), "at")
    shares = F.least(F.lit(salts), 1 + F.floor(F.col("size") / 256)).cast("int")
    many = entries.where("size > 1").select("bucket", "group", "at", F.explode(F.sequence(F.lit(0), shares - 1)).alias("salt"))
    members = named.where("size > 1").select("group", "node", F.pmod(F.xxhash64("node"), shares).cast("int").alias("salt"))
    within = named.where("size > 1").select(F.xxhash64(F.lit("group"), "group").alias("bucket"), "node", F.lit(0).alias("at"))
    return alone.unionByName(many.join(members, ["group", "salt"]).select("bucket", "node", "at")).unionByName(within)


def ngram_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    percent: int = 85,
    common: int = 1 << 22,
    salts: int = 64,
    growth: int = 32,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    ``common`` bounds the table of the order, ``salts`` the tasks over which a large group or list is dealt, ``growth`` the
    number of rounds; none of them changes the result."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    id_type = dict(texts.dtypes)["doc_id"]
    order = spark.sparkContext.broadcast(common_grams(texts, width, common))
    signed = texts.mapInArrow(_keyed(width, percent, order), f"doc_id {id_type}, n_shingles long, k1 long, k2 long, alike binary, prefix array<long>, odd array<long>")
    prefixes = written(signed.withColumn("row", F.monotonically_increasing_id()), "join-prefixes")
    # The prefixes, most of its bytes, are read once.
    signed = written(prefixes.drop("prefix"), "join-signed")
    nodes = written(
        signed.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")),
        "join-nodes",
    )
    firsts = written(signed.withColumnRenamed("row", "node").join(nodes.select("node").hint("merge"), "node", "left_semi"), "join-firsts")
    named, entries = _entries(prefixes, firsts, percent)
    discard(prefixes)
    shared = written(_expanded(named, entries, salts), "join-shared")
    discard(named, entries)
    sizes = written(shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("members", F.col("n")), "join-sizes")
    shared = written(attach(shared, sizes, ["bucket"], "n"), "join-shared")
    discard(sizes)
    return set_components(texts, signed, nodes, firsts, shared, width, percent, salts, growth)


def query_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


SQL_NGRAM_JOIN = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents),
s as (
  select distinct doc_id, case when len(words) < 4 then array_to_string(words, ' ')
         else array_to_string(words[i + 1 : i + 4], ' ') end as shingle
  from (select doc_id, words, unnest(range(greatest(len(words) - 3, 1))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * common >= 85 * (p.n + q.n - common)),
r as (select doc_id as x, doc_id as root from documents union select e.y, r.root from r join e on e.x = r.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.root as component_id
from documents d left join n using (doc_id) join (select x, min(root) as root from r group by x) m on m.x = d.doc_id
"""
