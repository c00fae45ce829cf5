"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

A document's set holds the hashes of its distinct word shingles. One permutation of the hashes puts
each shingle into one of ``bins`` bins; the least of a bin is its value, and an empty bin takes the
value of a bin that a fixed sequence of random picks finds first (the same sequence for every
document). ``rows`` bins form a band; documents that share a band's values meet in a bucket.

Documents with equal sets are one node from the start, numbered by its first row. A bucket gives star edges, which
are confirmed on full sets and grown until each bucket is settled (``setjoin``).

Defined results: documents without words are linked with nothing; null text has no words; documents
with equal sets are linked; a component's id is its smallest id (null only where all its ids are);
an empty table gives an empty result; extra columns are ignored by :func:`near_components` and
kept by :func:`near_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import attach, only_once
from .setjoin import halves, odd_sketch, set_components, set_key, shingle_set
from .words import mixed


@cache
def _picks(bins: int) -> np.ndarray:
    """For each bin its sequence of random bins; every bin occurs in every sequence."""
    rng = np.random.default_rng(20140901)
    tries = rng.integers(0, bins, (bins, 8 * bins))
    return np.concatenate([tries, np.tile(np.arange(bins), (bins, 1))], axis=1)


def one_permutation(sorted_set: np.ndarray, bins: int) -> np.ndarray:
    """The densified signature. ``bins`` is a power of two: the top bits choose the bin."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    of = (sorted_set >> shift).astype(np.int64)
    first = np.searchsorted(of, np.arange(bins))
    full = np.zeros(bins, bool)
    full[of] = True
    out = np.zeros(bins, np.uint64)
    out[full] = sorted_set[first[full]]
    empty = np.flatnonzero(~full)
    if len(empty):
        picks = _picks(bins)[empty]
        out[empty] = out[picks[np.arange(len(empty)), full[picks].argmax(axis=1)]]
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    bands = signature.reshape(-1, rows)
    acc = np.arange(1, len(bands) + 1, dtype=np.uint64)
    for i in range(rows):
        acc = mixed(acc * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return acc.view(np.int64)


def _signatures(width: int, bins: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands, odd = [], [], [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), width)
                sizes.append(len(own))
                keys.append(set_key(own) if len(own) else (None, None))
                bands.append(band_keys(one_permutation(own, bins), rows) if len(own) else None)
                odd.append(odd_sketch(own))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (bands, odd)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), *halves(keys), *lists],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "odd"],
            )

    return run


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    bins: int = 128,
    rows: int = 4,
    salts: int = 64,
    growth: int = 32,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    ``salts`` bounds the tasks over which a hub's pairs are dealt; ``growth`` is the factor by which the
    hubs asked in a round grow, and decides on the number of rounds only."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    id_type = dict(texts.dtypes)["doc_id"]
    signed = texts.mapInArrow(_signatures(width, bins, rows), f"doc_id {id_type}, n_shingles long, k1 long, k2 long, bands array<long>, odd array<long>")
    signed = written(signed.withColumn("row", F.monotonically_increasing_id()), "near-signatures")
    # A node is a distinct set, numbered by its first row.
    nodes = written(
        signed.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least")),
        "near-nodes",
    )
    firsts = written(signed.withColumnRenamed("row", "node").join(nodes.select("node").hint("merge"), "node", "left_semi"), "near-firsts")
    members = firsts.select("node", F.explode("bands").alias("bucket"))
    crowded = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("members", F.col("n")), "near-crowded")
    shared = written(attach(members, crowded, ["bucket"], "n").where("members is not null").withColumn("at", F.lit(0)), "near-shared")
    return set_components(texts, signed, nodes, firsts, shared, width, percent, salts, growth)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents that stay, one of each component, with all their columns. An id that stands
    for several texts goes only if none of them stays."""
    judged = near_components(docs, id_col, text_col, **settings).select(F.col("doc_id").alias("_lost"), "kept")
    dropped = judged.groupBy("_lost").agg(F.bool_or("kept").alias("kept")).where("not kept").select("_lost")
    return only_once(docs.join(dropped, docs[f"`{id_col}`"].eqNullSafe(dropped["_lost"]), "left_anti"), id_col)


def query_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL_NEAR_DEDUP = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents),
s as (
  select distinct doc_id, case when len(words) < 5 then array_to_string(words, ' ')
         else array_to_string(words[i + 1 : i + 5], ' ') end as shingle
  from (select doc_id, words, unnest(range(greatest(len(words) - 4, 1))) as i from w where len(words) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * common >= 75 * (p.n + q.n - common)),
r as (select doc_id as x, doc_id as root from documents union select e.y, r.root from r join e on e.x = r.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.root as component_id, d.doc_id = m.root as kept
from documents d left join n using (doc_id) join (select x, min(root) as root from r group by x) m on m.x = d.doc_id
"""
