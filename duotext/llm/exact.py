"""Exact dedup by skew-safe combining.

Texts are equal when they are identical after deleting every ASCII blank. Three combining stages,
each grouping by the digest *and* the whole normalised text, so that equal digests of different
texts never meet:

1. local: each input partition keeps one row per text (Spark's map-side partial aggregate),
2. salted: the partitions' rows meet by (digest, text, salt), where the salt is the partition's
   number modulo ``salts``; a group of a third of all rows is spread over that many tasks,
3. global: at most ``salts`` rows per text meet by (digest, text).

The result reaches the documents by ``attach``, which deals a large group over all tasks.

Defined results: null text counts as empty; null ids order after all others; of equal texts the
row with the most code points in the original text stays, then the smallest id; rows that repeat
id and text are the same document and get the same result; an empty table gives an empty result;
extra columns are ignored by :func:`exact_groups` and kept by :func:`exact_dedup`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .common import attach, text_of, without_blanks


def sha256_bytes(col: Column) -> Column:
    return F.unhex(F.sha2(col, 256))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    digest: Callable[[Column], Column] = sha256_bytes,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, digest``.

    ``digest`` may be any hash: collisions only cost time, as whole texts decide.
    """
    norm = without_blanks(text_of(text_col))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        norm.alias("norm"),
        F.char_length(text_of(text_col)).cast("long").alias("chars"),
    ).withColumn("digest", digest(F.col("norm")))
    # Read, normalised and hashed once; what follows prunes the columns that it needs.
    rows = written(rows, "exact-rows")
    best = F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "norm", "salt")
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    merged = salted.groupBy("digest", "norm").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    # Texts held once need no row: their documents stay as they are.
    groups = written(
        merged.groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("texts"),
            F.min("best").alias("best"),
            F.sum("n").alias("n"),
        )
        .where("n > 1")
        .select("digest", "texts", F.col("best.doc_id").alias("keep_id"), "n", F.col("n").alias("group_size")),
        "exact-groups",
    )
    keys = rows.select("doc_id", "digest")
    single = groups.where("texts = 1").drop("texts")
    out = attach(keys, single, ["digest"], "n")
    if not groups.where("texts > 1").isEmpty():
        # Different texts share a digest: those documents are told apart by their texts.
        mixed = groups.where("texts > 1").select("digest", "n", F.lit(True).alias("mixed"))
        marked = attach(keys, mixed, ["digest"], "n").where("mixed is null").drop("mixed")
        texts = merged.join(mixed, "digest", "left_semi").select(
            "digest", "norm", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size")
        )
        out = attach(marked, single, ["digest"], "n").unionByName(
            rows.join(mixed, "digest", "left_semi")
            .join(texts, ["digest", "norm"])
            .select("doc_id", "digest", "keep_id", "group_size")
        )
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "digest",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32) -> DataFrame:
    """The documents that stay, with all their columns; one row where rows repeat."""
    dropped = exact_groups(docs, id_col, text_col, salts).where("not kept").select("doc_id", "digest")
    lost = dropped.select(F.col("doc_id").alias("_lost_id"), F.col("digest").alias("_lost_digest")).distinct()
    same = docs[f"`{id_col}`"].eqNullSafe(lost["_lost_id"])
    n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct(F.struct(F.col(f"`{id_col}`")))).first()
    if n == ids:
        return docs.join(lost, same, "left_anti")
    # An id may stand for several texts, some of them dropped.
    mine = sha256_bytes(without_blanks(text_of(text_col)))
    return docs.join(lost, same & (mine == lost["_lost_digest"]), "left_anti").dropDuplicates()


def query_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


SQL_EXACT_DEDUP = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as chars,
         translate(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '') as norm
  from documents)
select doc_id,
       first_value(doc_id) over (partition by norm order by chars desc, doc_id) as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id = first_value(doc_id) over (partition by norm order by chars desc, doc_id) as kept,
       sha256(norm) as text_sha256
from n
"""
