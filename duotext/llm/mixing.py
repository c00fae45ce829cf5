"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source has ``target / source_size`` expected copies. The copies are summed up
along the documents of a source in a fixed order, one offset is added per source, and a document
is taken once for each integer boundary that its stretch of the sum crosses. The order follows the
sizes (first two digits, then a hash of the id), so each stretch of the sum meets all sizes and the
words taken come near the target. Sums are exact integers of ``UNIT`` parts of a copy, so neither
partitioning nor lost executors change a result.

A hot source is no hot task: each source is cut into blocks of one size class and hash slot, the
blocks' sums are summed up per source (some hundred thousand rows at most), and documents only within
their block. Targets are found over one row per source.

Defined results: null text has size 0; null sources are one source, ordered last; null ids order
first; a document of size 0 may be taken but adds no words; sources without words have target 0;
an empty table gives an empty result; rows that repeat are sampled one by one; extra columns are kept
by :func:`mix_sources`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .common import WORD, text_of

#: Parts of a copy; sums stay exact below 9e11 copies of a source.
UNIT = 10_000_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` of all sizes; a
    target stops at ``cap`` times its source's size and the excess goes to the others by weight.
    With sources ordered by size per weight, the first k stop and the rest share what is left; the
    running sums give that level for each k at once. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), cycle + 1)
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        sizes.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("most_before", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("most_before")) / (F.col("all_weights") - F.col("weights_before")))
    )
    # The level is that of the first source that it does not stop.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("level").alias("at")))).over(everything)
    return filled.withColumn("found", level).select(
        "source",
        "source_size",
        F.least("most", F.coalesce(F.col("weight") * F.col("found.at"), F.col("most"))).alias("target"),
    )


def size_class(size: Column) -> Column:
    """Number of digits and the first two of them: sizes of one class differ by a tenth at most."""
    digits = size.cast("string")
    return F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")


def sample_copies(
    sized: DataFrame,
    rates: DataFrame,
    seed: int = 0,
    slot_digits: int = 3,
) -> DataFrame:
    """``sized`` (source, doc_id, size, and what else a row carries) with ``copies``, by the rates
    (source, source_size, target).

    A source has up to ``16 ** slot_digits`` blocks a size class, of which there are about a hundred that
    matter: with 3, a source of 1e11 documents has blocks of some hundred thousand rows, and the
    running sum over its blocks, one task a source, some hundred thousand rows too."""
    slot = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"/{seed}"))), 1, slot_digits)
    by_source = F.col("l.source").eqNullSafe(F.col("r.source"))
    each = (
        sized.alias("l")
        .join(rates.alias("r"), by_source)
        .select("l.*", "r.source_size", "r.target")
        .withColumn("part", F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long"))
        .withColumn("class", size_class(F.col("size")))
        .withColumn("slot", slot)
    )
    blocks = each.groupBy("source", "class", "slot").agg(F.sum("part").alias("sum"))
    along = Window.partitionBy("source").orderBy("class", "slot").rowsBetween(Window.unboundedPreceding, -1)
    # One offset a source, from its name: reruns agree.
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 7), 16, 10).cast("long") % UNIT
    blocks = blocks.select("source", "class", "slot", (F.coalesce(F.sum("sum").over(along), F.lit(0)) + offset).alias("start"))
    inside = (
        Window.partitionBy("source", "class", "slot")
        .orderBy(F.col("doc_id").asc_nulls_first(), "size", "tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = F.col("start") + F.col("run")
    return (
        each.withColumn("run", F.sum("part").over(inside))
        .alias("d")
        .join(
            blocks.alias("b"),
            F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.class") == F.col("b.class")) & (F.col("d.slot") == F.col("b.slot")),
        )
        .select("d.*", "b.start")
        .withColumn("copies", F.floor(upto / UNIT).cast("long") - F.floor((upto - F.col("part")) / UNIT).cast("long"))
        .drop("part", "class", "slot", "run", "start")
    )


def mix_plan(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 0, **targets) -> DataFrame:
    """One row per document: ``doc_id, source, size, tie, source_size, target, copies``. Texts are
    read once, for their sizes."""
    sized = written(
        docs.select(
            F.col(f"`{id_col}`").alias("doc_id"),
            F.col(f"`{source_col}`").cast("string").alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(text_of(text_col)).alias("tie"),
        ),
        "mix-sizes",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sample_copies(sized, source_targets(sizes, **targets), seed)


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 0, **targets) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with all its columns."""
    plan = mix_plan(docs, id_col, text_col, source_col, seed, **targets).where("copies > 0")
    # Rows alike in id, source, size and text share their copies: they are interchangeable.
    key = [F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("tie").alias("_tie")]
    plan = plan.groupBy(*key).agg(F.sum("copies").alias("_copies"))
    keyed = docs.withColumn("_tie_of", F.xxhash64(text_of(text_col)))
    same = Window.partitionBy("_key", "_from", "_tie_of")
    n_rows, n_ids = docs.agg(F.count(F.lit(1)), F.count_distinct(F.struct(F.col(f"`{id_col}`")))).first()
    if n_rows != n_ids:  # deal the copies of rows that repeat among those rows
        keyed = (
            keyed.withColumn("_key", F.col(f"`{id_col}`")).withColumn("_from", F.col(f"`{source_col}`"))
            .withColumn("_rank", F.row_number().over(same.orderBy(F.lit(1))) - 1)
            .withColumn("_rows", F.count(F.lit(1)).over(same)).drop("_key", "_from")
        )
    else:
        keyed = keyed.withColumn("_rank", F.lit(0)).withColumn("_rows", F.lit(1))
    joined = keyed.join(
        plan,
        keyed[f"`{id_col}`"].eqNullSafe(plan["_id"])
        & keyed[f"`{source_col}`"].cast("string").eqNullSafe(plan["_source"])
        & (keyed["_tie_of"] == plan["_tie"]),
    )
    mine = F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_rank") < F.col("_copies") % F.col("_rows")).cast("long")
    return (
        joined.withColumn("_mine", mine.cast("int")).where("_mine > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_mine"))))
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def query_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL_MIXING = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from sized group by source),
w as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight,
             source_size * 2.0::double as most from s),
r as (select *, most / weight as ratio from w),
f as (select *, sum(source_size) over () * 1.5::double as total, sum(weight) over () as all_weights,
             coalesce(sum(most) over b, 0.0) as most_before, coalesce(sum(weight) over b, 0.0) as weights_before
      from r window b as (order by ratio, source is null, source rows between unbounded preceding and 1 preceding)),
v as (select *, (total - most_before) / (all_weights - weights_before) as level from f),
l as (select arg_min(level, ratio) as lvl from v where level <= ratio),
t as (select source, source_size, least(most, coalesce(weight * lvl, most)) as target,
             case when source_size > 0 then round(least(most, coalesce(weight * lvl, most)) / source_size * 10000000) else 0 end::bigint as part
      from v cross join l),
d as (select sized.doc_id, sized.source, size, source_size, target, part,
             length(size::varchar) * 100 + substr(size::varchar, 1, 2)::int as class,
             substr(md5(coalesce(sized.doc_id::varchar, '') || '/0'), 1, 3) as slot
      from sized join t on sized.source is not distinct from t.source),
c as (select *, sum(part) over (partition by source order by class, slot, doc_id nulls first, size rows between unbounded preceding and current row)
             + ('0x' || substr(md5('0/' || coalesce(source, '')), 1, 7))::bigint % 10000000 as upto from d)
select doc_id, size, source_size, target,
       ((upto // 10000000 - (upto - part) // 10000000) * size)::bigint as taken
from c
"""
