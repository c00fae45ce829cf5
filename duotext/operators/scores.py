"""Row scores: stability, ambiguity, import, histogram and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stability_score(src: Column, tgt: Column, points: Column) -> Column:
    """F1 of both sides' coverage times the share of aligned tokens; 0 for an empty side."""
    ls, lt = F.size(src), F.size(tgt)
    inside = F.filter(points, lambda p: p["s"].between(0, ls - 1) & p["t"].between(0, lt - 1))
    a_s = F.size(F.array_distinct(F.transform(inside, lambda p: p["s"])))
    a_t = F.size(F.array_distinct(F.transform(inside, lambda p: p["t"])))
    p, r = a_t / lt, a_s / ls
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.when((ls > 0) & (lt > 0), F.round(f * (1 - (ls + lt - a_s - a_t) / (ls + lt)), 5)).otherwise(F.lit(0.0))


def ambiguity_raw(df: DataFrame, phrases: DataFrame, unknown: float = 5.0) -> DataFrame:
    """``row_id, raw``: mean number of single-word entries of a row's distinct words, both sides."""
    out = df.select("row_id")
    for side, col in (("src", "src_phrase"), ("tgt", "tgt_phrase")):
        single = phrases.where(~F.col("src_phrase").contains(" ") & ~F.col("tgt_phrase").contains(" "))
        entries = single.groupBy(F.col(col).alias("word")).agg(F.count(F.lit(1)).alias("entries"))
        words = df.select("row_id", F.explode(F.array_distinct(side)).alias("word"))
        mean = words.join(entries, "word", "left").groupBy("row_id").agg(F.avg(F.coalesce("entries", F.lit(unknown))).alias(side))
        out = out.join(mean, "row_id", "left")
    return out.select("row_id", ((F.coalesce("src", F.lit(1.0)) + F.coalesce("tgt", F.lit(1.0))) / 2).alias("raw"))


def normalise_scores(df: DataFrame, col: str = "raw") -> DataFrame:
    """Min-max normalised and inverted to ``score``; all equal gives 0.5. The bounds are one row."""
    bounds = df.agg(F.min(col).alias("mn"), F.max(col).alias("mx"))
    same = F.col("mx") == F.col("mn")
    return df.crossJoin(F.broadcast(bounds)).withColumn(
        "score", F.when(same, 0.5).otherwise(F.round(1 - (F.col(col) - F.col("mn")) / (F.col("mx") - F.col("mn")), 5))
    ).drop("mn", "mx")


def import_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores by row, 2 decimals; rows without one keep a null."""
    return df.drop("score").join(scores.select("row_id", F.round("score", 2).alias("score")), "row_id", "left")


def save_scores(df: DataFrame, scores: DataFrame) -> DataFrame:
    """The bitext with the new scores where there are some."""
    new = scores.select("row_id", F.col("score").alias("_new"))
    return df.join(new, "row_id", "left").withColumn("score", F.coalesce("_new", "score")).drop("_new")


def init_scores(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.lit(1.0))


def score_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """``bin, lo, n``: equal-width bins between the least and the largest score; the largest falls
    into the last bin; empty bins are rows too."""
    rounded = df.where("score is not null").select(F.round("score", 2).alias("score"))
    bounds = rounded.agg(F.min("score").alias("mn"), F.max("score").alias("mx"))
    width = (F.col("mx") - F.col("mn")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("score") - F.col("mn")) / width), F.lit(bins - 1))).otherwise(0)
    counts = rounded.crossJoin(F.broadcast(bounds)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = bounds.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.col("mn"), width.alias("w"))
    return every.join(counts, "bin", "left").select("bin", F.round(F.col("mn") + F.col("bin") * F.col("w"), 6).alias("lo"), F.coalesce("n", F.lit(0)).alias("n"))


def score_band(score: Column) -> Column:
    return F.when(score >= 0.7, "good").when(score >= 0.4, "medium").otherwise("low")
