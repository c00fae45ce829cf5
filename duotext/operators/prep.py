"""Corpus preparation: filters, caps, token tables, vocabulary and line statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenise, tokens
from .numbering import numbered


def filter_bitext(df: DataFrame, min_len: int = 1, max_len: int = 2000, max_tokens: int = 512, src="src_raw", tgt="tgt_raw") -> DataFrame:
    """Trim both sides; keep rows whose sides have the wanted lengths and numbers of tokens."""
    out = df.withColumns({c: F.btrim(F.col(c), F.lit(" \t\n\x0b\f\r")) for c in (src, tgt)})
    for c in (src, tgt):
        out = out.where(F.length(c).between(min_len, max_len) & (F.size(F.split(c, " ")) <= max_tokens))
    return out


def cap_rows(df: DataFrame, n: int = 1_000_000) -> DataFrame:
    """The first rows in file order: a top-n by row id, not a full sort."""
    return df.orderBy("row_id").limit(n)


def tokenise_bitext(df: DataFrame) -> DataFrame:
    """``src`` and ``tgt`` token arrays of the raw sides."""
    return df.withColumn("src", tokens(tokenise(F.col("src_raw")))).withColumn("tgt", tokens(tokenise(F.col("tgt_raw"))))


def explode_tokens(df: DataFrame, side: str) -> DataFrame:
    return df.select("row_id", F.posexplode(side).alias("pos", "word"))


def vocab(df: DataFrame) -> DataFrame:
    """Dense ids by word."""
    words = df.select(F.explode(F.array_union("src", "tgt")).alias("word")).distinct()
    return numbered(words, ["word"])


def length_stats(df: DataFrame) -> DataFrame:
    """Rows by lengths of both sides: the sufficient statistic of the length model."""
    return df.select(F.size("tgt").alias("len_t"), F.size("src").alias("len_s")).groupBy("len_t", "len_s").count()


def length_totals(df: DataFrame) -> DataFrame:
    """``target_tokens, ratio_sum, mean_ratio``."""
    ratio = F.sum(F.col("count") * F.col("len_t") / F.col("len_s"))
    return length_stats(df).where("len_s > 0").agg(
        F.sum(F.col("count") * F.col("len_t")).alias("target_tokens"), ratio.alias("ratio_sum"), (ratio / F.sum("count")).alias("mean_ratio")
    )


def line_stats(df: DataFrame, col: str, samples: int = 5) -> DataFrame:
    """Lines, lengths, tokens and the first lines of one side, in one aggregate."""
    n_tokens = F.size(F.filter(F.split(col, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    firsts = df.orderBy("row_id").limit(samples).select(F.col("row_id").alias("nth"), col)
    stats = df.agg(
        F.count(F.lit(1)).alias("lines"),
        F.coalesce(F.max(F.length(col)), F.lit(0)).alias("longest"),
        F.coalesce(F.min(F.length(col)), F.lit(0)).alias("shortest"),
        F.round(F.avg(F.length(col)), 2).alias("avg_length"),
        F.coalesce(F.max(n_tokens), F.lit(0)).alias("max_tokens"),
        F.round(F.avg(n_tokens), 2).alias("avg_tokens"),
    )
    sample = firsts.agg(F.array_sort(F.collect_list(F.struct("nth", F.col(col).alias("line")))).alias("s"))
    return stats.crossJoin(sample).withColumn("sample", F.array_join(F.transform("s", lambda x: x["line"]), " / ")).drop("s")
