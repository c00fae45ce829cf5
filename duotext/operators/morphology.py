"""Form-aligned phrases: joins with two lexicons, checked by their features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.morph import head_token, morph_compatible, parse_src_tag, parse_tgt_feat
from ..functions.text import is_single, norm_token


def reduce_lexicon(lexicon: DataFrame, needed: DataFrame) -> DataFrame:
    """Entries whose form occurs: a semi join on the normalised form (``needed.form``)."""
    return lexicon.withColumn("form", norm_token(F.col("form"))).join(needed.select("form").distinct(), "form", "left_semi")


def _tags(lexicon: DataFrame, needed: DataFrame, tag: str, side: str) -> DataFrame:
    """``<side>_form, <side>_tag, <side>_line, <side>_entries``: a form's distinct tags, each with its first
    line and the number of its entries. A form has few tags, however many entries it has."""
    rows = reduce_lexicon(lexicon, needed).groupBy(F.col("form").alias(f"{side}_form"), F.col(tag).alias(f"{side}_tag"))
    return rows.agg(F.min("line").alias(f"{side}_line"), F.count(F.lit(1)).alias(f"{side}_entries"))


def morph_pairs(phrases: DataFrame, lex_src: DataFrame, lex_tgt: DataFrame) -> DataFrame:
    """Compatible tags of single-word phrases of direction 0: the parsed tags ``a, b``, their first lines
    and ``entries``, the number of compatible (source entry, target entry) pairs with these tags.
    The lexicons carry ``line``, their order."""
    cand = (
        phrases.where((F.col("direction") == 0) & is_single(F.col("src_phrase")))
        .select("src_phrase", "tgt_phrase", norm_token(F.col("src_phrase")).alias("src_form"), head_token(F.col("tgt_phrase")).alias("tgt_form"))
        .where("tgt_form != ''")
        .distinct()
    )
    left = _tags(lex_src, cand.select(F.col("src_form").alias("form")), "tag", "src").withColumn("a", parse_src_tag(F.col("src_tag")))
    right = _tags(lex_tgt, cand.select(F.col("tgt_form").alias("form")), "feat", "tgt").withColumn("b", parse_tgt_feat(F.col("tgt_tag")))
    pairs = cand.join(left, "src_form").join(right, "tgt_form").where(morph_compatible(F.col("a"), F.col("b")))
    return pairs.select("src_phrase", "tgt_phrase", "a", "b", "src_line", "tgt_line", (F.col("src_entries") * F.col("tgt_entries")).alias("entries"))


def morph_witness(pairs: DataFrame) -> DataFrame:
    """The first compatible tags of each phrase pair, in the order of the lexicons."""
    first = F.min(F.struct("src_line", "tgt_line", F.col("a.base").alias("src_tag"), F.col("b.feat").alias("tgt_feat")))
    return pairs.groupBy("src_phrase", "tgt_phrase").agg(first.alias("w")).select("src_phrase", "tgt_phrase", "w.src_tag", "w.tgt_feat")


def form_aligned(phrases: DataFrame, lex_src: DataFrame, lex_tgt: DataFrame, cap: int | None = None) -> DataFrame:
    """Distinct phrase pairs whose forms agree, with their witness; the first ``cap`` of them if given."""
    out = morph_witness(morph_pairs(phrases, lex_src, lex_tgt))
    return out if cap is None else out.orderBy("src_phrase", "tgt_phrase").limit(cap)
