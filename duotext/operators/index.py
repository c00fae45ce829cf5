"""A positional inverted index of tokens, searched by the rarest token of what is looked for.

The index has a row for each token of a row and side, with the token's positions. A search takes the postings of each
phrase's rarest token only, so that a phrase with a frequent word costs as much as its rarest word; what these rows hold of
the other tokens is verified by positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW = ["project_id", "row_id"]
_PLACE = ["project_id", "side", "token"]


def token_index(bitext: DataFrame, lower: bool = False) -> DataFrame:
    """``project_id, side, token, row_id, positions`` of rows not deleted; ``lower`` folds case."""
    token = F.lower("token") if lower else F.col("token")
    sides = [bitext.where("not deleted").select(*ROW, F.lit(s).alias("side"), F.posexplode(s).alias("pos", "token")) for s in ("src", "tgt")]
    return sides[0].unionByName(sides[1]).groupBy("project_id", "side", token.alias("token"), "row_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def document_frequencies(index: DataFrame) -> DataFrame:
    """``project_id, side, token, rows``: in how many rows a token occurs; combined before the shuffle."""
    return index.groupBy(_PLACE).agg(F.count(F.lit(1)).alias("rows"))


def phrase_tokens(phrases: DataFrame, lower: bool = False) -> DataFrame:
    """``id, project_id, side, k, token, len, sides`` of ``phrases (id, project_id, src_phrase, tgt_phrase)``: each token of the
    phrases that are looked for, with its place. A null phrase is not looked for; one without tokens is nowhere."""
    parts = []
    for side in ("src", "tgt"):
        phrase = F.lower(f"{side}_phrase") if lower else F.col(f"{side}_phrase")
        words = F.filter(F.split(phrase, " "), lambda x: x != "")
        sides = F.col("src_phrase").isNotNull().cast("int") + F.col("tgt_phrase").isNotNull().cast("int")
        parts.append(phrases.select("id", "project_id", F.lit(side).alias("side"), sides.alias("sides"), F.size(words).alias("len"), F.posexplode(words).alias("k", "token")))
    return parts[0].unionByName(parts[1])


def find_phrases(index: DataFrame, phrases: DataFrame, lower: bool = False) -> DataFrame:
    """``id, project_id, row_id``: the rows that hold the phrases of both sides as whole tokens in a row."""
    tokens = phrase_tokens(phrases, lower)
    # What occurs nowhere has no frequency: its phrase has no rows.
    wanted = tokens.select(_PLACE).distinct()
    rows = document_frequencies(index.join(wanted, _PLACE, "left_semi"))
    ranked = tokens.join(rows, _PLACE, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    rarest = ranked.groupBy("id", "project_id").agg(F.min(F.struct("rows", "side", "k", "token")).alias("r")).select("id", "project_id", "r.side", "r.token")
    held = index.join(rarest, _PLACE).select("id", *ROW)
    # Each token of the phrases in those rows says where its phrase would start.
    asked = held.join(tokens.drop("project_id"), "id")
    starts = asked.join(index, [*ROW, "side", "token"]).select("id", *ROW, "side", "sides", "len", F.explode(F.transform("positions", lambda p: p - F.col("k"))).alias("start"))
    whole = starts.groupBy("id", *ROW, "side", "sides", "len", "start").agg(F.count(F.lit(1)).alias("n")).where("n = len")
    return whole.groupBy("id", *ROW, "sides").agg(F.count_distinct("side").alias("n")).where("n = sides").select("id", *ROW)


def search_indexed(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Many searches at once, whatever the case: ``id, project_id, row_id`` for ``queries (id, project_id, src_phrase,
    tgt_phrase)``; a null or empty phrase asks nothing of its side. ``index`` is one of folded case."""
    asked = queries.withColumns({c: F.when(F.trim(c) != "", F.col(c)) for c in ("src_phrase", "tgt_phrase")})
    return find_phrases(index, asked.where("src_phrase is not null or tgt_phrase is not null"), lower=True)
