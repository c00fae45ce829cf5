"""Search, paging and row edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import detokenise, occurrence_spans, tokenise, tokens
from ..scratch import spread
from .hidden import visible
from .phrases import PAIR

ROW = ["project_id", "row_id"]


def _paged(df: DataFrame, order: list, start: int, length: int) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(length)


def browse_filter(phrases: DataFrame, hidden: DataFrame, search: str | None = None, direction: int = 0, min_length: int = 1) -> DataFrame:
    """Visible phrases of a direction: those with the text on either side, or, without a text, those
    of at least ``min_length`` words on either side."""
    rows = visible(phrases.where(F.col("direction") == direction), hidden)
    if search:
        has = lambda c: F.lower(detokenise(F.col(c))).contains(search.lower())
        return rows.where(has("src_phrase") | has("tgt_phrase"))
    spaces = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit(" "), F.lit("")))
    return rows.where((spaces("src_phrase") >= min_length - 1) | (spaces("tgt_phrase") >= min_length - 1))


def browse_phrases(phrases: DataFrame, hidden: DataFrame, start: int = 0, length: int = 50, **filters) -> DataFrame:
    """A page with ``total`` and ``filtered``, the counts without and with the filter."""
    rows = browse_filter(phrases, hidden, **filters)
    total = visible(phrases.where(F.col("direction") == filters.get("direction", 0)), hidden).agg(F.count(F.lit(1)).alias("total"))
    filtered = rows.agg(F.count(F.lit(1)).alias("filtered"))
    page = _paged(rows, [F.desc("num_occurrences"), *PAIR], start, length)
    return page.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(filtered))


def has_phrase(line: Column, phrase: str) -> Column:
    """Whole tokens, whatever the case."""
    return F.concat(F.lit(" "), F.lower(line), F.lit(" ")).contains(f" {phrase.lower()} ")


def search_filter(bitext: DataFrame, src: str | None = None, tgt: str | None = None, text: str | None = None) -> DataFrame:
    """Rows not deleted that hold the phrases, or the free text on either side."""
    rows = bitext.where("not deleted")
    line = {c: F.array_join(c, " ") for c in ("src", "tgt")}
    if src:
        rows = rows.where(has_phrase(line["src"], src))
    if tgt:
        rows = rows.where(has_phrase(line["tgt"], tgt))
    if text:
        rows = rows.where(F.lower(detokenise(line["src"])).contains(text.lower()) | F.lower(detokenise(line["tgt"])).contains(text.lower()))
    return rows


def search_bitext(bitext: DataFrame, start: int = 0, length: int = 50, **query) -> DataFrame:
    rows = search_filter(bitext, **query)
    return _paged(rows, ROW, start, length).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total"))))


def concordance(bitext: DataFrame, occ: DataFrame, src: str, tgt: str) -> DataFrame:
    """Rows of a pair with its spans on both sides; where extraction knows no row, rows by search."""
    spans = lambda c, p: occurrence_spans(F.col(c), F.split(F.lit(p), " "))
    known = bitext.join(occ.where((F.col("src_phrase") == src) & (F.col("tgt_phrase") == tgt)).select("row_id").distinct(), "row_id", "left_semi")
    fallback = search_filter(bitext, src=src, tgt=tgt).join(known.select("row_id"), "row_id", "left_anti")
    origin = lambda df, n: df.withColumns({"src_spans": spans("src", src), "tgt_spans": spans("tgt", tgt), "origin": F.lit(n)})
    return origin(known, "extracted").unionByName(origin(fallback, "found"))


def rows_by_id(bitext: DataFrame, ids: DataFrame) -> DataFrame:
    return bitext.join(ids.select(ROW), ROW, "left_semi")


def rows_by_score(bitext: DataFrame, lo: float | None = None, hi: float | None = None, order: str = "desc", page: int = 0, size: int = 100) -> DataFrame:
    """A page of rows in a range of scores; null scores last and shown as 0; ties by row."""
    rows = bitext
    if lo is not None:
        rows = rows.where(F.col("score") >= lo)
    if hi is not None:
        rows = rows.where(F.col("score") <= hi)
    by = {"asc": [F.asc_nulls_last("score")], "desc": [F.desc_nulls_last("score")]}.get(order, [])
    return _paged(rows, [*by, *ROW], page * size, size).withColumn("score", F.coalesce("score", F.lit(0.0)))


def update_rows(bitext: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited rows (``project_id, row_id, src_raw, tgt_raw``) are tokenised anew."""
    new = edits.select(*ROW, tokens(tokenise(F.col("src_raw"))).alias("_s"), tokens(tokenise(F.col("tgt_raw"))).alias("_t"))
    return bitext.join(new, ROW, "left").withColumns({"src": F.coalesce("_s", "src"), "tgt": F.coalesce("_t", "tgt")}).drop("_s", "_t")


def delete_rows(bitext: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete: rows are flagged."""
    gone = ids.select(*ROW, F.lit(True).alias("_gone")).distinct()
    return bitext.join(gone, ROW, "left").withColumn("deleted", F.col("deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def linked_words(bitext: DataFrame) -> DataFrame:
    """Per row and source position the words it is linked to, in order of their positions. Rows are dealt before they are
    expanded: the grouping then moves nothing."""
    links = spread(bitext.select("row_id", "src", "tgt", "points"), "row_id").select("row_id", "src", "tgt", F.explode(F.array_sort(F.array_distinct("points"))).alias("p"))
    inside = links.where("p.s < size(src) and p.t < size(tgt)")
    word = F.struct(F.col("p.t").alias("t"), F.get("tgt", F.col("p.t")).alias("w"))
    return inside.groupBy("row_id", F.col("p.s").alias("s"), F.get("src", F.col("p.s")).alias("word")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["w"]), " ").alias("linked")
    )


def delete_project(tables: dict[str, DataFrame], project_id: int) -> dict[str, DataFrame]:
    """Every table without the project's partition."""
    return {n: t.where(F.col("project_id") != project_id) for n, t in tables.items()}
