"""Translation tables: shares, entropy, top-k; sure and dubious phrases; reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.morph import head_token

MIN_TOTAL, SURE_SHARE = 10, 0.75


def phrase_table(
    phrases: DataFrame,
    top_k: int = 10,
    min_total: int = 1,
    split_by_direction: bool = True,
    include_single: bool = True,
    include_multi: bool = True,
) -> DataFrame:
    """Per (direction, source phrase): ``total, top_tgt, top_count, top_share, num_tgts, entropy, topk``.

    Pairs are summed first, combined before the shuffle. Totals and entropy then need sums only, and
    only the ``top_k`` targets of a source are gathered, never all of them.
    """
    rows = phrases.where("num_occurrences > 0 and trim(src_phrase) != '' and trim(tgt_phrase) != ''")
    single = ~F.trim("src_phrase").rlike(r"\s")
    if not include_single:
        rows = rows.where(~single)
    if not include_multi:
        rows = rows.where(single)
    direction = F.col("direction").cast("string") if split_by_direction else F.lit("all")
    pairs = rows.groupBy(direction.alias("direction"), F.trim("src_phrase").alias("src"), F.trim("tgt_phrase").alias("tgt")).agg(F.sum("num_occurrences").alias("c"))
    # A rank that is cut before anything else is done is cut in each task before the shuffle as well: a hot source
    # sends at most ``top_k`` targets from each.
    rank = F.row_number().over(Window.partitionBy("direction", "src").orderBy(F.desc("c"), "tgt"))
    top = pairs.withColumn("rank", rank).where(F.col("rank") <= top_k)
    best = top.groupBy("direction", "src").agg(F.array_sort(F.collect_list(F.struct("rank", "tgt", "c"))).alias("best"))
    clog = F.sum(F.col("c") * F.log(F.col("c").cast("double")))
    sums = pairs.groupBy("direction", "src").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("num_tgts"), clog.alias("clog"))
    out = sums.join(best, ["direction", "src"])
    total = F.col("total")
    return out.where(total >= min_total).select(
        "direction",
        "src",
        "total",
        F.col("best")[0]["tgt"].alias("top_tgt"),
        F.col("best")[0]["c"].alias("top_count"),
        (F.col("best")[0]["c"] / total).alias("top_share"),
        "num_tgts",
        (F.round(F.log(total.cast("double")) - F.col("clog") / total, 6) + 0.0).alias("entropy"),
        F.transform("best", lambda x: F.struct(x["tgt"].alias("tgt"), x["c"].alias("count"), (x["c"] / total).alias("share"))).alias("topk"),
    )


def topk_text(col: str | Column = "topk") -> Column:
    return F.array_join(F.transform(col, lambda x: F.concat(x["tgt"], F.lit("("), x["count"].cast("string"), F.lit(")"))), "|")


def table_summary(table: DataFrame) -> DataFrame:
    return table.groupBy("direction").agg(F.count(F.lit(1)).alias("num_rows"))


def sure(table: DataFrame, min_total: int = MIN_TOTAL, split: float = SURE_SHARE) -> DataFrame:
    return table.where((F.col("total") >= min_total) & (F.col("top_share") >= split))


def dubious(table: DataFrame, min_total: int = MIN_TOTAL, split: float = SURE_SHARE) -> DataFrame:
    return table.where((F.col("total") >= min_total) & (F.col("top_share") < split))


def robustness(phrases: DataFrame, min_total: int = MIN_TOTAL, split: float = SURE_SHARE) -> DataFrame:
    """The class of each single-word source of direction 0: below, sure or dubious."""
    table = phrase_table(phrases.where("direction = 0"), top_k=7, include_multi=False)
    kind = F.when(F.col("total") < min_total, "below").when(F.col("top_share") >= split, "sure").otherwise("dubious")
    return table.withColumn("class", kind)


def robustness_report(phrases: DataFrame, min_total: int = MIN_TOTAL, split: float = SURE_SHARE) -> DataFrame:
    """One row of counts, with what is left to review."""
    count = lambda *k: F.count_if(F.col("class").isin(*k))
    return robustness(phrases, min_total, split).agg(
        F.count(F.lit(1)).alias("unique_src_considered"),
        count("below").alias("below_min_total"),
        count("sure", "dubious").alias("classified_total"),
        count("sure").alias("sure_found"),
        count("dubious").alias("dubious_found"),
        count("dubious", "below").alias("to_review"),
    )


def robustness_examples(phrases: DataFrame, n: int = 25, alternatives: int = 6) -> DataFrame:
    """The most frequent sure and dubious sources, with alternatives to their top translation."""
    classed = robustness(phrases).where("class != 'below'")
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("total"), "src"))
    return classed.withColumn("rank", rank).where(F.col("rank") <= n).select(
        "class", "rank", "src", "top_tgt", "top_count", "total", F.round("top_share", 6).alias("top_share"),
        F.array_join(F.transform(F.slice("topk", 2, alternatives), lambda x: F.concat(x["tgt"], F.lit("("), x["count"].cast("string"), F.lit(")"))), "|").alias("alternatives"),
    )


def percent_text(part: Column, total: Column) -> Column:
    """A share in per cent with one digit, halves up, by whole numbers."""
    tenths = F.floor((part * 2000 + total) / (total * 2)).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def _count_lines(counts: DataFrame, section: str) -> DataFrame:
    """One row of counts as a line each."""
    line = lambda i, c: F.struct(F.lit(section).alias("section"), F.lit(i).cast("long").alias("line_no"), F.concat(F.lit(f"- {c}: "), F.col(c).cast("string")).alias("text"))
    return counts.select(F.explode(F.array(*[line(i, c) for i, c in enumerate(counts.columns)])).alias("l")).select("l.*")


def render_report(phrases: DataFrame) -> DataFrame:
    """The translation overview as text lines: ``section, line_no, text``."""
    examples = robustness_examples(phrases).select(
        F.col("class").alias("section"), F.col("rank").cast("long").alias("line_no"),
        F.concat("src", F.lit(" -> "), "top_tgt", F.lit(" ("), percent_text(F.col("top_count"), F.col("total")), F.lit(", total "), F.col("total").cast("string"), F.lit(")")).alias("text"),
    )
    return _count_lines(robustness_report(phrases), "counts").unionByName(examples)


def hidden_selection_report(robust: DataFrame, form: DataFrame, examples: int = 12, alternatives: int = 6) -> DataFrame:
    """The hidden selection as text lines. ``robust`` are rows of the phrase table; ``form`` are form-aligned pairs with
    their witness: ``src_phrase, tgt_phrase, src_tag, tgt_feat``. The most frequent robust pairs come first."""
    r = robust.withColumn("tgt", F.col("top_tgt")).select("src", "tgt", "total", "top_count", "num_tgts", topk_text(F.slice("topk", 1, alternatives)).alias("top")).dropDuplicates(["src", "tgt"])
    f = form.groupBy(F.trim("src_phrase").alias("src"), F.trim("tgt_phrase").alias("tgt")).agg(F.min(F.struct("src_tag", "tgt_feat")).alias("w"))
    part = F.when(F.col("total").isNotNull() & F.col("w").isNotNull(), "both").when(F.col("total").isNotNull(), "robust only").otherwise("form only")
    joined = r.join(f, ["src", "tgt"], "full_outer").withColumn("section", part)
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc_nulls_last("total"), "src", "tgt"))
    top = joined.withColumn("line_no", rank.cast("long")).where(F.col("line_no") <= examples)
    share = F.concat(
        F.lit(" | conf="), percent_text(F.col("top_count"), F.col("total")), F.lit(" ("), F.col("top_count").cast("string"), F.lit("/"), F.col("total").cast("string"),
        F.lit("), variants="), F.col("num_tgts").cast("string"), F.lit(" | top: "), F.col("top"),
    )
    head = lambda text: F.concat(F.lit(text), F.coalesce(head_token(F.col("tgt")), F.lit("")))
    tags = F.concat(F.lit(" ["), F.col("w.src_tag"), F.lit("] = ["), F.col("w.tgt_feat"), F.lit("]"))
    text = F.concat("src", F.lit(" -> "), "tgt", F.when(F.col("total").isNotNull(), share).otherwise(""), F.when(F.col("w").isNotNull(), F.concat(head(" | head: "), tags)).otherwise(""))
    counts, _ = hidden_report(r, f)
    return _count_lines(counts, "hidden counts").unionByName(top.select("section", "line_no", text.alias("text")))


def combined_report(phrases: DataFrame, robust: DataFrame, form: DataFrame) -> DataFrame:
    """Overview and hidden selection in one: ``report, section, line_no, text``."""
    overview = render_report(phrases).withColumn("report", F.lit("overview"))
    return overview.unionByName(hidden_selection_report(robust, form).withColumn("report", F.lit("hidden selection"))).select("report", "section", "line_no", "text")


def hidden_report(robust: DataFrame, form: DataFrame, examples: int = 12) -> tuple[DataFrame, DataFrame]:
    """Counts of two sets of pairs ``src, tgt`` and up to ``examples`` of each part."""
    a = robust.select("src", "tgt").distinct().withColumn("a", F.lit(True))
    b = form.select("src", "tgt").distinct().withColumn("b", F.lit(True))
    part = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_robust").otherwise("only_form")
    joined = a.join(b, ["src", "tgt"], "full_outer").withColumn("part", part)
    counts = joined.agg(
        F.count("a").alias("robust"), F.count("b").alias("form"), F.count_if(F.col("part") == "both").alias("both"),
        F.count_if(F.col("part") == "only_robust").alias("only_robust"), F.count_if(F.col("part") == "only_form").alias("only_form"), F.count(F.lit(1)).alias("all"),
    )
    rank = F.row_number().over(Window.partitionBy("part").orderBy("src", "tgt"))
    return counts, joined.withColumn("rank", rank).where(F.col("rank") <= examples).select("part", "rank", "src", "tgt")
