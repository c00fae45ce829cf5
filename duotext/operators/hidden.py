"""Hidden phrases: unions, anti-joins and the combination rule. ``tgt_phrase`` '' means any target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import detokenise
from .numbering import numbered

KEY = ["project_id", "src_phrase", "tgt_phrase"]


def hide(hidden: DataFrame, more: DataFrame) -> DataFrame:
    """Add entries that are not there yet; ids follow the largest one, in the order of the entries."""
    new = numbered(more.select(KEY).distinct().join(hidden, KEY, "left_anti"), KEY, "n")
    last = hidden.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    return hidden.select("id", *KEY).unionByName(new.select((F.col("n") + F.lit(last + 1)).cast("long").alias("id"), *KEY))


def unhide(hidden: DataFrame, less: DataFrame) -> DataFrame:
    return hidden.join(less.select(KEY), KEY, "left_anti")


def clear_hidden(hidden: DataFrame, project_id: int) -> DataFrame:
    return hidden.where(F.col("project_id") != project_id)


def dedupe_hidden(hidden: DataFrame) -> DataFrame:
    """The smallest id of each entry; the minimum is combined before the shuffle."""
    return hidden.groupBy(KEY).agg(F.min("id").alias("id")).select("id", *KEY)


def all_ignored(hidden: DataFrame, phrases: DataFrame) -> DataFrame:
    return hidden.select(KEY).unionByName(phrases.where("ignore").select(KEY)).distinct()


def visible(phrases: DataFrame, hidden: DataFrame) -> DataFrame:
    """Phrases that no entry hides, whatever the case. Two equi anti-joins instead of one condition
    with OR, which would compare all with all."""
    low = lambda df: df.select("project_id", F.lower("src_phrase").alias("_s"), F.lower("tgt_phrase").alias("_t"))
    pairs = low(hidden.where("tgt_phrase != ''")).distinct().withColumnRenamed("project_id", "_p")
    anys = low(hidden.where("tgt_phrase = ''")).select(F.col("project_id").alias("_p"), "_s").distinct()
    mine = (phrases["project_id"], F.lower(phrases["src_phrase"]), F.lower(phrases["tgt_phrase"]))
    out = phrases.join(pairs, (mine[0] == pairs["_p"]) & (mine[1] == pairs["_s"]) & (mine[2] == pairs["_t"]), "left_anti")
    return out.join(anys, (out["project_id"] == anys["_p"]) & (F.lower(out["src_phrase"]) == anys["_s"]), "left_anti")


def _shown(c: str):
    return F.lower(F.trim(detokenise(F.col(c))))


def apply_hidden(phrases: DataFrame, hidden: DataFrame) -> DataFrame:
    """``ignore`` set where an entry hides the phrase in its shown form."""
    marks = hidden.select(F.col("project_id"), _shown("src_phrase").alias("_s"), _shown("tgt_phrase").alias("_t")).where("_s != ''").distinct()
    pairs = marks.where("_t != ''").withColumn("_pair", F.lit(True))
    anys = marks.where("_t = ''").select("project_id", "_s").withColumn("_any", F.lit(True))
    out = phrases.withColumn("_s", _shown("src_phrase")).withColumn("_t", _shown("tgt_phrase"))
    out = out.join(pairs, ["project_id", "_s", "_t"], "left").join(anys, ["project_id", "_s"], "left")
    flag = F.col("ignore") | F.coalesce("_pair", F.lit(False)) | F.coalesce("_any", F.lit(False))
    return out.withColumn("ignore", flag).drop("_s", "_t", "_pair", "_any")


def combination_rule(phrases: DataFrame, hidden: DataFrame) -> DataFrame:
    """``ignore`` also where a source of several words consists of hidden single words only."""
    words = hidden.where("tgt_phrase = ''").select("project_id", _shown("src_phrase").alias("word")).where("word != '' and not contains(word, ' ')").distinct()
    sources = phrases.select("project_id", "src_phrase").distinct()
    toks = F.filter(F.split(_shown("src_phrase"), r"\s+"), lambda x: x != "")
    several = sources.withColumn("toks", toks).where("size(toks) > 1").select("project_id", "src_phrase", F.explode("toks").alias("word"))
    known = several.join(words.withColumn("known", F.lit(True)), ["project_id", "word"], "left")
    full = known.groupBy("project_id", "src_phrase").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"))
    out = phrases.join(full, ["project_id", "src_phrase"], "left")
    return out.withColumn("ignore", F.col("ignore") | F.coalesce("all_known", F.lit(False))).drop("all_known")


def hidden_union(robust: DataFrame, form: DataFrame) -> DataFrame:
    """Pairs of both sets once, robust ones first by total."""
    ranked = robust.select("src", "tgt", F.lit(0).alias("origin"), F.col("total").cast("long").alias("total")).unionByName(
        form.select("src", "tgt", F.lit(1).alias("origin"), F.lit(0).cast("long").alias("total"))
    )
    best = ranked.groupBy("src", "tgt").agg(F.min(F.struct("origin", (-F.col("total")).alias("neg"))).alias("b"))
    return best.select("src", "tgt", F.col("b.origin").alias("origin"), (-F.col("b.neg")).alias("total"))


def pair_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``both, only_left, only_right, union_size`` of two sets of pairs."""
    x = a.select("src", "tgt").distinct().withColumn("x", F.lit(1))
    y = b.select("src", "tgt").distinct().withColumn("y", F.lit(1))
    both = F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull())
    return x.join(y, ["src", "tgt"], "full_outer").agg(
        both.alias("both"), (F.count("x") - both).alias("only_left"), (F.count("y") - both).alias("only_right"), F.count(F.lit(1)).alias("union_size")
    )


def list_hidden(hidden: DataFrame, start: int = 0, n: int = 50) -> DataFrame:
    return hidden.orderBy(F.desc("id")).offset(start).limit(n)
