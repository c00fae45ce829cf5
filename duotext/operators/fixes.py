"""Fix propagation and augmentation: matching by joins, edits by folds inside each row.

Occurrences are a snapshot taken before a pass, so the rows that each fix touches are known before any
edit; a row's fixes are gathered, longest first, and folded over its tokens and links.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.points import repair_points
from ..functions.text import detokenise, span_starts, tokenise_query
from ..scratch import written
from .index import find_phrases, token_index
from .numbering import numbered
from .phrases import PAIR, extract_phrases, phrase_counts

ROW = ["project_id", "row_id"]


TEXTS = ("src_phrase", "src_fix", "tgt_phrase", "tgt_fix")


def tokenised(fixes: DataFrame) -> DataFrame:
    """Fixes with their texts as tokens, as the corpus has them; texts that are tokens stay the same. A
    fix that equals its phrase as typed is none."""
    same = {fix: F.when(F.col(fix) == F.col(phrase), F.lit("")).otherwise(F.coalesce(fix, F.lit(""))) for phrase, fix in (("src_phrase", "src_fix"), ("tgt_phrase", "tgt_fix"))}
    return fixes.withColumns(same).withColumns({c: tokenise_query(F.coalesce(c, F.lit(""))) for c in TEXTS})


def match_fix(bitext: DataFrame, occ: DataFrame, fixes: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``fix_id, project_id, row_id``: rows of a fix's phrase pair; for fixes without occurrences, rows
    that hold both phrases as whole tokens, found by the rarest token of both (``index`` is the corpus' token index, built
    here if it is not given)."""
    # Tokenising is a loop a text: written, as it is read three times.
    fixes = written(tokenised(fixes).select("id", "project_id", *TEXTS), "fix-tokens")
    known = fixes.join(occ.select("project_id", "row_id", *PAIR).distinct(), ["project_id", *PAIR]).select(F.col("id").alias("fix_id"), *ROW)
    known = written(known, "fix-known")
    rest = fixes.join(known.select(F.col("fix_id").alias("id")).distinct(), "id", "left_anti")
    found = find_phrases(written(token_index(bitext), "fix-index") if index is None else index, rest)
    return known.unionByName(found.select(F.col("id").alias("fix_id"), *ROW))


#: Bins of a hash of whose first three hexadecimal digits a row is told.
BIN_DIGITS = 3


def sample_rows(matches: DataFrame, fixes: DataFrame, seed: int = 0) -> DataFrame:
    """``percentage`` of each fix's rows, at least one, by a hash of the row: reruns agree. A fix taken
    whole needs no ranking. Of the others a histogram of the hash tells the bin in which the last row taken lies:
    bins before it are taken whole, and that bin alone, one in 4,096 of a fix's rows, is ranked."""
    pct = matches.join(fixes.select(F.col("id").alias("fix_id"), "percentage"), "fix_id")
    whole = pct.where("percentage >= 100")
    order = F.md5(F.concat_ws("/", F.col("row_id").cast("string"), F.lit(str(seed))))
    part = pct.where("percentage < 100").withColumn("hash", order).withColumn("bin", F.substring("hash", 1, BIN_DIGITS))
    # At most 4,096 rows a fix.
    bins = part.groupBy("fix_id", "percentage", "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("fix_id")
    upto = F.sum("n").over(w.orderBy("bin"))
    take = F.greatest(F.lit(1), F.floor(F.sum("n").over(w) * F.col("percentage") / 100)) - (upto - F.col("n"))
    bins = bins.select("fix_id", "bin", "n", take.alias("take")).where("take > 0")
    placed = part.drop("percentage").join(bins, ["fix_id", "bin"])
    rank = F.row_number().over(Window.partitionBy("fix_id", "bin").orderBy("hash", "row_id"))
    last = placed.where("take < n").withColumn("k", rank).where("k <= take")
    return whole.select("fix_id", *ROW).unionByName(placed.where("take >= n").select("fix_id", *ROW)).unionByName(last.select("fix_id", *ROW))


def _edit(state: Column, sub: Column, fix: Column, side: str, last_only: bool = False) -> Column:
    """Replace ``sub`` by ``fix`` in ``state.w``, right to left, and repair ``state.p`` at each place."""
    starts = span_starts(state["w"], sub)
    starts = F.slice(starts, 1, 1) if last_only else starts

    def step(acc, i):
        words = acc["w"]
        here = F.slice(words, i + 1, F.size(sub)) == sub
        behind = F.slice(words, i + F.size(sub) + 1, F.greatest(F.size(words) - i - F.size(sub), F.lit(0)))
        new = F.struct(F.concat(F.slice(words, F.lit(1), i), fix, behind).alias("w"), repair_points(acc["p"], i, F.size(sub), F.size(fix), side).alias("p"))
        return F.when(here, new).otherwise(acc)

    return F.aggregate(starts, state, step)


def apply_fixes(bitext: DataFrame, matches: DataFrame, fixes: DataFrame, side: str) -> DataFrame:
    """One pass. ``side`` tgt takes fixes of direction 0 and 1, src those of direction 0 and -1; fixes
    that change nothing or are empty on that side are skipped. Rows not touched stay as they are."""
    arr, key, phrase, fix = ("tgt", "t", "tgt_phrase", "tgt_fix") if side == "tgt" else ("src", "s", "src_phrase", "src_fix")
    fixes = tokenised(fixes)
    usable = fixes.where(F.col("direction").isin(0, 1 if side == "tgt" else -1) & (F.col(fix) != "") & (F.col(phrase) != "") & (F.col(fix) != F.col(phrase)))
    step = F.struct((-F.size(F.split(phrase, " "))).alias("order"), F.col("id"), F.split(phrase, " ").alias("sub"), F.split(fix, " ").alias("fix"))
    per_row = (
        matches.join(usable.select(F.col("id").alias("fix_id"), step.alias("step")), "fix_id")
        .groupBy(*ROW).agg(F.array_sort(F.collect_list("step")).alias("steps"))
    )
    state = F.struct(F.col(arr).alias("w"), F.col("points").alias("p"))
    folded = F.aggregate("steps", state, lambda acc, x: _edit(acc, x["sub"], x["fix"], key))
    out = bitext.join(per_row, ROW, "left").withColumn("done", F.when(F.col("steps").isNotNull(), folded))
    return out.withColumns({arr: F.coalesce("done.w", arr), "points": F.coalesce("done.p", "points")}).drop("steps", "done")


def augment(bitext: DataFrame, matches: DataFrame, fixes: DataFrame) -> DataFrame:
    """Copies of matched rows with the last match replaced on each side that has a fix; score 0; new
    row ids follow the project's largest, in order of fix and row."""
    usable = tokenised(fixes).where("src_fix != '' or tgt_fix != ''").select(F.col("id").alias("fix_id"), *TEXTS)
    matches = matches.join(usable.select("fix_id"), "fix_id", "left_semi")
    rows = matches.join(usable, "fix_id").join(bitext, ROW)
    for arr, key, phrase, fix in (("src", "s", "src_phrase", "src_fix"), ("tgt", "t", "tgt_phrase", "tgt_fix")):
        state = F.struct(F.col(arr).alias("w"), F.col("points").alias("p"))
        made = _edit(state, F.split(phrase, " "), F.split(fix, " "), key, last_only=True)
        rows = rows.withColumn("done", F.when((F.col(fix) != "") & (F.col(phrase) != ""), made).otherwise(state))
        rows = rows.withColumns({arr: F.col("done.w"), "points": F.col("done.p")}).drop("done")
    rows = numbered(rows, ["project_id", "fix_id", "row_id"], "_k")
    firsts = rows.groupBy("project_id").agg(F.min("_k").alias("_first"))  # one row a project
    last = bitext.groupBy("project_id").agg(F.max("row_id").alias("_last"))
    # Broadcast: joined by their project, all rows of one would meet in one task.
    new = rows.join(F.broadcast(firsts.join(last, "project_id")), "project_id")
    new = new.withColumns({"row_id": (F.col("_last") + F.col("_k") - F.col("_first") + 1).cast("long"), "score": F.lit(0.0)})
    return new.select(bitext.columns)


def refresh_phrases(occ: DataFrame, changed: DataFrame, **extraction) -> DataFrame:
    """Occurrences with those of changed rows extracted anew (``occ`` as :func:`extract_phrases` gives)."""
    kept = occ.join(changed.select("row_id").distinct(), "row_id", "left_anti")
    return kept.unionByName(extract_phrases(changed, **extraction).select(occ.columns))


def prune_phrases(phrases: DataFrame, occ: DataFrame) -> DataFrame:
    """Phrases that still occur, with their counts anew."""
    counts = phrase_counts(occ).select(*PAIR, F.col("num_occurrences").alias("_n"))
    return phrases.join(counts, PAIR).withColumn("num_occurrences", F.col("_n")).drop("_n")


def save_fixes(history: DataFrame, fixes: DataFrame) -> DataFrame:
    return history.unionByName(fixes.where("src_phrase != '' or tgt_phrase != ''"))


def merge_pending(fixes: DataFrame) -> DataFrame:
    """Of fixes alike in source phrase, target fix and direction the last one."""
    key = ["src_phrase", "tgt_fix", "direction"]
    latest = F.max(F.struct("id", *[c for c in fixes.columns if c not in (*key, "id")]))
    return fixes.groupBy(key).agg(latest.alias("f")).select(*key, "f.*").select(fixes.columns)


def list_fixes(history: DataFrame, project_id: int) -> DataFrame:
    """A project's fixes as they are read: texts without markers."""
    rows = history.where(F.col("project_id") == project_id)
    return rows.withColumns({c: detokenise(F.col(c)) for c in TEXTS})


def count_fixes(history: DataFrame) -> DataFrame:
    return history.groupBy("project_id").agg(F.count(F.lit(1)).alias("fixes"))


class Applied(NamedTuple):
    """A project after its fixes."""

    bitext: DataFrame
    occ: DataFrame
    phrases: DataFrame
    history: DataFrame


def apply_changes(bitext: DataFrame, occ: DataFrame, fixes: DataFrame) -> DataFrame:
    """Augment, then the forward and the reverse pass over the same matches."""
    # Read by the augmentation and both passes.
    matches = written(sample_rows(match_fix(bitext, occ, fixes), fixes), "fix-matches")
    aug = fixes.where("type = 'augment'")
    fix = fixes.where("coalesce(type, 'fix') = 'fix'")
    of = lambda f: matches.join(f.select(F.col("id").alias("fix_id")), "fix_id", "left_semi")
    grown = bitext.unionByName(augment(bitext, of(aug), aug))
    return apply_fixes(apply_fixes(grown, of(fix), fix, "tgt"), of(fix), fix, "src")


def apply_project(bitext: DataFrame, occ: DataFrame, phrases: DataFrame, fixes: DataFrame, history: DataFrame, **extraction) -> Applied:
    """All of it: rows edited, occurrences of changed and new rows extracted anew, phrases counted anew
    (hidden ones stay hidden, phrases without occurrences go), fixes saved."""
    edited = written(apply_changes(bitext, occ, fixes), "fixed-rows")
    old = bitext.select(*ROW, "src", "tgt", "points")
    changed = edited.join(old, [*ROW, "src", "tgt", "points"], "left_anti")
    rows = edited.select("row_id", "project_id")
    # Fresh occurrences get their project from their row.
    fresh = refresh_phrases(occ.select("row_id", *[c for c in occ.columns if c not in ("row_id", "project_id")]), changed, **extraction).join(rows, "row_id")
    fresh = written(fresh.select(occ.columns), "fixed-occurrences")
    counts = fresh.groupBy("project_id", *PAIR, "row_id").agg(F.max("direction").alias("direction")).groupBy("project_id", *PAIR).agg(F.max("direction").alias("direction"), F.count(F.lit(1)).alias("num_occurrences"))
    ignored = phrases.where("ignore").select("project_id", *PAIR).distinct().withColumn("_ignored", F.lit(True))
    counted = counts.join(ignored, ["project_id", *PAIR], "left").withColumn("ignore", F.coalesce("_ignored", F.lit(False))).drop("_ignored")
    return Applied(edited, fresh, counted, save_fixes(history, fixes))
