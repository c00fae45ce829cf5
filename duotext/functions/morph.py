"""Morphology tags of two lexicons as structs, and their compatibility as a join condition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Determiners and prepositions before a head, tag names and their counterparts.
DETERMINERS = (
    "il lo la i gli le un uno una del dello della dei degli delle al allo alla ai agli alle "
    "nel nello nella nei negli nelle sul sullo sulla sui sugli sulle da di a in su per con tra fra"
).split()
MOODS = ("ind", "con", "cnd", "imp", "inf", "part", "ger")
ELIDED = "l un una lo la d c s m t".split()
LETTERS = "a-zàèéìòóù"


def _has(parts: Column, *names: str) -> Column:
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))


def parse_src_tag(tag: Column) -> Column:
    """``pos.gender.number…`` up to the first ``-`` or ``_``: struct of base, pos, gender, number, mood,
    person; verbs have their mood second and person and number as in ``2p``."""
    base = F.trim(F.regexp_extract(F.trim(tag), "^[^-_]*", 0))
    parts = F.filter(F.transform(F.split(base, r"\."), lambda x: F.trim(x)), lambda x: x != "")
    pos = F.get(parts, F.lit(0))
    verb = pos == "v"
    pn = F.get(F.filter(parts, lambda x: x.rlike(r"^\d[ps]$")), F.lit(0))
    number = F.when(_has(parts, "sing"), "sing").when(_has(parts, "plur"), "plur")
    return F.when(
        F.size(parts) > 0,
        F.struct(
            base.alias("base"),
            pos.alias("pos"),
            F.when(_has(parts, "femm"), "f").when(_has(parts, "masch"), "m").alias("gender"),
            F.when(verb & pn.isNotNull(), F.when(pn.endswith("p"), "plur").otherwise("sing")).otherwise(number).alias("number"),
            F.when(verb, F.get(parts, F.lit(1))).alias("mood"),
            F.when(verb, F.substring(pn, 1, 1).cast("int")).alias("person"),
        ),
    )


def parse_tgt_feat(feat: Column) -> Column:
    """``POS-G:infl+infl``: struct of feat, pos, gender, number, mood, person."""
    left = F.split(F.split_part(feat, F.lit(":"), F.lit(1)), "-")
    infl = F.filter(F.split(F.split_part(feat, F.lit(":"), F.lit(2)), r"\+"), lambda x: x != "")
    pos = left[0]
    verb = pos == "VER"
    return F.struct(
        feat.alias("feat"),
        pos.alias("pos"),
        F.when(_has(infl, "m"), "m").when(_has(infl, "f"), "f").when(_has(left, "M"), "m").when(_has(left, "F"), "f").alias("gender"),
        F.when(_has(infl, "p"), "plur").when(_has(infl, "s"), "sing").alias("number"),
        F.when(verb, F.get(F.filter(infl, lambda x: x.isin(*MOODS)), F.lit(0))).alias("mood"),
        F.when(verb, F.get(F.filter(infl, lambda x: x.rlike("^[123]$")), F.lit(0)).cast("int")).alias("person"),
    )


def clean_tgt_token(tok: Column) -> Column:
    """Lower case; no characters but letters at either end; no elided article before the word."""
    out = F.lower(F.trim(tok))
    out = F.regexp_replace(F.regexp_replace(out, f"^[^{LETTERS}]+", ""), f"[^{LETTERS}]+$", "")
    return F.regexp_replace(out, f"^({'|'.join(ELIDED)})['’]", "")


def head_token(phrase: Column) -> Column:
    """A single token, or the one behind one or two determiners; else null."""
    toks = F.filter(F.split(F.trim(phrase), r"\s+"), lambda x: x != "")
    det = lambda i: F.lower(F.get(toks, F.lit(i))).isin(*DETERMINERS)
    n = F.size(toks)
    at = F.when(n == 1, 0).when((n == 2) & det(0), 1).when((n == 3) & det(0) & det(1), 2)
    return clean_tgt_token(F.get(toks, at))


def morph_compatible(a: Column, b: Column) -> Column:
    """Source tag ``a`` against target feature ``b``. Nouns and adjectives need gender and number and
    both equal; of verbs, what both sides know must be equal. Other classes never match."""
    nominal = a["gender"].isNotNull() & a["number"].isNotNull() & (a["gender"] == b["gender"]) & (a["number"] == b["number"])
    mood = F.when(a["mood"] == "imper", "imp").otherwise(a["mood"])
    equal = lambda x, y: x.isNull() | y.isNull() | (x == y)
    verb = equal(mood, b["mood"]) & equal(a["person"], b["person"]) & equal(a["number"], b["number"])
    match = (
        F.when(a["pos"] == "agg", b["pos"].isin("ADJ", "VER") & nominal)
        .when(a["pos"] == "sost", (b["pos"] == "NOUN") & nominal)
        .when(a["pos"] == "v", (b["pos"] == "VER") & verb)
    )
    return F.coalesce(match, F.lit(False))
