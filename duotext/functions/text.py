"""Token and marker columns: native expressions, plus Unicode normal forms, which Spark SQL does not have.

Corpus lines are space-joined tokens. ``#NB`` between tokens says that no blank stood there,
``#BLANK`` is an explicit blank.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Split symbols, the ones that only queries split, and the markers.
SYMBOLS = "' ! \" $ % & \\ ( ) . * + ; @ ^ ` _ | ~ - ] [ } { < > ? , / : =".split(" ")
WIDE_SYMBOLS = [*SYMBOLS, "€", "§", "»", "«"]
NO_BLANK, BLANK = "#NB", "#BLANK"
_SPACE = r"[\x20\x09-\x0D]"


def symbol_class(symbols: list[str]) -> str:
    """A regex class, the same for Java and RE2."""
    return "[" + "".join("\\" + s if s.isascii() else s for s in symbols) + "]"


def tokenise(col: Column, symbols: list[str] = SYMBOLS) -> Column:
    """Each symbol becomes a token with ``#NB`` on each side; blanks cancel ``#NB``; a last ``#NB`` goes."""
    out = F.regexp_replace(col, _SPACE, "\x02")
    out = F.regexp_replace(out, f"({symbol_class(symbols)})", "\x01$1\x01")
    out = F.regexp_replace(out, "[\x01\x02]*\x02[\x01\x02]*", " ")
    out = F.regexp_replace(out, "\x01+", f" {NO_BLANK} ")
    out = F.regexp_replace(out, " +", " ")
    return F.trim(F.regexp_replace(out, f"(^| ){NO_BLANK} ?$", ""))


def tokenise_query(col: Column) -> Column:
    """The search and fix path: Unicode compatibility form, more symbols, and blanks that count. A blank
    more than one is ``#BLANK``; next to each other, ``#NB`` and ``#BLANK`` cancel, as a stack does it, so
    of a run of both only the surplus of one kind stays. Blank text is empty."""
    text = F.regexp_replace(nfkc(col), f"({symbol_class(WIDE_SYMBOLS)})", f" {NO_BLANK} $1 {NO_BLANK} ")
    parts = F.transform(F.split(text, " "), lambda x: F.when(F.trim(x) == "", F.lit(BLANK)).otherwise(x))

    def step(acc, x):
        last = F.element_at(acc, F.when(F.size(acc) > 0, -1))
        cancels = ((last == NO_BLANK) & (x == BLANK)) | ((last == BLANK) & (x == NO_BLANK))
        return F.when(cancels, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(F.trim(col) == "", F.lit("")).otherwise(F.trim(F.regexp_replace(F.array_join(kept, " "), rf"{_SPACE}+", " ")))


def tokens(line: Column) -> Column:
    """The tokens of a line; of an empty one, none."""
    return F.filter(F.split(line, " "), lambda x: x != "")


def detokenise(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, rf"{_SPACE}*{NO_BLANK}{_SPACE}*", ""), rf"{_SPACE}*{BLANK}{_SPACE}*", " ")


def strip_markers(line: Column, every: bool = True) -> Column:
    """Remove the markers at both ends: all of them, or one."""
    many = "+" if every else ""
    marker = f"({NO_BLANK}|{BLANK})"
    return F.regexp_replace(F.regexp_replace(line, f"^({marker}( |$)){many}", ""), f"(( |^){marker}){many}$", "")


def content_tokens(arr: Column) -> Column:
    skip = F.array(*[F.lit(s) for s in (*WIDE_SYMBOLS, NO_BLANK, BLANK)])
    return F.filter(arr, lambda x: ~F.array_contains(skip, x))


def span_starts(arr: Column, sub: Column) -> Column:
    """Start positions of a token sub-list, descending."""
    last = F.size(arr) - F.size(sub)
    at = F.when((last >= 0) & (F.size(sub) > 0), F.sequence(last, F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.slice(arr, i + 1, F.size(sub)) == sub)


def occurrence_spans(arr: Column, sub: Column) -> Column:
    """``array<struct<start, end>>`` of each occurrence, in order."""
    return F.transform(F.reverse(span_starts(arr, sub)), lambda i: F.struct(i.alias("start"), (i + F.size(sub)).alias("end")))


def replace_tokens(arr: Column, sub: Column, fix: Column) -> Column:
    """Replace every occurrence, right to left; of overlapping ones those still there count."""

    def step(acc, i):
        here = F.slice(acc, i + 1, F.size(sub)) == sub
        after = F.slice(acc, i + F.size(sub) + 1, F.greatest(F.size(acc) - i - F.size(sub), F.lit(0)))
        return F.when(here, F.concat(F.slice(acc, F.lit(1), i), fix, after)).otherwise(acc)

    return F.aggregate(span_starts(arr, sub), arr, step)


def norm_token(col: Column) -> Column:
    """Lower case in the composed form, so that accents typed either way are the same."""
    return nfc(F.lower(F.trim(col)))


def is_single(col: Column) -> Column:
    return (F.trim(col) != "") & ~F.trim(col).rlike(_SPACE)


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode normalisation, which Spark SQL does not have; Python's in batches."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(col: Column) -> Column:
    """The composed form."""
    return _nfc(col)
