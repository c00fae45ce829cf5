"""What several operators share: the ASCII blanks of the contracts and safe column names."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The blanks of ``[\x20\x09-\x0D]`` and the letters that are lower-cased.
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def text_of(col: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def without_blanks(col: Column) -> Column:
    """Delete every ASCII blank."""
    return F.translate(col, BLANKS, "")


#: A key is hot if it holds more than one in ``HOT`` of all rows: fewer than ``HOT`` keys can be.
HOT = 1000


def attach(rows: DataFrame, table: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of ``table``, null where it has no row for their key.

    ``table`` has one row a key; its column ``size`` says how many of ``rows`` the key has. A hot key goes
    to all tasks: fewer than ``HOT`` rows are broadcast, whatever the data. Its rows, and those
    with a null key, are dealt over all tasks; the other keys meet in a shuffle, at every size. A key whose other
    columns are all null is there to be known as hot only.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * F.lit(HOT) > F.lit(total)
    values = F.struct(*[c for c in table.columns if c not in on and c != size])
    many = table.where(hot).select(*on, values.alias("_hot"))
    some = reduce(or_, [F.col(c).isNotNull() for c in table.columns if c not in on and c != size])
    few = table.where(~hot & some).select(*on, F.lit(0).alias("_salt"), values.alias("_few"))
    plain = F.col("_hot").isNull()
    for c in on:
        plain = plain & F.col(c).isNotNull()
    salt = F.when(plain, 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(4096)) + 1).cast("int")
    joined = rows.join(F.broadcast(many), on, "left").withColumn("_salt", salt).join(few.hint("merge"), [*on, "_salt"], "left")
    found = F.coalesce("_hot", "_few")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in table.columns if c not in on and c != size])


def only_once(df: DataFrame, id_col: str) -> DataFrame:
    """Drop rows that repeat another row in every column. The shuffle of whole rows is paid
    only where an id occurs twice, which one narrow aggregate tells."""
    n, ids = df.agg(F.count(F.lit(1)), F.count_distinct(F.struct(F.col(f"`{id_col}`")))).first()
    return df if n == ids else df.dropDuplicates()
