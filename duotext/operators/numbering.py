"""Dense numbers in a global order, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written


def numbered(df: DataFrame, order: list[str | Column], name: str = "id") -> DataFrame:
    """``df`` with ``name``: its place from 0 in the order. Rows are dealt by ranges of the order and sorted in
    each; a range's first number is the size of the ranges before it, one row a partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(placed.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "numbered")
    sizes = sorted(placed.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).collect())
    starts, start = [], 0
    for r in sizes:
        starts.append((r["_range"], start - r["first"]))
        start += r["n"]
    offsets = df.sparkSession.createDataFrame(starts, "_range int, _shift long")
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_at") + F.col("_shift")).select(*df.columns, name)
