"""Tables that cut lineage, kept in the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a local one only where a local session names none (tests). On a cluster it must
    be named: driver and executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("duotext.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("duotext.scratch.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; no two calls return the same one."""
    return f"{scratch_root(spark)}/duotext-{uuid.uuid4().hex[:12]}-{name}"


#: Spark's setting that removes a query's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """What a table cuts the lineage of needs its shuffle files no longer."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with _shuffles_removed(df.sparkSession):
        writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], dealt: bool = False) -> DataFrame:
    """Like :func:`written`, bucketed and sorted by ``keys`` with as many buckets as shuffles have
    partitions: joins and groupings by the keys need no exchange of this table. Rows are dealt by the
    keys first, for one file a bucket; ``dealt`` says that they are, by a grouping or a join."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df if dealt else df.repartition(buckets, *keys)
    table = f"duotext_{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
    writer = df.write.format("parquet").option("path", scratch_path(spark, name)).option("compression", "zstd")
    with _shuffles_removed(spark):
        writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    out = spark.table(table)
    out.table_name = table
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` or :func:`bucketed` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        root = scratch_root(spark).removeprefix("file://")
        dirs = {f[: f.index("/", f.index("duotext-"))] for f in df.inputFiles() if "/duotext-" in f and root in f}
        for d in dirs:
            path = spark._jvm.org.apache.hadoop.fs.Path(d)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if hasattr(df, "table_name"):
            spark.sql(f"drop table if exists {df.table_name}")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out before each of them is expanded many times: a small file is one partition, and
    expanding it there would be one task. The rows dealt are small against what they become."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
