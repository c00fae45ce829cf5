"""Embedding whitening with MLlib's BlockMatrix.

1. Entries are scaled to integers. The fit list holds each distinct vector once, so that copies don't
   weigh: its size and its sums per dimension are exact.
2. Rows get an index and are centred; the centred fit rows become a BlockMatrix of ``block_rows`` rows a block.
3. Scatter: the transposed matrix times the matrix. A plain product would send all blocks to the one task of its
   only result block. So the left side puts its blocks into ``slabs`` block columns, in turn: the product has as
   many result blocks, each the scatter of its rows, made in its own task, and a tree adds them up.
4. The scatter has ``dims`` times ``dims`` numbers, whatever the number of rows: its eigenvectors are found on the
   driver (LAPACK, through ``numpy.linalg.eigh``).
5. The centred rows times the whitening matrix (``dims`` times ``components``) gives all rows' projections.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out, as are vectors of
another length than ``dims`` (by default the length that most rows have; of equals the larger); rows that repeat
are projected each but fitted once; null ids are kept; components whose eigenvalue is not above rounding error
(rank-deficient lists, fewer rows than components) have no rows; an empty table gives an empty result; extra columns
are ignored. Signs: the component's entry of the largest size is positive. A deviation beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written


def scaled_rows(vectors: DataFrame, id_col: str, vector_col: str, dims: int | None, scale: int) -> tuple[DataFrame, int]:
    """``vec_id, x`` of the rows that remain, and their length."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(good).select(F.col(f"`{id_col}`").alias("vec_id"), F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("x"))
    if dims is None:
        most = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        dims = most.size if most else 0
    return rows.where(F.size("x") == dims), dims


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` with an ``index`` from 0 without gaps: its number in its partition, behind the partitions before."""
    at = F.monotonically_increasing_id()
    rows = written(rows.withColumn("at", at), "white-rows")
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    # One row a partition.
    starts, start = [], 0
    for r in sorted(counts.collect()):
        starts.append((r.part, start))
        start += r.n
    offsets = rows.sparkSession.createDataFrame(starts, "part long, start long")
    return rows.join(F.broadcast(offsets), part == F.col("part")).select((F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("index"), "vec_id", "x")


def row_matrix(rows: DataFrame, mean: np.ndarray, n_rows: int, block_rows: int) -> BlockMatrix:
    """The rows ``index, x`` less the mean, in blocks. An index without a row is a row of zeros."""
    centre = F.array(*[F.lit(float(m)) for m in mean])
    centred = rows.select("index", array_to_vector(F.zip_with("x", centre, lambda a, b: a.cast("double") - b)).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), n_rows, len(mean)).toBlockMatrix(block_rows, len(mean))


def scatter(matrix: BlockMatrix, dims: int, slabs: int) -> np.ndarray:
    """The matrix transposed times itself, by ``slabs`` result blocks."""
    dealt = matrix.blocks.map(lambda b: ((b[0][0], b[0][0] % slabs), b[1]))
    wide = BlockMatrix(dealt, matrix.rowsPerBlock, dims, matrix.numRows(), dims * slabs)
    product = wide.transpose().multiply(matrix)
    return product.blocks.map(lambda b: b[1].toArray()).treeReduce(np.add)


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    above = values > max(values.max(initial=0.0), 0.0) * len(covariance) * np.finfo(float).eps
    values, vectors = values[above], vectors[:, above]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors * np.where(signs == 0, 1, signs)


def whitened_rows(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256, dims: int | None = None, block_rows: int = 1024
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component."""
    spark = vectors.sparkSession
    rows, dims = scaled_rows(vectors, id_col, vector_col, dims, scale)
    id_type = dict(rows.dtypes)["vec_id"]
    empty = spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = written(indexed(rows), "white-indexed")
    n_rows = rows.count()
    if not n_rows or not dims:
        return empty
    # The first row of each distinct vector stands for it; copies are combined before the shuffle.
    fit = written(rows.groupBy("x").agg(F.min("index").alias("index")), "white-fit")
    n = fit.count()
    totals = fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    sums = [0] * dims
    for r in totals.collect():  # a row a dimension
        sums[r.pos] = int(r.total)
    mean = np.array([s / n for s in sums])

    slabs = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // block_rows)))
    covariance = scatter(row_matrix(fit, mean, n_rows, block_rows), dims, slabs) / n
    values, vectors_ = principal(covariance, components)
    k = len(values)
    if not k:
        return empty
    whitening = vectors_ / np.sqrt(values)
    block = DenseMatrix(dims, k, whitening.ravel(order="F").tolist())
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), dims, k, dims, k)
    projected = row_matrix(rows.select("index", "x"), mean, n_rows, block_rows).multiply(right).toIndexedRowMatrix().rows
    projected = projected.map(lambda r: (int(r.index), r.vector.toArray().tolist()))
    projected = written(spark.createDataFrame(projected, "index long, w array<double>"), "white-projected")

    # Each product of two components, over the fit list; it was centred before.
    pairs = [(a, b) for a in range(k) for b in range(a, k)]
    found = projected.join(fit.select("index"), "index").agg(*[F.avg(F.col("w")[a]).alias(f"m{a}") for a in range(k)], *[F.avg(F.col("w")[a] * F.col("w")[b]).alias(f"p{a}_{b}") for a, b in pairs]).first()
    error = max(abs(found[f"p{a}_{b}"] - found[f"m{a}"] * found[f"m{b}"] - (a == b)) for a, b in pairs)
    trace = float(np.trace(covariance))
    off = F.zip_with("x", F.array(*[F.lit(s) for s in sums]), lambda a, s: a * F.lit(n) - s)
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda acc, d: acc + d * d)
    each = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(float(v) / trace).alias("explained")) for i, v in enumerate(values)])
    out = rows.join(projected, "index").select("vec_id", "w", deviation.alias("deviation"), F.explode(each).alias("c"))
    out = out.select(
        "vec_id", F.col("c.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.element_at("w", F.col("c.component")).alias("whitened"), F.col("c.explained").alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
    out = written(out, "white-result")
    discard(rows, fit, projected)
    return out


def query_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
