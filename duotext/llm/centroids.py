"""Centroid clustering: integer k-means whose nearest centroid is found by a Walsh-Hadamard progressive search.

Components are scaled to integers, so distances, sums and centroids are exact. The Walsh-Hadamard transform
of integers is made of sums and differences, so it is exact too, and it multiplies every squared distance
by the number of components. Its coefficients are ordered from coarse to fine (by sign changes): the
squared differences of the first few already hold most of a distance, and what is summed up so far never
exceeds the whole. A search sums up the coarse coefficients of all centroids, finishes the best of
them, and drops each centroid whose sum is strictly worse than that whole distance; the others go on
to the next coefficients, and who is left after the last one has a whole distance. Ties go to the smaller number.

A round is one pass: each task adds up its vectors by centroid, so what is shuffled and what reaches the driver
are at most ``k`` times ``dims`` sums. Centroids (``k`` times ``dims`` integers) travel with the
tasks. A centroid that is nearest to a third of all vectors is no hot key, as its vectors are added up where they are.

Defined results: vectors that are null, of another length, or hold a null or non-finite component are left out;
vectors that repeat count as often as they occur; rows of one id that differ are different vectors, and
first centroids of one id are ordered by their components; null ids hash as ``null``; with fewer than ``k`` vectors there are fewer
centroids; an empty table gives an empty result; extra columns are ignored. A scaled component beyond
2**24 either way is an error, as squared distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written

LARGEST = 1 << 24


@cache
def walsh_order(dims: int) -> np.ndarray:
    """The rows of the Hadamard matrix by their sign changes."""
    rows = np.ones((1, 1), np.int64)
    while len(rows) < dims:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1), kind="stable")


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of each row of an integer matrix, coarse coefficients first."""
    n, dims = x.shape
    out, half = x.astype(np.int64), 1
    while half < dims:
        pairs = out.reshape(n, dims // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, dims)
        half *= 2
    return out[:, walsh_order(dims)]


def levels(dims: int) -> list[slice]:
    """Coarse to fine: 4 coefficients, then as many as before at each level."""
    ends = [min(4, dims)]
    while ends[-1] < dims:
        ends.append(min(dims, 2 * ends[-1]))
    return [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed vector the number of its nearest transformed centroid and the squared distance
    of the originals."""
    dims = vectors.shape[1]
    first, *finer = levels(dims)
    sums = ((vectors[:, None, first] - centroids[None, :, first]) ** 2).sum(axis=2)
    guess = sums.argmin(axis=1)
    bound = ((vectors - centroids[guess]) ** 2).sum(axis=1)
    row, of = np.nonzero(sums <= bound[:, None])
    so_far = sums[row, of]
    for level in finer:
        so_far = so_far + ((vectors[row, level] - centroids[of, level]) ** 2).sum(axis=1)
        left = so_far <= bound[row]
        row, of, so_far = row[left], of[left], so_far[left]
    # By distance, then by number; the first of each row is its nearest.
    order = np.lexsort((of, so_far, row))
    row, of, so_far = row[order], of[order], so_far[order]
    at = np.searchsorted(row, np.arange(len(vectors)))
    return of[at], so_far[at] // dims


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


#: Vectors that a task holds against all centroids at a time.
ROWS = 2048


def _searched(batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
    """Batches of at most ``ROWS`` rows with their vectors, nearest centroids and distances."""
    dims = centroids.shape[1]
    known = walsh_hadamard(centroids)
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            x = _matrix(part.column("x"), dims)
            yield part, x, *nearest(walsh_hadamard(x), known)


def _sums(centroids: np.ndarray):
    """Per task, centroid and component: the number and the sum of its vectors."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x, of, _ in _searched(batches, centroids):
            counts += np.bincount(of, minlength=k)
            np.add.at(sums, of, x)
        held = np.flatnonzero(counts)
        cluster, dim = np.repeat(held, dims), np.tile(np.arange(dims), len(held))
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(counts[cluster], pa.int64()), pa.array(sums[cluster, dim], pa.int64())],
            ["cluster", "dim", "n", "total"],
        )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, of, distance in _searched(batches, centroids):
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(of, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def scaled_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, x`` of the vectors that are kept."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    inside = F.forall(v, lambda c: F.abs(F.floor(c * scale)) <= LARGEST)
    x = F.when(inside, F.transform(v, lambda c: F.floor(c * scale).cast("long"))).otherwise(F.raise_error(F.lit(f"a scaled component lies beyond {LARGEST}")))
    return vectors.where((F.size(v) == dims) & finite).select(F.col(f"`{id_col}`").alias("vec_id"), x.alias("x"))


def first_centroids(kept: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return np.array([r.x for r in kept.select("x", key.alias("key")).orderBy("key", "x").limit(k).collect()], np.int64)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid at the floor of its vectors' mean; one without vectors stays."""
    sums = kept.select("x").mapInArrow(_sums(centroids), "cluster int, dim int, n long, total long")
    out = centroids.copy()
    # At most a row for each component of each centroid.
    for r in sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2"
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` of each vector that is kept, and the final centroids as an integer
    matrix. ``dims`` is a power of two."""
    if dims < 1 or dims & (dims - 1):
        raise ValueError("dims must be a power of two")
    kept = written(scaled_vectors(vectors, id_col, vector_col, dims, scale), "centroids-vectors")
    id_type = dict(kept.dtypes)["vec_id"]
    schema = f"vec_id {id_type}, cluster int, distance long"
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    out = written(kept.mapInArrow(_assigned(centroids), schema), "centroids-clusters")
    discard(kept)
    return out, centroids


def query_centroids(spark, sf_dir: str) -> DataFrame:
    found, centroids = centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # At most a row for each centroid.
    totals = {r.cluster: int(r.d) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    known = [(c, d, sum(totals.values()), sha[c]) for c, d in totals.items()]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """Rounds as CTEs: centroids c0 …, assignments a0 …, one row a component of a centroid."""
    out = """
with v as (
  select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
c0 as (select row_number() over (order by sha256('2:' || vec_id::varchar)) - 1 as cluster, x as c from v qualify cluster < 40)"""
    for i in range(6):
        out += f""",
d{i} as (select vec_id, any_value(x) as x, min({{'d': d, 'k': cluster}}) as b from (
  select vec_id, x, cluster, list_sum(list_transform(range(1, 65), lambda j: (x[j] - c[j]) * (x[j] - c[j])))::bigint as d from v cross join c{i}) group by vec_id)"""
        if i < 5:
            out += f""",
m{i} as (select k as cluster, list(m order by j) as m from (
  select b.k as k, j, (sum(x[j]) - ((sum(x[j]) % count(*)) + count(*)) % count(*)) // count(*) as m from d{i}, (select unnest(range(1, 65)) as j) group by 1, 2) group by 1),
c{i + 1} as (select cluster, coalesce(m, c)::bigint[] as c from c{i} left join m{i} using (cluster))"""
    return out + """
select vec_id, b.k::int as cluster, b.d as distance, sum(b.d) over (partition by b.k)::bigint as cluster_inertia, sum(b.d) over ()::bigint as inertia,
       sha256(array_to_string(c, ',')) as centroid_sha256
from d5 join c5 on c5.cluster = b.k
"""


SQL_CENTROIDS = _sql()
