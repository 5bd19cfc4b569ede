"""Centroid clustering of integer vectors with partial-distance search: dimensions of high variance first, centroids abandoned once they are over the best so far."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, stored, table, without_clashes

#: Components saturate here, so that squared distances of 64 dimensions fit 64 bits.
MOST = 1 << 27
#: Dimensions that are added at once, and vectors that are compared at once.
STEP, ROWS = 8, 8192


def quantised(vectors: DataFrame, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors with exactly dim components, none null or non-finite; v holds floor(scale * x), x as double, within -MOST to MOST."""
    x = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = (F.size(vec_col) == dim) & F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(x, lambda x: F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), x * float(scale)))).cast("int"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    return b.column("v").flatten().to_numpy().reshape(b.num_rows, dim)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, its squared distance) of every row, exact, the smaller number on ties; and how many squared differences were added.

    Differences are added over the dimensions in the given order, some at a time. The centroid that is nearest after the first of them is finished at once and sets the best so far; of the others those
    strictly above it are abandoned after each step. What is left has been through all dimensions."""
    n, k = len(x), len(centroids)
    x, c = x[:, order].astype(np.int64), centroids[:, order].astype(np.int64)
    dim = x.shape[1]
    part = np.stack([((x[:, :step] - c[j, :step]) ** 2).sum(1) for j in range(k)], 1)
    first = part.argmin(1)
    best = part[np.arange(n), first] + ((x[:, step:] - c[first, step:]) ** 2).sum(1)
    done = np.full((n, k), np.iinfo(np.int64).max)
    done[np.arange(n), first] = best
    part[np.arange(n), first] = np.iinfo(np.int64).max
    i, j = np.nonzero(part <= best[:, None])
    sums, added = part[i, j], n * k * min(step, dim) + n * max(0, dim - step)
    for at in range(step, dim, step):
        sums = sums + ((x[i, at : at + step] - c[j, at : at + step]) ** 2).sum(1)
        added += len(i) * (min(dim, at + step) - at)
        on = sums <= best[i]
        i, j, sums = i[on], j[on], sums[on]
    done[i, j] = sums
    which = done.argmin(1)  # the first of ties
    return which, done[np.arange(n), which], added


def _moments(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row a task: how many vectors, and the sums of each dimension and its squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(dim), np.zeros(dim)
        for b in batches_of(batches, ROWS):
            x = _matrix(b, dim).astype(float)
            n, sums, squares = n + len(x), sums + x.sum(0), squares + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tolist()]), pa.array([squares.tolist()])], ["n", "sums", "squares"])

    return run


def _totals(dim: int, centroids: np.ndarray, order: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each task and centroid: how many vectors are nearest to it, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        n, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches_of(batches, ROWS):
            x = _matrix(b, dim)
            which, _, _ = nearest(x, centroids, order)
            n += np.bincount(which, minlength=k)
            for j in np.unique(which):
                sums[j] += x[which == j].sum(0, dtype=np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(dim: int, centroids: np.ndarray, order: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, ROWS):
            which, distance, _ = nearest(_matrix(b, dim), centroids, order)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(which, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every vector that takes part, the final centroids as whole numbers).

    Centroids start as the k vectors with the smallest sha256 of `seed:vec_id`. Each round gives every vector to its nearest centroid (squared Euclidean distance, the smaller number on
    ties) and moves each centroid to the floor of its vectors' mean; a centroid without vectors stays. Then vectors are given once more.

    Vectors that are null, of another length, or with null or non-finite components take no part. Null ids hash like an id without digits. Rows that repeat an id are vectors each; their order
    among the first centroids is that of their components. Components beyond MOST saturate. With fewer than k vectors there are fewer centroids; an empty table gives an empty result
    and no centroid. Further columns aren't read.

    Only k centroids and sums of k x dim numbers a task leave the tasks; vectors stay where they are, in as many passes as there are rounds, without a shuffle. A cluster that holds most of the
    rows costs no task more than another.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, dim, scale, id_col, vec_col), "vectors")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.orderBy(start, "v").limit(k).collect()  # k rows
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dim), np.int64)
    centroids = np.array([r.v for r in first], np.int64)
    moments = rows.select("v").mapInArrow(_moments(dim), "n long, sums array<double>, squares array<double>")
    each = [F.sum(F.get(c, i)).alias(f"{c}{i}") for c in ("sums", "squares") for i in range(dim)]
    m = moments.agg(F.sum("n").alias("n"), *each).first()
    variance = np.array([m[f"squares{i}"] / m.n - (m[f"sums{i}"] / m.n) ** 2 for i in range(dim)])
    order = np.argsort(-variance, kind="stable")
    for _ in range(rounds):
        totals = rows.select("v").mapInArrow(_totals(dim, centroids, order), "cluster int, n long, sums array<long>")
        sums = [F.sum(F.get("sums", i).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
        moved = centroids.copy()
        for r in totals.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # k rows
            moved[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
        centroids = moved
    return rows.mapInArrow(_assigned(dim, centroids, order), "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned plus the distances summed over the row's cluster and over all, and the hash of its centroid. Sums beyond 64 bits saturate."""
    spark = assigned.sparkSession
    assigned = stored(without_clashes(assigned, "cluster_inertia", "inertia", "centroid_sha256"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_sum")).collect()  # a row for each centroid
    total, most = sum(int(r["_sum"]) for r in sums), (1 << 63) - 1
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    known = [(r.cluster, min(int(r["_sum"]), most), min(total, most), digest[r.cluster]) for r in sums]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster")  # k rows


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = with_inertia(*clustered(table(spark, sf_dir, "embeddings")))
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(i: int) -> str:
    """Round i of the SQL: vectors with their nearest centroid of c{i}, and the centroids c{i + 1} that follow."""
    nearest_ = f"""a{i} AS (
  SELECT vec_id, v, r, arg_min({{'c': cluster, 'd': d}}, d * 64 + cluster) AS best
  FROM (SELECT f.vec_id, f.v, f.r, c.cluster, list_sum(list_transform(list_zip(f.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM fine f CROSS JOIN c{i} c)
  GROUP BY vec_id, v, r
)"""
    if i == 3:
        return nearest_
    moved = f"""s{i} AS (
  SELECT best.c AS cluster, p, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY ALL
), m{i} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v FROM s{i} GROUP BY cluster
), c{i + 1} AS (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON c.cluster = m.cluster
)"""
    return f"{nearest_}, {moved}"


OP13_SQL = f"""
WITH fine AS (
  SELECT vec_id, v, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) AS r
  FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)
), c0 AS (
  SELECT (r - 1)::INTEGER AS cluster, v FROM fine WHERE r <= 16
), {", ".join(_round(i) for i in range(4))}
SELECT vec_id, best.c AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 c ON a3.best.c = c.cluster
"""
