"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranked, small, stored, table

#: Numbers in a block of candidates at most, the blocks that a table is cut into at least (of LEAST_ROWS rows at least), and vectors in a block of queries.
BLOCK_VALUES, BLOCKS, LEAST_ROWS, QUERY_ROWS = 1 << 19, 48, 64, 512
#: Rows of the longest vectors whose k-th score bounds the search in all others; parts that the list of a dimension's blocks is dealt into.
HEAD_ROWS, SALTS = 2048, 16
#: Local cosine thresholds from which coordinates are tried, the coordinates looked at, the rows of a block that are tried, and the share of them that may pass.
COSINE, FOCUS, TRIED, PASSING = 0.3, 3, 64, 0.5
#: Scores that are worked out at once.
AT_ONCE = 1 << 22
EXACT = float(1 << 53)
SCHEMA = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v, dim, length): components floor(scale * x), x as double, and the Euclidean length; without vectors that are null or hold null or
    non-finite components. Components beyond 64 bits saturate."""
    x = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall(x, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(square).alias("length"))


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact integer inner products; floating point only where all of them fit it."""
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def feasible(u: np.ndarray, t: float, unit: np.ndarray) -> np.ndarray:
    """Which rows of unit can have a cosine of at least t with the unit vector u, by their values at its largest coordinates alone: there, a row must lie
    in the range that leaves the rest of both vectors enough length."""
    fit = np.ones(len(unit), bool)
    for f in np.argsort(-np.abs(u))[:FOCUS]:
        x, rest = u[f], np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] * u[f])))
        low, high = (x * t - rest if x > -t else -1.0), (x * t + rest if x < t else 1.0)
        fit &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
    return fit


class Candidates:
    """A block of candidates, longest first: cast once, whatever number of queries meets it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray):
        self.ids, self.vectors, self.lengths, self.unit = ids, vectors, lengths, None
        self.real = vectors.astype(np.float64)

    def plan(self, q: np.ndarray, length: float, theta: float) -> tuple[int, np.ndarray | None]:
        """How many of the longest rows may reach theta with q, and, if its local threshold is high enough for coordinates to prune better, which of them."""
        longest = self.lengths[0]
        if theta <= 0 or length == 0 or longest == 0:
            return len(self.ids), None
        t = theta / (length * longest) * (1 - 1e-9)
        if t > 1:
            return 0, None
        n = int(np.searchsorted(-self.lengths, -theta / length * (1 - 1e-9), side="right"))
        if t < COSINE or not n:
            return n, None
        if self.unit is None:
            self.unit = self.real / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        u = q / length
        if feasible(u, t, self.unit[: n : max(1, n // TRIED)]).mean() > PASSING:
            return n, None
        return n, np.flatnonzero(feasible(u, t, self.unit[:n]))

    def scores(self, q: np.ndarray, q_real: np.ndarray, rows: slice | np.ndarray, bound: float) -> np.ndarray:
        if bound < EXACT:
            return (q_real @ self.real[rows].T).astype(np.int64)
        return products(q, self.vectors[rows], bound)

    def best(self, ids: np.ndarray, q: np.ndarray, lengths: np.ndarray, theta: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        """(query id, row id, score) of each query's k best here, and all that tie with the k-th, if they reach its theta; and the pairs that were pruned."""
        out, bound, real, whole, met = [], float(lengths.max() * self.lengths[0]), q.astype(np.float64), [], 0
        out_of, far = np.iinfo(np.int64).min, 9.2e18
        # thetas as integers, a little below where doubles don't hold them exactly
        floors = np.clip(np.floor(theta - np.abs(np.where(np.isfinite(theta), theta, 0)) * 1e-15), -far, far).astype(np.int64)

        def keep(who: np.ndarray, n: np.ndarray, rows: slice | np.ndarray) -> None:
            s, names = self.scores(q[who], real[who], rows, bound), self.ids[rows]
            s[np.arange(s.shape[1])[None, :] >= n[:, None]] = out_of
            s[names[None, :] == ids[who][:, None]] = out_of
            least = floors[who]
            if s.shape[1] > k:
                least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
            i, j = np.nonzero((s >= least[:, None]) & (s != out_of))
            out.append(np.stack([ids[who][i], names[j], s[i, j]]))

        for i in range(len(ids)):
            n, some = self.plan(real[i], lengths[i], theta[i])
            met += n if some is None else len(some)
            if some is None:
                whole += [(n, i)] if n else []
            elif len(some):
                keep(np.array([i]), np.array([len(some)]), some)
        whole.sort()
        at = 0
        while at < len(whole):  # queries that need about as many rows go together
            step = max(1, AT_ONCE // whole[min(len(whole), at + 64) - 1][0])
            part = whole[at : at + min(step, 64)]
            keep(np.array([i for _, i in part]), np.array([n for n, _ in part]), slice(0, part[-1][0]))
            at += len(part)
        return (np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)), len(ids) * len(self.ids) - met


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {n: batch.column(n)[row] for n in batch.schema.names}
                dim = cell["dim"].as_py()
                array = lambda n: np.asarray(cell[n].values)  # noqa: B023, E731
                if at != (dim, cell["block"].as_py()):
                    ids = array("c_ids")
                    block, at = Candidates(ids, array("c_v").reshape(len(ids), dim), array("c_lengths")), (dim, cell["block"].as_py())
                ids = array("q_ids")
                found, _ = block.best(ids, array("q_v").reshape(len(ids), dim), array("q_lengths"), array("theta"), k)
                if found.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    return run


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _query_blocks(queries: DataFrame) -> DataFrame:
    """(dim, q_block, least, q_ids, q_lengths, q_v, theta): queries by block; a candidate block whose longest vector is shorter than least can't reach any theta."""
    least = F.min(F.when(F.col("length") > 0, F.col("theta") / F.col("length")).otherwise(float("-inf")))
    q = queries.groupBy("dim", "q_block").agg(F.collect_list(F.struct("vec_id", "length", "v", "theta")).alias("y"), least.alias("least"))
    held = [F.col("y.vec_id").alias("q_ids"), F.col("y.length").alias("q_lengths"), F.flatten("y.v").alias("q_v"), F.col("y.theta").alias("theta")]
    return stored(q.select("dim", "q_block", "least", *held), "query-blocks")


def _met(queries: DataFrame, blocks: DataFrame, k: int, cut: Column) -> DataFrame:
    """What blocks of queries find in the blocks that they have to meet: first names meet, dealt out by dimension and a part of its blocks, then what they hold."""
    q = _query_blocks(queries)
    dealt = q.select("dim", "q_block", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    names = blocks.select("dim", "block", "longest", F.pmod("block", F.lit(SALTS)).cast("int").alias("salt"))
    names = dealt.join(names, ["dim", "salt"]).where(cut).select("dim", "q_block", "block")
    pairs = names.join(q, ["dim", "q_block"]).join(blocks.drop("longest"), ["dim", "block"])
    return pairs.select("dim", "block", "q_ids", "q_lengths", "q_v", "theta", "c_ids", "c_lengths", "c_v").mapInArrow(_search(k), SCHEMA)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query with all other rows; ties go to the smaller vec_id.

    Vectors are sorted by length into blocks of one size each, some tens of them at least, so equal vectors spread over blocks too. Queries meet the longest
    HEAD_ROWS vectors first; their k-th score there is a bound for all others. A block of queries then meets only blocks that are long enough for one of its
    bounds, and there each query prunes by length or, where its local cosine threshold is high and a sample of the block shows that it pays, by
    coordinates; what is left is multiplied out in integers.

    Vectors that are null or hold null or non-finite components, and null ids, take no part. Vectors of different dimension aren't compared; empty vectors
    are of dimension 0 and score 0 with each other. Repeated rows are candidates each; all rows with a query's own id are its own, and the first of them (by
    dimension and components) asks. A table with fewer than k + 1 rows gives fewer; an empty one none. Further columns aren't read.
    """
    q_flag = vectors.select(F.col(id_col).cast("long").alias("vec_id"), is_query.alias("is_query")).where("is_query").select("vec_id").distinct()
    rows = stored(ranked(quantised(vectors, id_col, vec_col, scale), F.col("dim"), F.desc("length"), F.col("vec_id"), name="at"), "vectors")
    dims = stored(rows.groupBy("dim").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "dimensions")
    most = F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(BLOCK_VALUES) / F.greatest(F.col("dim"), F.lit(1))))
    dims = dims.withColumn("per_block", F.least(most, F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("n") / BLOCKS))))
    each = rows.join(small(dims), "dim").withColumn("block", F.floor((F.col("at") - F.col("first")) / F.col("per_block")))
    cells = each.groupBy("dim", "block").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "length", "v"))).alias("x"), F.first("per_block").alias("per_block"))
    head = F.col("block") * F.col("per_block") < HEAD_ROWS
    held = [F.col("x.vec_id").alias("c_ids"), F.col("x.length").alias("c_lengths"), F.flatten("x.v").alias("c_v"), F.col("x.length")[0].alias("longest")]
    blocks = stored(cells.select("dim", "block", head.alias("head"), *held), "blocks")
    asked = rows.join(q_flag, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("dim", "v", "length")).alias("q")).select("vec_id", "q.*")
    asked = ranked(asked, F.col("dim"), F.desc("length"), F.col("vec_id"), name="q_at")
    asked = stored(asked.withColumn("q_block", F.floor(F.col("q_at") / QUERY_ROWS)).drop("q_at"), "queries")
    first = _met(asked.withColumn("theta", F.lit(float("-inf"))), blocks.where("head").drop("head"), k, F.lit(True))
    first = stored(_best(first, k), "first-scores")
    bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("theta"))
    bounded = asked.join(bound, "vec_id", "left").withColumn("theta", F.coalesce("theta", F.lit(float("-inf"))))
    rest = _met(bounded, blocks.where("not head").drop("head"), k, F.col("longest") * (1 + 1e-9) >= F.col("least"))
    return _best(first.drop("rank").unionByName(rest), k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP4_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM fine q JOIN fine c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
WHERE rank <= 5
"""
