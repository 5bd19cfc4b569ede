"""How good an embedding is: neighbours kept, states apart, and what the other columns of a population say about one of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.sources.shared import ranked, stored

from .medians import whole_trains
from .models import subsample


def neighbour_ranks(points: DataFrame, high: list[str], low: list[str], k: int = 10, landmarks: int = 900, seed: int = 1) -> DataFrame:
    """(train, trustworthiness, continuity) of every point (train, high and low columns): how far landmarks that are near in one space only are down the ranks of the other, 1 if none is.

    Ranks are among a seeded sample of at most `landmarks` points, which is what tasks hold; a landmark isn't its own neighbour. Where all points are landmarks, the means over points are the usual measures.
    Ties stand in the landmarks' order. Fewer than four landmarks give nulls."""
    ends = [f"_h{i}" for i in range(len(high))], [f"_l{i}" for i in range(len(low))]
    both = points.select("train", *[F.col(c).alias(a) for c, a in zip([*high, *low], [*ends[0], *ends[1]], strict=True)]).na.drop()
    some = subsample(both, landmarks, seed, "train")
    names, x, y = some["train"].to_numpy(), *(some[c].to_numpy(float) for c in ends)
    kind = points.schema["train"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                own = part.column(0).to_numpy(zero_copy_only=False)
                columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns[1:]]
                a, c = np.stack(columns[: len(high)], 1), np.stack(columns[len(high) :], 1)
                trust, cont = _measures(own, a, c)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(trust, pa.float64(), from_pandas=True), pa.array(cont, pa.float64(), from_pandas=True)], ["train", "trustworthiness", "continuity"])

    def _measures(own: np.ndarray, a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(names)
        out = np.full((2, len(own)), np.nan)
        if n < 4:
            return out[0], out[1]
        da, dc = (((p[:, None] - q[None]) ** 2).sum(2) for p, q in ((a, x), (c, y)))
        mine = own[:, None] == names[None]
        for i in range(len(own)):
            others = np.flatnonzero(~mine[i])
            m = len(others) + 1
            kk = max(1, min(k, (m - 1) // 2))
            near = [np.argsort(d[i, others], kind="stable") for d in (da, dc)]
            rank = [np.empty(m - 1, int) for _ in near]
            for r, o in zip(rank, near, strict=True):
                r[o] = np.arange(1, m)
            whole = kk * (2 * m - 3 * kk - 1)
            for j, (one, other) in enumerate(((1, 0), (0, 1))):  # near in the low space but far in the high one, and the other way
                r = rank[other][near[one][:kk]]
                out[j, i] = 1 - 2 * np.maximum(r - kk, 0).sum() / whole if whole > 0 else np.nan
        return out[0], out[1]

    return both.mapInArrow(run, f"train {kind}, trustworthiness double, continuity double")


#: Places of points that stand in one row as packed numbers, and bits of a hash that points are counted by.
PLACES, BITS = 4096, 12


def state_distances(points: DataFrame, axes: list[str], permutations: int = 199, seed: int = 1, least: int = 2, places: int = PLACES) -> DataFrame:
    """(state_a, state_b, n_a, n_b, distance, shuffle_p, shift_p) of every two states of points (at, state, axes; ordered by at): how far apart their centres are, against labels shuffled, and against labels
    shifted in a circle, which keeps their runs.

    Points are numbered by ranges; what is held against them are sums by state, found without a row for each point and permutation (shuffled_sums, shifted_sums). States of under `least` points don't
    count. Distances are rounded to twelve digits."""
    spark = points.sparkSession
    x = points.where(F.col("state").isNotNull() & (F.col("state") != "")).select("at", "state", *axes).na.drop()
    x = stored(ranked(x, F.col("at"), F.col("state"), name="k"), "points")
    found = x.groupBy("state").agg(F.count(F.lit(1)).alias("n"), *[F.sum(a).alias(a) for a in axes]).orderBy("state").collect()  # a row for each state
    kind, sums = x.schema["state"].dataType.simpleString(), ", ".join(f"`{a}` double" for a in axes)
    first = np.cumsum([0, *(r["n"] for r in found)]).tolist()
    states = spark.createDataFrame([(i, r["state"], r["n"], first[i]) for i, r in enumerate(found)], f"code int, state {kind}, n long, first long").coalesce(1)
    coded = stored(x.join(F.broadcast(states.select("state", "code")), "state").select("k", "code", *[F.col(a).cast("double").alias(a) for a in axes]), "coded-points")
    seen = spark.createDataFrame([("seen", 0, i, *(float(r[a]) for a in axes)) for i, r in enumerate(found)], f"kind string, b int, code int, {sums}").coalesce(1)
    named = lambda df, name: df.select(F.lit(name).alias("kind"), "b", "code", *axes)
    # stored one by one: the sides of a union that were shuffled by one key aren't always put together by it (see README)
    every = seen
    for name, df in (("shuffle", shuffled_sums(coded, states, axes, permutations, seed)), ("shift", shifted_sums(coded, axes, len(found), first[-1], permutations, seed + 1, places))):
        every = every.unionByName(stored(named(df, name), f"{name}-sums"))
    every = every.groupBy("kind", "b", "code").agg(*[F.sum(a).alias(a) for a in axes])
    centres = every.join(F.broadcast(states.where(F.col("n") >= least)), "code").select("kind", "b", "state", "n", *[(F.col(a) / F.col("n")).alias(a) for a in axes])
    centres = stored(centres, "centres")  # a row for each state and permutation
    two = centres.select("kind", "b", F.col("state").alias("state_a"), F.col("n").alias("n_a"), *[F.col(a).alias(f"_{a}") for a in axes]).join(centres.select("kind", "b", F.col("state").alias("state_b"), F.col("n").alias("n_b"), *axes), ["kind", "b"]).where("state_a < state_b")
    gap = F.round(F.sqrt(sum(((F.col(a) - F.col(f"_{a}")) ** 2 for a in axes), F.lit(0.0))), 12)
    two = two.withColumn("d", gap)
    observed = two.where("kind = 'seen'").select("state_a", "state_b", "n_a", "n_b", F.col("d").alias("distance"))
    null = two.where("kind <> 'seen'").select("kind", "state_a", "state_b", "d").join(F.broadcast(observed), ["state_a", "state_b"])
    p = lambda kind: (1 + F.count_if((F.col("kind") == kind) & (F.col("d") >= F.col("distance")))) / (F.count_if(F.col("kind") == kind) + 1)
    return null.groupBy("state_a", "state_b", "n_a", "n_b", "distance").agg(p("shuffle").alias("shuffle_p"), p("shift").alias("shift_p"))


def shuffled_sums(points: DataFrame, states: DataFrame, axes: list[str], permutations: int, seed: int) -> DataFrame:
    """(b, code, sums of the axes) of points (k, code, axes) whose labels are shuffled: in the order of a seeded hash of b and k, the first points get the first state, as many as it has, and so on.

    states: code, n, first (how many points the states before it have). Points are counted and added up by the first bits of their hashes; only those few of them in which one state ends and the next begins
    are put in order."""
    each = points.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("_h", F.xxhash64(F.lit(seed), "b", "k")).withColumn("_bin", F.shiftright("_h", 64 - BITS))
    bins = each.groupBy("b", "_bin").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(a).alias(a) for a in axes])
    before = F.sum("_n").over(Window.partitionBy("b").orderBy("_bin")) - F.col("_n")  # of 4,096 rows at most
    bins = stored(bins.withColumn("_before", before), "hash-bins")
    own = F.broadcast(states.select("code", "first", (F.col("first") + F.col("n")).alias("_end")))  # a row for each state
    inside = (F.col("_before") >= F.col("first")) & (F.col("_before") + F.col("_n") <= F.col("_end"))
    whole = stored(bins.join(own, inside).select("b", "code", *axes), "whole-bins")
    cut = stored(bins.join(own, inside, "left_anti").select("b", "_bin", "_before"), "cut-bins")
    some = each.drop("code").join(F.broadcast(cut), ["b", "_bin"])  # a cut for each permutation and state at most
    place = F.col("_before") + F.row_number().over(Window.partitionBy("b", "_bin").orderBy("_h", "k")) - 1
    some = some.withColumn("_place", place).join(own, (F.col("_place") >= F.col("first")) & (F.col("_place") < F.col("_end")))
    parts = stored(some.groupBy("b", "code").agg(*[F.sum(a).alias(a) for a in axes]), "parted-bins")
    return whole.unionByName(parts)


def shifted_sums(points: DataFrame, axes: list[str], states: int, n: int, permutations: int, seed: int, places: int = PLACES) -> DataFrame:
    """(b, code, sums of the axes) of points (k from 0 to n - 1, code, axes) whose labels are shifted in a circle, by a seeded hash of b.

    Points and labels are packed, so many places a row, and each shift sends a label (a byte, if there are few states) to the row of the points that it falls on. A task adds up the points under the labels."""
    spark = points.sparkSession
    by = spark.range(1, permutations + 1).select(F.col("id").cast("int").alias("b")).select("b", (1 + F.pmod(F.xxhash64(F.lit(seed), "b"), F.lit(max(1, n - 1)))).alias("by"))
    shifts = [(r["b"], r["by"]) for r in by.collect()]  # a number for each permutation
    width, kind = len(axes), np.min_scalar_type(max(states - 1, 0))
    schema = "train long, b int, at int, data binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in whole_trains(batches):
            k, code = t.column("k").to_numpy(), t.column("code").to_numpy().astype(kind)
            x = np.stack([t.column(a).to_numpy(zero_copy_only=False) for a in axes], 1)
            edges = np.flatnonzero(np.r_[True, np.diff(group) != 0, True])
            for a, z in zip(edges, edges[1:], strict=False):
                rows = [(int(k[a]) // places, 0, 0, x[a:z].tobytes())]
                for b, shift in shifts:
                    at, i = (int(k[a]) + shift) % n, a
                    while i < z:  # up to the end of a row, or of all points
                        m = min(z - i, places - at % places, n - at)
                        rows.append((at // places, b, at % places, code[i : i + m].tobytes()))
                        i, at = i + m, (at + m) % n
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["train", "b", "at", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((permutations + 1, states, width))
        for t, _ in whole_trains(batches):
            x = np.zeros((0, width))
            for b, at, data in zip(t.column("b").to_pylist(), t.column("at").to_pylist(), t.column("data"), strict=True):
                data = np.frombuffer(data.as_buffer(), float if b == 0 else kind)
                if b == 0:  # comes first in its row of places
                    x = data.reshape(-1, width)
                else:
                    total[b] += np.stack([np.bincount(data, x[at : at + len(data), i], states) for i in range(width)], 1)
        b, code = np.divmod(np.arange(permutations * states), states)
        yield pa.RecordBatch.from_arrays([pa.array(b + 1, pa.int32()), pa.array(code, pa.int32()), *(pa.array(total[1:, :, i].ravel()) for i in range(width))], ["b", "code", *axes])

    rows = points.select(F.floor(F.col("k") / places).alias("train"), "k", "code", *axes).repartition("train").sortWithinPartitions("train", "k")
    packed = rows.mapInArrow(pack, schema).repartition("train").sortWithinPartitions("train", "b", "at")
    return packed.mapInArrow(add, f"b int, code int, {', '.join(f'`{a}` double' for a in axes)}")


def held_out_prediction(matrix: DataFrame, columns: list[str], share: float = 0.7, axes: int = 3) -> DataFrame:
    """(column, r, rmse): how well each column of a population's matrix (at, columns) is predicted, on its later rows, from the first principal axes of all other columns, by a line fitted on its earlier rows.

    Sums and cross-products of the columns, of each part, are all that leaves the tasks: axes, fits and errors follow from them."""
    x = stored(ranked(matrix.select("at", *[F.col(c).cast("double").alias(c) for c in columns]).na.drop(), F.col("at"), name="_k"), "population-rows")
    n = x.count()
    first = max(4, int(n * share))
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)], *[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i, j in pairs]]
    parts = {r["_early"]: r for r in x.groupBy((F.col("_k") < first).alias("_early")).agg(*sums).collect()}  # two rows
    spark = matrix.sparkSession
    schema = "column string, r double, rmse double"
    if n < 10 or k < 3 or len(parts) < 2 or parts[False]["n"] < 2:
        return spark.createDataFrame([], schema)

    def moments(r) -> tuple[int, np.ndarray]:
        m = np.empty((k + 1, k + 1))  # of (1, columns)
        m[0, 0] = r["n"]
        m[0, 1:] = m[1:, 0] = [r[f"s{i}"] for i in range(k)]
        for i, j in pairs:
            m[i + 1, j + 1] = m[j + 1, i + 1] = r[f"p{i}_{j}"]
        return r["n"], m

    (_, early), (late_n, late) = moments(parts[True]), moments(parts[False])
    rows = []
    for j, c in enumerate(columns):
        rest = [i + 1 for i in range(k) if i != j]
        whole = (early + late)[np.ix_(rest, rest)]
        w, v = np.linalg.eigh(whole)
        z = np.zeros((k + 1, min(axes, len(rest)) + 1))  # 1 and the axes as combinations of (1, columns)
        z[0, 0] = 1
        z[rest, 1:] = v[:, ::-1][:, :axes]
        fit = np.linalg.lstsq(z.T @ early @ z, z.T @ early[:, j + 1], rcond=None)[0]
        line = z @ fit
        e = np.zeros(k + 1)
        e[j + 1] = 1
        m1, m2 = late[0] @ line / late_n, late[0, j + 1] / late_n
        cov, v1, v2 = line @ late @ e / late_n - m1 * m2, line @ late @ line / late_n - m1 * m1, late[j + 1, j + 1] / late_n - m2 * m2
        error = (line - e) @ late @ (line - e) / late_n
        rows.append((c, float(cov / np.sqrt(v1 * v2)) if v1 > 1e-15 and v2 > 1e-15 else None, float(np.sqrt(max(0.0, error)))))
    return spark.createDataFrame(rows, schema)
