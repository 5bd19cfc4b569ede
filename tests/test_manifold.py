"""Embeddings by diffusion potential and measures of embeddings, against dense versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import manifold as mf
from pulsegrid.operators import models as mo


def cloud(n=60, dim=4, seed=1):
    g = np.random.default_rng(seed)
    return np.concatenate([g.normal(size=(n // 2, dim)), g.normal(size=(n - n // 2, dim)) + 3])


def test_landmarks_come_to_where_the_dense_version_puts_them():
    x = np.concatenate([cloud(), cloud()[:3]])  # some points twice
    t, k = 3, 15
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    scale = np.sqrt(np.sort(d2, 1)[:, k])
    kernel = np.exp(-d2 / np.outer(scale, scale))
    q = kernel.sum(1)
    p = kernel / np.outer(q, q)
    p = p / p.sum(1, keepdims=True)
    u = -np.log(np.maximum(p @ p @ p, np.finfo(float).eps))
    want = mo.classical_scaling(((u[:, None] - u[None]) ** 2).sum(2), 2)
    got = mo.landmark_potential(x, 2, t, k)(x)
    for j in range(2):
        assert min(np.abs(got[:, j] - want[:, j]).max(), np.abs(got[:, j] + want[:, j]).max()) < 1e-6 * np.abs(want).max()
    near = mo.landmark_potential(x)(x[:5] + 1e-9)
    assert np.allclose(near, got[:5], atol=1e-4 * np.abs(got).max()) and np.isfinite(mo.landmark_potential(x)(x[:2] + 1e6)).all()


def plain_trust(a, b, k):
    n, total = len(a), 0
    k = max(1, min(k, (n - 1) // 2))
    for i in range(n):
        order = [[j for j in np.argsort(((m - m[i]) ** 2).sum(1), kind="stable") if j != i] for m in (a, b)]
        rank = {j: r for r, j in enumerate(order[0], 1)}
        total += sum(rank[j] - k for j in order[1][:k] if rank[j] > k)
    return 1 - 2 * total / (n * k * (2 * n - 3 * k - 1))


def test_neighbours_kept(spark):
    x = cloud()
    y = x[:, :2] + np.random.default_rng(2).normal(size=(len(x), 2)) * 0.5
    df = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "train long, a double, b double, c double, d double, x double, y double").repartition(5)
    got = mf.neighbour_ranks(df, list("abcd"), ["x", "y"], k=10).agg(F.avg("trustworthiness").alias("t"), F.avg("continuity").alias("c"), F.count("*").alias("n")).first()
    assert got.n == 60 and got.t == pytest.approx(plain_trust(x, y, 10)) and got.c == pytest.approx(plain_trust(y, x, 10)) and got.t < 1
    some = mf.neighbour_ranks(df, list("abcd"), ["x", "y"], k=5, landmarks=20).collect()
    assert len(some) == 60 and all(0 <= r.trustworthiness <= 1 for r in some)
    same = mf.neighbour_ranks(df, list("abcd"), list("abcd"), k=5).collect()
    assert all(r.trustworthiness == r.continuity == 1 for r in same)
    assert mf.neighbour_ranks(df.limit(2), ["a"], ["x"]).first().trustworthiness is None


def test_states_apart(spark):
    r = random.Random(3)
    state = [s for _ in range(12) for s in ["a"] * r.randint(1, 6) + ["b"] * r.randint(1, 6) + ["c"] * r.randint(1, 3)] + ["once"]
    centre = {"a": 0, "b": 2, "c": 0, "once": 0}
    rows = [(i, s, centre[s] + r.gauss(0, 1), r.gauss(0, 1)) for i, s in enumerate(state)]
    df = spark.createDataFrame([*rows, (999, None, 0.0, 0.0), (1000, "a", None, 0.0)], "at long, state string, x double, y double").repartition(4)
    got = {(x.state_a, x.state_b): x for x in mf.state_distances(df, ["x", "y"], 99).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (a, b), x in got.items():
        m = [np.mean([[p, q] for _, s, p, q in rows if s == k], 0) for k in (a, b)]
        assert x.distance == pytest.approx(np.sqrt(((m[0] - m[1]) ** 2).sum())) and (x.n_a, x.n_b) == (state.count(a), state.count(b))
    assert got["a", "b"].shuffle_p == 0.01 and got["a", "c"].shuffle_p > 0.05 and got["a", "b"].shift_p < 0.1
    # shifts, one by one
    pts, null = np.array([[p, q] for _, _, p, q in rows]), []
    for k in range(1, len(state)):
        s = np.array(state[-k:] + state[:-k])
        null.append(np.sqrt(((pts[s == "a"].mean(0) - pts[s == "c"].mean(0)) ** 2).sum()))
    share = np.mean(np.array(null) >= got["a", "c"].distance)
    assert abs(got["a", "c"].shift_p - share) < 0.15


def test_columns_predicted_from_the_others(spark):
    g = np.random.default_rng(5)
    z = g.normal(size=(200, 2))
    x = z @ g.normal(size=(2, 5)) + 0.3 * g.normal(size=(200, 5))
    names = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "at long, " + ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {r.column: r for r in mf.held_out_prediction(df, names).collect()}
    for j, n in enumerate(names):
        rest = np.delete(x, j, 1)
        _, _, v = np.linalg.svd(rest, full_matrices=False)
        f = np.c_[np.ones(200), rest @ v[:3].T]
        w = np.linalg.lstsq(f[:140], x[:140, j], rcond=None)[0]
        p = f[140:] @ w
        assert got[n].r == pytest.approx(np.corrcoef(p, x[140:, j])[0, 1], abs=1e-6) and got[n].rmse == pytest.approx(np.sqrt(((p - x[140:, j]) ** 2).mean()), abs=1e-6)
    assert mf.held_out_prediction(df.limit(5), names).count() == 0


def by_hash(spark, n, permutations, seed):
    """Of each permutation: the points in the order of their hashes, and by how much labels are shifted."""
    b = spark.range(1, permutations + 1).select(F.col("id").cast("int").alias("b"))
    order = {r.b: [s["k"] for s in r.v] for r in b.join(spark.range(n).withColumnRenamed("id", "k")).groupBy("b").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "b", "k").alias("h"), "k"))).alias("v")).collect()}
    shift = {r.b: r.s for r in b.select("b", (1 + F.pmod(F.xxhash64(F.lit(seed + 1), "b"), F.lit(n - 1))).alias("s")).collect()}
    return order, shift


@pytest.mark.parametrize(("n", "places"), [(2, 4096), (37, 5), (64, 16), (3000, 128), (3000, 4096)])
def test_states_apart_as_laid_out(spark, monkeypatch, n, places):
    """Every permutation, point by point; and only the points are put in order, not all their permutations."""
    calls, once = [], mf.ranked
    monkeypatch.setattr(mf, "ranked", lambda df, *a, **k: calls.append(df) or once(df, *a, **k))
    r = random.Random(n)
    label = ["a", "b"] if n == 2 else [r.choice("aaabbc") for _ in range(n - 1)] + ["one"]
    pts = np.array([[r.gauss(s == "b", 1), r.gauss(0, 1)] for s in label])
    df = spark.createDataFrame([(i, s, *map(float, p)) for i, (s, p) in enumerate(zip(label, pts, strict=True))], "at long, state string, x double, y double").repartition(5)
    got = {(x.state_a, x.state_b): x for x in mf.state_distances(df, ["x", "y"], 9, seed=3, least=1, places=places).collect()}
    assert len(calls) == 1
    order, shift = by_hash(spark, n, 9, 3)
    label = np.array(label)
    dealt = {}
    for b in order:
        dealt["shuffle", b] = np.empty_like(label)
        dealt["shuffle", b][order[b]] = np.sort(label)
        dealt["shift", b] = np.roll(label, shift[b])
    names = sorted(set(label.tolist()))
    assert set(got) == {(a, b) for a in names for b in names if a < b}
    for (a, b), x in got.items():
        gap = lambda s, a=a, b=b: round(float(np.sqrt(((pts[s == a].mean(0) - pts[s == b].mean(0)) ** 2).sum())), 11)
        assert x.distance == pytest.approx(gap(label), abs=1e-10)
        for kind, p in (("shuffle", x.shuffle_p), ("shift", x.shift_p)):
            assert p == pytest.approx((1 + sum(gap(s) >= gap(label) for (k, _), s in dealt.items() if k == kind)) / 10), (a, b, kind)


def test_no_states(spark):
    assert mf.state_distances(spark.createDataFrame([(1, None, 0.0)], "at long, state string, x double"), ["x"], 3).collect() == []
