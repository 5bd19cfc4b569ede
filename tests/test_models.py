"""Models on data whose structure is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import models as mo
from pulsegrid.operators import validation as va


def test_mixture(spark):
    rng = np.random.default_rng(1)
    x = [*rng.normal(-2, 0.1, 200), *rng.normal(1, 0.2, 100)]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, x double")
    parts, _ = mo.gaussian_mixture(df, ["x"], 2)
    assert [p["mean"][0] for p in parts] == pytest.approx([-2, 1], abs=0.1)
    assert parts[0]["weight"] == pytest.approx(2 / 3, abs=0.02)


def test_semi_markov(spark):
    isi = [0.01] * 10 + [0.1] * 6 + [0.01] * 8
    df = spark.createDataFrame([(1, i + 2, v, True) for i, v in enumerate(isi)], "train long, idx long, isi double, valid boolean")
    got = [r.state for r in mo.semi_markov(df, [-2.0, -1.0], 0.3, [8.0, 5.0]).orderBy("idx").collect()]
    assert got == [0] * 10 + [1] * 6 + [0] * 8


def test_transitions_are_shares(spark):
    df = spark.createDataFrame([("a", "a", 30), ("a", "b", 70), ("b", "a", 50), ("b", "b", 50)], "source string, target string, n long")
    p = {(r.source, r.target): r.p for r in mo.transition_model(df).collect()}
    assert p["a", "b"] == pytest.approx(0.7, abs=1e-3) and p["b", "a"] == pytest.approx(0.5, abs=1e-3)


def test_embeddings():
    t = np.linspace(0, 3, 60)
    curve = np.c_[np.cos(t), np.sin(t), 0 * t]
    y = mo.isomap(curve, 4, 1)[:, 0]
    assert abs(np.corrcoef(y, t)[0, 1]) > 0.999
    assert abs(np.corrcoef(mo.diffusion_map(curve, 1)[:, 0], t)[0, 1]) > 0.9


def test_factor_analysis(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(size=500)
    df = spark.createDataFrame([(float(a), float(a + b), float(c)) for a, b, c in zip(f, rng.normal(0, 0.3, 500), rng.normal(size=500), strict=True)], "x double, y double, z double")
    load, _ = mo.factor_analysis(df, ["x", "y", "z"])
    assert min(abs(load[:2, 0])) > 0.9 and abs(load[2, 0]) < 0.2


def test_greedy_match_and_delta(spark):
    s = "train long, label string, start long, end long"
    truth = spark.createDataFrame([(1, "burst", 2, 5), (1, "burst", 10, 12), (1, "pause", 20, 20)], s)
    pred = spark.createDataFrame([(1, "burst", 2, 4), (1, "burst", 3, 6), (1, "tonic", 10, 12), (1, "burst", 30, 33)], s)
    m = {(r.pred_start, r.truth_start): r.iou for r in va.matched(pred, truth).collect()}
    assert m == {(2, 2): 0.75}
    kinds = sorted(r.kind for r in va.match_table(pred, truth).collect())
    assert kinds == ["TP", "extra_detector_event", "extra_detector_event", "label_confusion", "missed_manual_event", "missed_manual_event"]
    d = sorted((r.kind, r.start) for r in va.delta(truth, pred).collect())
    assert ("label_changed", 10) in d and ("removed", 20) in d and ("added", 30) in d and ("boundary_changed", 2) in d


def test_bootstrap(spark):
    c = spark.createDataFrame([(i, "burst", 9, 9, 8) for i in range(20)] + [(0, "pause", 1, 0, 0)], "train long, label string, truth_n long, pred_n long, tp long")
    r = {(x.label, x.metric): x for x in va.cluster_bootstrap(c).collect()}
    assert len(r) == 2 * len(va.METRICS)
    f1 = r["burst", "f1"]
    assert (f1.low, f1.mean, f1.high, f1.observed) == pytest.approx((16 / 18,) * 4) and f1.replicates == 200
    # a train is in a replicate as often as it is drawn; where it isn't, its label has no recall
    pause = r["pause", "truth_n"]
    assert pause.low == 0 and 0.7 < pause.mean < 1.3 and pause.high >= 3 and pause.replicates == 200
    assert r["pause", "recall"].replicates < 160 and r["pause", "precision"].replicates == 0 and r["pause", "precision"].low is None


def test_quantile_of_kind_6(spark):
    x = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0],), ([],)], "v array<double>").select(*[va.quantile_6(F.col("v"), p) for p in (0.025, 0.5, 0.3, 0.975)]).collect()
    assert tuple(x[0]) == (1.0, 3.0, 1.5, 8.0) and tuple(x[1]) == (None,) * 4


def test_surrogates_keep_intervals(spark):
    df = spark.createDataFrame([(1, i + 1, None if i == 0 else i / 100, True) for i in range(30)], "train long, idx long, isi double, valid boolean")
    s = va.shuffled_intervals(df, 2)
    for k in (1, 2):
        x = s.where(F.col("surrogate") == k).orderBy("idx").collect()
        assert sorted(r.isi for r in x) == [i / 100 for i in range(1, 30)]
        assert [r.us for r in x] == list(np.cumsum([round(r.isi * 1e12) for r in x]))
    assert [r.isi for r in s.where("surrogate = 1").orderBy("idx").collect()] != [r.isi for r in s.where("surrogate = 2").orderBy("idx").collect()]
