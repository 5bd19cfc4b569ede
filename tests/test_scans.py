"""Operators without SQL against plain versions on random data."""

import math
import random

import numpy as np
import pytest

from pulsegrid.operators import events as ev
from pulsegrid.operators import models as mo
from pulsegrid.operators import support as su
from pulsegrid.operators import validation as va
from pulsegrid.sources.csv import golden


def train(isis):
    out = [0.0]
    for x in isis:
        out.append(out[-1] + x)
    return out


def test_growth_of_tonic_runs(spark):
    r = random.Random(3)
    isis = [r.choice([0.05, 0.06, 0.02, 0.3]) * r.uniform(0.8, 1.2) for _ in range(300)]
    rows = golden(spark, {"a": train(isis)})
    v = [x.isi for x in rows.orderBy("idx").collect()][1:]

    def lv(a, b):
        return sum(3 * (v[i] - v[i + 1]) ** 2 / (v[i] + v[i + 1]) ** 2 for i in range(a, b)) / (b - a)

    want, i, floor = [], 0, 0
    while i < len(v) - 1:
        if max(v[i], v[i + 1]) / min(v[i], v[i + 1]) <= 1.4:
            a, b = i, i + 1
            while b + 1 < len(v) and lv(a, b + 1) <= 0.35:
                b += 1
            while a - 1 >= floor and lv(a - 1, b) <= 0.35:
                a -= 1
            if b - a + 1 >= 4:
                want.append((a + 2, b + 2))
                floor = b + 1
            i = b + 1
        else:
            i += 1
    got = ev.tonic_growth(rows).orderBy("start").collect()
    assert [(x.start, x.end) for x in got] == want and len(want) > 3
    assert all(x.lv == pytest.approx(lv(x.start - 2, x.end - 2)) for x in got)


def test_greedy_suppression(spark):
    r = random.Random(5)
    rows = [(t, i, s, s + r.randint(0, 150), float(r.randint(0, 5)), r.random()) for t in (1, 2) for i in range(150) for s in [r.randint(2, 900)]]
    want = set()
    for t in (1, 2):
        kept = []
        for x in sorted((x for x in rows if x[0] == t), key=lambda x: (-x[4], -x[5], x[2], x[1])):
            if all(max(0, min(x[3], k[3]) - max(x[2], k[2]) + 1) / min(x[3] - x[2] + 1, k[3] - k[2] + 1) < 0.75 for k in kept):
                kept.append(x)
        want |= {(x[0], x[1]) for x in kept}
    got = ev.greedy_suppression(spark.createDataFrame(rows, "train long, candidate long, start long, end long, priority double, score double"))
    assert {(x.train, x.candidate) for x in got.collect()} == want and len(want) < 200


def test_split_is_half_and_stays(spark):
    df = spark.createDataFrame([(i, 0) for i in range(101)] * 2, "train long, x int")
    a = {x.train: x.part for x in va.split(df).collect()}
    b = {x.train: x.part for x in va.split(df.repartition(5)).collect()}
    assert a == b and list(a.values()).count("calibration") == 51 and len(a) == 101


def test_iou_sensitivity(spark):
    schema = "train long, label string, start long, end long"
    pred = spark.createDataFrame([(1, "x", 0, 9), (1, "x", 20, 29)], schema)
    truth = spark.createDataFrame([(1, "x", 5, 14), (1, "x", 20, 28)], schema)  # IoU 1/3 and 0.9
    got = {x.least: (x.tp, x.fp, x.fn, x.f1) for x in va.iou_sensitivity(pred, truth, (0.1, 0.5, 0.95)).collect()}
    assert got == {0.1: (2, 0, 0, 1.0), 0.5: (1, 1, 1, 0.5), 0.95: (0, 2, 2, None)}


def test_overfit(spark):
    schema = "train long, label string, start long, end long"
    truth = spark.createDataFrame([(t, "x", 0, 9) for t in range(4)], schema)
    pred = truth.where("train < 2")
    parts = spark.createDataFrame([(t, "calibration" if t < 2 else "validation") for t in range(4)], "train long, part string")
    x = va.overfit(pred, truth, parts).first()
    assert (x.recall_calibration, x.recall_validation, x.recall_gap, x.possible_overfit, x.precision_validation) == (1.0, 0.0, 1.0, True, None)


def test_calibrations(spark):
    r = random.Random(8)
    rows = [(x, int(r.random() < x**2)) for x in (round(r.random(), 3) for _ in range(300))]
    df = spark.createDataFrame(rows, "score double, outcome int")
    a = b = 0.0
    x, y = np.array(rows).T
    for _ in range(30_000):
        p = 1 / (1 + np.exp(-(a * x + b)))
        a, b = a - 2 * ((p - y) * x).mean(), b - 2 * (p - y).mean()
    for s in mo.platt(df).collect()[:50]:
        assert s.calibrated == pytest.approx(1 / (1 + math.exp(-(a * s.score + b))), abs=1e-3)
    blocks = []  # pool adjacent violators, of equal scores together
    for s in sorted({s for s, _ in rows}):
        own = [o for t, o in rows if t == s]
        blocks.append([sum(own), len(own), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2] + last[2]]
    want = {s: t / n for t, n, scores in blocks for s in scores}
    assert all(s.calibrated == pytest.approx(want[s.score], abs=1e-9) for s in mo.isotonic(df).collect())


def test_principal_components(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3)) @ np.array([[2, 1, 0], [0, 1, 1], [0, 0, 0.3]])
    out, shares = mo.principal_components(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double"), ["a", "b", "c"], 2)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(z.T @ z / 199)
    assert shares == pytest.approx((values[::-1] / values.sum())[:2].tolist())
    got = np.array([(r.pc1, r.pc2) for r in out.orderBy("i").collect()])
    want = z @ vectors[:, ::-1][:, :2]
    assert np.allclose(np.abs((got - got.mean(0)) / got.std(0)), np.abs(want / want.std(0)), atol=1e-6)


def test_valley_of_two_kinds_of_intervals(spark):
    rng = np.random.default_rng(2)
    short, long = 10 ** rng.normal(-2.3, 0.08, 400), 10 ** rng.normal(-0.7, 0.08, 400)
    rows = golden(spark, {"two": train(np.concatenate([short, long]).tolist()), "one": train(long.tolist())})
    got = {x.train: x for x in su.log_threshold(rows).collect()}
    assert 0.008 < got["two"].threshold < 0.15 and got["two"].void >= 0.7 and got["one"].threshold is None


def test_cores_grow_over_the_run_around_them(spark):
    rows = golden(spark, {"a": train([0.2, 0.015, 0.006, 0.006, 0.006, 0.006, 0.018, 0.2, 0.006, 0.006, 0.2])})
    th = spark.createDataFrame([("a", 0.01)], "train string, threshold double")
    got = su.core_bursts(rows, th).collect()
    assert [(x.start, x.end, x.core_start, x.core_end, x.cores) for x in got] == [(3, 8, 4, 7, 1)]  # the second run has three spikes


def test_validation_report(spark, tmp_path):
    from pulsegrid.sources import csv

    schema = "train long, label string, start long, end long"
    truth = spark.createDataFrame([(t, "x", 0, 9) for t in range(6)] + [(0, "y", 20, 25)], schema)
    pred = spark.createDataFrame([(t, "x", 1, 9) for t in range(5)] + [(1, "y", 40, 45)], schema)
    parts = spark.createDataFrame([(t, "calibration" if t < 3 else "validation") for t in range(6)], "train long, part string")
    csv.write(va.report(pred, truth, parts, replicates=20), f"file://{tmp_path}/out", "csv")
    read = lambda n: spark.read.option("header", True).csv(f"file://{tmp_path}/out/{n}")
    m = {r.label: (r.truth_n, r.pred_n, r.tp) for r in read("metrics").collect()}
    assert m == {"x": ("6", "5", "5"), "y": ("1", "1", "0")}
    assert read("metric_intervals").count() == 16 and read("overfit").count() == 2 and read("iou_sensitivity").count() == 6 and read("matches").count() == 8


def test_settings_as_text(spark, tmp_path):
    from pulsegrid.functions.grammar import Grammar
    from pulsegrid.sources import csv

    g = Grammar(seed_high=0.012, strict_q95=True, long_spikes=(11, 20))
    csv.write_settings(spark, g, f"file://{tmp_path}/g")
    assert csv.read_settings(spark, f"file://{tmp_path}/g") == g and csv.read_settings(spark, f"file://{tmp_path}/g").digest() == g.digest()
    assert Grammar.from_text('{"bridge": 0.02}') == Grammar(bridge=0.02) and Grammar.from_text('{"odd": 1}', strict=False) == Grammar()
    for bad in ('{"odd": 1}', '{"bridge": "wide"}', '{"strict_q95": 1}', '{"long_spikes": 3}'):
        with pytest.raises(ValueError):
            Grammar.from_text(bad)


def test_clean_names():
    from pulsegrid.sources.csv import clean_names

    assert clean_names(["a b", "a-b", "A_b", "", "%", "é"]) == ["a_b", "a_b_2", "A_b_3", "train", "train_2", "train_3"]
