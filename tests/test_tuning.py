"""Settings as keys: detection under variants, sign flips, strata, splits and the choice of a variant, against plain Python."""

import itertools
import math
import random
from collections import defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.grammar import Grammar
from pulsegrid.operators import detectors as de
from pulsegrid.operators import tuning as tu
from pulsegrid.operators.runs import segments
from pulsegrid.sources.csv import golden

COUNTS = "variant string, train int, label string, truth_n long, pred_n long, tp long"


def test_variants_are_detected_at_once(spark):
    r = random.Random(2)
    trains = {k: [0, *accumulate(r.choices([0.006, 0.013, 0.03, 0.05, 0.3], [5, 3, 3, 3, 1])[0] * r.uniform(0.9, 1.1) for _ in range(70))] for k in ("a", "b|c")}
    rows = golden(spark, trains).withColumn("manual", F.lit("tonic"))
    v = tu.variants(spark, ["seed_high", "hfs_spikes"], Grammar(hfs_spikes=12))
    assert [(x.variant, x.seed_high, x.hfs_spikes) for x in v.orderBy("place").collect()] == [("baseline", 0.01, 12), ("seed_high_decrease", 0.0075, 12), ("seed_high_increase", 0.0125, 12), ("hfs_spikes_decrease", 0.01, 9), ("hfs_spikes_increase", 0.01, 15)]
    some = v.where("variant in ('baseline', 'seed_high_increase')")
    got = {tuple(x) for x in tu.detected_variants(rows, rows.select("train").distinct().join(some)).collect()}
    want = set()
    for name, g in (("baseline", Grammar(hfs_spikes=12)), ("seed_high_increase", Grammar(seed_high=0.0125, hfs_spikes=12))):
        out, _ = de.detect(rows.drop("manual"), g)
        want |= {(name, x.train, x.label, x.start, x.end) for x in segments(out, F.col("auto")).where("label <> ''").collect()}
    assert got == want and len({x[0] for x in got}) == 2


@pytest.mark.parametrize("n", [1, 2, 8, 9, 60])
def test_sign_flips(spark, n):
    r = random.Random(n)
    d = {"mixed": [r.choice([-0.2, 0.0, 0.1, 0.3]) for _ in range(n)], "none": [0.0] * n, "all": [0.1] * n}
    df = spark.createDataFrame([(v, i, x) for v, xs in d.items() for i, x in enumerate(xs)] + [("mixed", 99, None)], "variant string, train int, difference double")
    got = {x.variant: x for x in tu.sign_flips(df, 299).collect()}
    for v, xs in d.items():
        units = [round(x * 1e12) for x in xs]
        assert got[v].pairs == n and got[v].mean == pytest.approx(sum(xs) / n, abs=1e-9)
        if n < 2:
            assert got[v].p is None
        elif not any(units):
            assert got[v].p == 1
        elif n <= 8:  # 2^n is no more than 300
            k = sum(abs(sum(a * b for a, b in zip(s, units, strict=True))) >= abs(sum(units)) for s in itertools.product((-1, 1), repeat=n))
            assert got[v].p == pytest.approx((1 + k) / (2**n + 1))
        else:
            near = [abs(sum(r.choice((-1, 1)) * b for b in units)) >= abs(sum(units)) for _ in range(4000)]
            assert abs(got[v].p - sum(near) / 4000) < 0.12
            assert round(got[v].p * 300, 6) == round(got[v].p * 300)
    assert {tuple(x) for x in tu.sign_flips(df.repartition(5), 299).collect()} == {tuple(x) for x in got.values()}


def table(spark, seed, trains=30):
    r, rows = random.Random(seed), []
    for v, good in (("baseline", 0.5), ("x_decrease", 0.2), ("x_increase", 0.9)):
        for t, label in itertools.product(range(trains), ("burst", "pause")):
            truth = (t % 4) if label == "burst" else t % 3
            pred = r.randint(0, 4)
            rows.append((v, t, label, truth, pred, sum(r.random() < good for _ in range(min(truth, pred)))))
    names = spark.createDataFrame([("baseline", 0, None, None), ("x_decrease", 1, "x", 0.5), ("x_increase", 2, "x", 1.5)], "variant string, place int, setting string, value double")
    return spark.createDataFrame(rows, COUNTS), rows, names


def f1(truth, pred, tp):
    p, r = tp / pred if pred else None, tp / truth if truth else None
    return 2 * p * r / (p + r) if p is not None and r is not None and p + r > 0 else None


def macro(rows):
    by = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        by[r[2]] = [a + b for a, b in zip(by[r[2]], r[3:], strict=True)]
    some = [x for x in (f1(*v) for v in by.values()) if x is not None]
    return sum(some) / len(some) if some else None


def test_sensitivity(spark):
    c, rows, names = table(spark, 1)
    got = {x.variant: x for x in tu.sensitivity(c, names).collect()}
    base = macro([x for x in rows if x[0] == "baseline"])
    tests = {}
    for v in got:
        mine = [x for x in rows if x[0] == v]
        assert got[v].macro_f1 == pytest.approx(macro(mine)) and got[v].change == pytest.approx(macro(mine) - base)
        d = []
        for t in range(30):
            a, b = (macro([x for x in rows if x[0] == w and x[1] == t]) for w in (v, "baseline"))
            d += [a - b] if a is not None and b is not None else []
        if v != "baseline":
            assert got[v].pairs == len(d) and got[v].mean == pytest.approx(sum(d) / len(d))
            tests[v] = got[v].p
    order = sorted(tests, key=tests.get)
    q = {order[1]: tests[order[1]], order[0]: min(2 * tests[order[0]], tests[order[1]])}
    for v in tests:
        assert got[v].q == pytest.approx(q[v])
        assert got[v].flag == ("sensitive_after_BH_FDR" if q[v] <= 0.05 and abs(got[v].change) >= 0.02 else "stable_within_effect_threshold" if abs(got[v].change) < 0.02 else "not_significant_after_BH_FDR")
    assert got["baseline"].flag == "baseline" and got["baseline"].p is None


def trains_and_truth(spark, n=40):
    r = random.Random(6)
    kinds = {t: r.choice([("burst",), ("burst", "pause"), ("pause",), ()]) for t in range(n)}
    duration = {t: r.choice([1.0, 2.0, 2.5, 4.0, 7.0, 9.0]) for t in range(n)}
    truth = spark.createDataFrame([(t, k) for t, ks in kinds.items() for k in ks for _ in range(2)], "train int, label string")
    return kinds, duration, truth, spark.createDataFrame(list(duration.items()), "train int, duration double")


def test_strata_and_splits(spark):
    kinds, duration, truth, trains = trains_and_truth(spark)
    own = tu.strata(trains, truth)
    s = sorted(duration.values())
    cut = [s[0], *(s[math.floor(h)] + (h % 1) * (s[math.ceil(h)] - s[math.floor(h)]) for h in ((len(s) - 1) / 3, 2 * (len(s) - 1) / 3)), s[-1]]
    want = {t: "+".join(kinds[t] or ("none",)) + "|" + ("short" if d <= cut[1] else "medium" if d <= cut[2] else "long") for t, d in duration.items()}
    stratum = {x.train: x.stratum for x in own.collect()}
    assert stratum == want
    splits = tu.stratified_splits(own.withColumn("repeat", F.explode(F.array(*[F.lit(k) for k in range(1, 9)]))), ["repeat"], 0.3, seed=4).collect()
    seen = set()
    for k in range(1, 9):
        mine = {x.train: x.part for x in splits if x.repeat == k}
        assert {t for t, p in mine.items() if p == "unlabelled"} == {t for t, ks in kinds.items() if not ks}
        labelled = [t for t in mine if kinds[t]]
        val = {t for t in labelled if mine[t] == "validation"}
        for st in set(stratum.values()):
            members = [t for t in labelled if stratum[t] == st]
            if len(members) >= 2:
                assert len(val & set(members)) >= min(max(1, math.floor(len(members) * 0.3)), len(members) - 1)
        first = sum(min(max(1, math.floor(n * 0.3)), n - 1) for n in ([stratum[t] for t in labelled].count(st) for st in set(stratum.values())) if n >= 2)
        assert len(val) == max(first, min(max(1, math.floor(len(labelled) * 0.3)), len(labelled) - 1))
        seen.add(frozenset(val))
    assert len(seen) > 4 and {x.note for x in splits} == {tu.SPLIT_NOTES[0]}


def test_repeated_holdout(spark):
    c, rows, names = table(spark, 3, 40)
    kinds, duration, truth, trains = trains_and_truth(spark)
    out = {k: v.collect() for k, v in tu.repeated_holdout(c, names, trains, truth, repeats=6).items()}
    plain = {k: v.collect() for k, v in tu.repeated_holdout(c, names, trains, truth, repeats=6, nested=False).items()}
    assert {tuple(x) for x in out["splits"]} == {tuple(x) for x in plain["splits"]}
    assert {x.variant for x in plain["choices"]} == {"baseline"} and {x.variant for x in out["choices"]} == {"x_increase"}
    for result in (out, plain):
        variant = {x.repeat: x.variant for x in result["choices"]}
        values = defaultdict(list)
        for k in range(1, 7):
            held = {x.train for x in result["splits"] if x.repeat == k and x.part == "validation"}
            mine = [x for x in rows if x[0] == variant[k] and x[1] in held]
            for label in ("burst", "pause"):
                want = [sum(x[i] for x in mine if x[2] == label) for i in (3, 4, 5)]
                (m,) = [x for x in result["metrics"] if x.repeat == k and x.label == label]
                assert [m.truth_n, m.pred_n, m.tp] == want
                assert (m.f1 is None) == (f1(*want) is None) and (m.f1 is None or m.f1 == pytest.approx(f1(*want)))
                values[label] += [m.f1] if m.f1 is not None else []
            (x,) = [x for x in result["repeats"] if x.repeat == k]
            assert x.validation_n == len(held) and (x.macro_f1 is None) == (macro(mine) is None)
            assert x.macro_f1 == pytest.approx(macro(mine))
        for s in result["summary"]:
            assert s.f1 == pytest.approx(sum(values[s.label]) / len(values[s.label])) and s.f1_q05 <= s.f1_q50 <= s.f1_q95


def test_choice_on_the_inner_split(spark):
    c, rows, names = table(spark, 5)
    r = random.Random(1)
    part = {(g, t): r.choice(["validation", "calibration", "unlabelled"]) for g in range(5) for t in range(30)} | {(5, t): "calibration" for t in range(30)}
    inner = spark.createDataFrame([(g, t, p) for (g, t), p in part.items()], "repeat int, train int, part string")
    got = {x.repeat: x for x in tu.chosen(c, names, inner, ["repeat"]).collect()}
    for g in range(5):
        score = {v: macro([x for x in rows if x[0] == v and part[g, x[1]] == "validation"]) for v in ("baseline", "x_decrease", "x_increase")}
        best = max(score, key=lambda v: score[v])
        assert got[g].variant == best and got[g].score == pytest.approx(score[best])
    assert got[5].variant == "baseline" and got[5].score is None
