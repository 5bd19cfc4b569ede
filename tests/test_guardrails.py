"""Events of predictions, near misses, blocks of short intervals and packets, against plain Python and small cases."""

import random
import statistics
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.grammar import Grammar
from pulsegrid.operators import detectors as de
from pulsegrid.operators import guardrails as gr
from pulsegrid.operators import proposals as pp
from pulsegrid.sources.csv import golden

SAID = "train string, idx int, label string, confidence double, accepted boolean, prob_spiking double, probabilities map<string, double>"


def rows_of(spark, trains):
    return golden(spark, {k: [0, *accumulate(v)] for k, v in trains.items()})


def test_spiking_comes_from_long_states_only(spark):
    rows = rows_of(spark, {"long": [0.01] * 20 + [0.05] + [0.01] * 20, "short": [0.01] * 10, "far": [0.01] * 20 + [0.09] + [0.01] * 20, "slow": [0.03] * 40})
    said = [("long", i, "high_frequency_spiking", 0.8, True, None, None) for i in range(2, 43) if i != 22] + [("short", i, "high_frequency_spiking", 0.9, True, None, None) for i in range(2, 12)]
    said += [("far", i, "tonic", 0.9, False, 0.6, None) for i in range(2, 43)] + [("slow", i, "high_frequency_spiking", 0.9, True, None, None) for i in range(2, 42)]
    said += [("long", 22, "tonic", 0.9, True, None, None)]
    got = {tuple(r) for r in gr.guarded(rows, spark.createDataFrame(said, SAID)).collect()}
    assert {(r[0], r[1], r[2], r[3]) for r in got} == {("long", 2, 42, "high_frequency_spiking")}
    assert next(iter(got))[5] == pytest.approx(0.8)


def test_runs_must_look_like_their_label(spark):
    isi = [0.3, 0.008, 0.009, 0.3, *[0.03, 0.031, 0.03, 0.032], 0.3, *[0.02, 0.2, 0.02, 0.2], 0.3, 0.03, 0.3]
    rows = rows_of(spark, {"t": isi}).withColumn("manual", F.when(F.col("idx") == 16, "pause").otherwise(""))
    kinds = {3: "burst_family", 4: "burst_family", 6: "tonic", 7: "tonic", 8: "tonic", 9: "tonic", 11: "tonic", 12: "tonic", 13: "tonic", 14: "tonic", 10: "pause", 16: "burst", 15: "burst"}
    other = {"tonic": 0.5, "pause": 0.3, "burst": 0.2}
    said = spark.createDataFrame([("t", i, k, 0.9, True, None, other) for i, k in kinds.items()], SAID)
    got = {(r.start, r.end): (r.label, r.predicted) for r in gr.guarded(rows, said).collect()}
    assert got == {(3, 4): ("possible_burst", "possible_burst"), (6, 9): ("tonic", "tonic"), (10, 10): ("pause", "pause")}
    more = {(r.start, r.end): (r.label, r.predicted) for r in gr.guarded(rows, said, fallback=True).collect()}
    assert more == got | {(11, 14): ("pause", "tonic")}  # uneven, but some of it is long


def test_near_misses_of_single_gates(spark):
    g = Grammar(pause_min=0.2)
    rows = rows_of(spark, {"t": [0.05] * 12 + [0.19] + [0.05] * 12 + [0.3] + [0.05] * 12, "u": [0.02] * 13})
    got = {(r.train, r.start, r.layer): (r.gate, r.by, r.failed) for r in de.gate_near_misses(rows, g, layers=("pause",)).collect()}
    assert set(got) == {("t", 14, "pause")} and got["t", 14, "pause"][0] == "floor" and got["t", 14, "pause"][1] == pytest.approx(0.05) and got["t", 14, "pause"][2] == 1
    found = de.detect(rows.withColumn("manual", F.lit("")), g)[1]
    assert {(r.train, r.start) for r in found.where("layer = 'pause'").collect()} == {("t", 27)}


def test_a_relaxed_gate_finds_what_nearly_missed(spark):
    """What is a near miss of spiking by its share of large intervals is found with that limit moved."""
    isi = ([0.01] * 2 + [0.036]) * 20
    rows = rows_of(spark, {"t": isi})
    base = Grammar(hfs_break=0.06, hfs_q80=0.04)
    assert not [r for r in de.detect(rows.withColumn("manual", F.lit("")), base)[1].collect() if r.layer == "hf_spiking"]
    (miss,) = de.gate_near_misses(rows, base, slack=0.4, layers=("hf_spiking",)).collect()
    assert miss.gate in ("large", "compact")
    wide = Grammar(hfs_break=0.06, hfs_q80=0.04, hfs_large_share=0.3 * (1 + miss.by) + 1e-9, hfs_q90=0.036)
    assert [(r.start, r.end) for r in de.detect(rows.withColumn("manual", F.lit("")), wide)[1].collect() if r.layer == "hf_spiking"] == [(miss.start, miss.end)]


def test_near_misses_of_bursts(spark):
    two = [0.02, 0.008, 0.008, 0.015, *[0.05] * 10]  # contrast 1.9 instead of 2
    rows = rows_of(spark, {"t": [0.05] * 6 + [0.0152, 0.008, 0.008, 0.008, 0.0152] + [0.05] * 6, "u": two})
    got = [r for r in de.gate_near_misses(rows, Grammar(bridge=0.0101, rescue_ratio=9.0), layers=("burst",)).collect() if r.train == "t"]
    assert [(r.start, r.end, r.gate) for r in got] == [(9, 11, "contrast")] and got[0].by == pytest.approx(0.05)


def test_seed_blocks(spark):
    r = random.Random(5)
    isi = {f"t{k}": [r.choices([0.01, 0.025, 0.08, 0.0001], [4, 2, 3, 1])[0] * r.uniform(0.95, 1.05) for _ in range(90)] for k in range(8)}
    rows = rows_of(spark, isi)
    by = {}
    for x in rows.orderBy("train", "idx").collect():
        by.setdefault(x.train, []).append(x)
    want = set()
    for t, xs in by.items():
        at = {x.idx: x for x in xs}
        real = lambda i: at[i].isi is not None and not at[i].artifact  # noqa: B023, E731

        def median(i):
            v = [at[j].isi for j in range(i - 5, i + 6) if j != i and j in at and at[j].valid]  # noqa: B023
            return statistics.median(v) if v else None

        def near(i, ratio):
            m = median(i)
            return m is not None and m > 0 and at[i].isi <= m / ratio  # noqa: B023

        seed = {i for i in at if real(i) and (at[i].isi <= 0.02 or near(i, 1.4))}
        blocks, i, n = [], 2, len(xs)
        while i <= n:
            if i in seed:
                j = i
                while j + 1 <= n and (j + 1 in seed or at[j + 1].artifact):
                    j += 1
                blocks.append([i, j])
                i = j
            i += 1
        merged = []
        for a, b in blocks:
            if merged:
                between = [k for k in range(merged[-1][1] + 1, a) if not at[k].artifact]
                if len(between) <= 1 and all(real(k) and (at[k].isi <= 0.03 or near(k, 1.4 * 0.85)) for k in between):
                    merged[-1][1] = b
                    continue
            merged.append([a, b])
        want |= {(t, a, b) for a, b in merged}
    assert {tuple(x) for x in pp.seed_blocks(rows).collect()} == want and len(want) > 20


def test_packets_with_gaps(spark):
    r = random.Random(2)
    isi = {}
    for k in range(12):
        steady = [0.03 * r.uniform(0.9, 1.1) for _ in range(r.randint(5, 14))]
        isi[f"t{k}"] = [0.2, *steady, *[0.1] * r.randint(0, 2), *[0.008 * r.uniform(0.8, 1.2) for _ in range(4)], *[0.09] * r.randint(0, 2), *steady[::-1], 0.3, 0.3]
    rows = rows_of(spark, isi).withColumn("auto", F.when(F.col("isi") < 0.01, "burst").otherwise(""))
    p = pp.Packet(gap=2, gap_seconds=0.15)
    got = {(x.train, x.side, x.gap, x.start, x.end): x.score for x in pp.regular_packets(rows, p=p).collect()}
    import numpy as np

    want = {}
    for t, v in isi.items():
        x = [None, None, *v]  # x[i] is the interval of row i
        n = len(x) - 1
        burst = [i for i in range(2, n + 1) if x[i] < 0.01]
        bs, be = burst[0], burst[-1]
        for side in ("regular_before_burst", "regular_after_burst"):
            found = []
            for gap in range(3):
                for w in range(4, 17):
                    a, b = (bs - gap - w, bs - gap - 1) if side == "regular_before_burst" else (be + 1 + gap, be + gap + w)
                    between = x[b + 1 : bs] if side == "regular_before_burst" else x[be + 1 : a]
                    if a < 3 or b > n - 1 or sum(between) > 0.15:
                        continue
                    vals = x[a : b + 1]
                    q10, q90 = np.quantile(vals, [0.1, 0.9])
                    mean = sum(vals) / w
                    cv, mm = statistics.stdev(vals) / mean, max(vals) / mean
                    lv = statistics.mean(3 * (c - d) ** 2 / (c + d) ** 2 for c, d in zip(vals, vals[1:], strict=False))
                    ratio = q90 / np.quantile(x[bs : be + 1], 0.9)
                    if q10 >= 0.012 and q90 <= 0.06 and cv <= 0.45 and lv <= 0.6 and mm <= 1.65 and q90 / q10 <= 2.4 and ratio >= 1.35:
                        score = 2.2 - cv - 0.7 * lv - 0.25 * max(0, mm - 1) + 0.08 * np.log(w + 1) + 0.35 * np.log(max(1.01, ratio)) + 0.2 * (gap == 0)
                        found.append((-score, gap, a, b))
            kept = []
            for s, gap, a, b in sorted(found):
                if not any((min(b, d) - max(a, c) + 1) / min(b - a + 1, d - c + 1) >= 0.5 for _, _, c, d in kept):
                    kept.append((s, gap, a, b))
            want |= {(t, side, gap, a, b): -s for s, gap, a, b in kept}
    assert got.keys() == want.keys() and len(want) > 10
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_best_boundaries_of_long_spans(spark):
    r = random.Random(4)
    isi = {f"t{k}": [r.choices([0.008, 0.02, 0.1], [5, 3, 2])[0] * r.uniform(0.7, 1.3) for _ in range(60)] for k in range(4)}
    rows = rows_of(spark, isi)
    spans = [(t, a, a + r.randint(1, 25)) for t in isi for a in (3, 9, 20, 30)]
    g = pp.Context(radius=2)
    df = spark.createDataFrame(spans, "train string, start int, end int")
    every = [(t, a, b) for t in isi for a in range(2, 62) for b in range(a, min(61, a + 30) + 1)]
    score = {(x.train, x.start, x.end): x.score for x in pp.scored(rows, spark.createDataFrame(every, "train string, start int, end int"), g).collect()}
    for x in pp.optimised(rows, df, g).collect():
        near = {(a, b): score[x.train, a, b] for a in range(x.start - 2, x.start + 3) for b in range(x.end - 2, x.end + 3) if (x.train, a, b) in score}
        assert x.score == pytest.approx(max(near.values())) and near[x.best_start, x.best_end] == pytest.approx(x.score)
