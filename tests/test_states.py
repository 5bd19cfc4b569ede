"""Spiking states: how they are found, which of them stand, and what they strike out."""

import math
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.grammar import Grammar
from pulsegrid.operators import detectors as de
from pulsegrid.operators.bounds import Bounds
from pulsegrid.operators.runs import support_runs
from pulsegrid.sources.csv import golden

FOUND = (
    "train string, candidate int, start long, end long, label string, action string, duration double, q90 double, cv double, lv double, mm double, pre double, post double, short double, bridged double, "
    "large double, tolerated_gap double, q90_most double"
)
EMPTY = {"cv": 0.2, "lv": 0.1, "mm": 1.5, "pre": 0.05, "post": 0.05, "short": 0.5, "bridged": 0.8, "large": 0.02, "tolerated_gap": 0.075, "q90": 0.02, "q90_most": 0.025, "duration": 0.1, "action": "accept"}


def table(spark, rows):
    names = [c.split()[0] for c in FOUND.split(", ")]
    full = [EMPTY | {"train": "t", "candidate": i} | r for i, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in full], FOUND)


def state(a, b, **more):
    return {"start": a, "end": b, "label": "high_frequency_spiking"} | more


def burst(a, b, **more):
    return {"start": a, "end": b, "label": "burst"} | more


def actions(spark, rows):
    return {r.candidate: (r.action if r.label == "reject" else "") for r in de.protected(table(spark, rows)).collect()}


def test_variants_of_one_burst_are_one_group(spark):
    rows = [state(1, 100), *[burst(40 - i, 44 + j) for i in range(3) for j in range(3)]]
    assert actions(spark, rows)[1] == ""


def test_bursts_that_dominate(spark):
    six = [burst(10 * k, 10 * k + 4) for k in range(1, 7)]
    assert actions(spark, [state(1, 100), *six])[1] == de.DOMINATED
    assert actions(spark, [state(1, 100), *six[:5]])[1] == ""  # too few groups
    assert actions(spark, [state(1, 130), *six])[1] == ""  # too few for its length, and too little cover
    assert actions(spark, [state(12, 100), *six])[1] == ""  # the first isn't inside


def test_packets_in_a_state_that_varies(spark):
    two = [burst(10, 22), burst(60, 71)]
    assert actions(spark, [state(1, 100, cv=0.8, lv=0.6, mm=3.5), *two])[1] == de.PACKETS
    assert actions(spark, [state(1, 100), *two])[1] == ""
    assert actions(spark, [state(1, 100, large=0.1), *two])[1] == de.PACKETS
    assert actions(spark, [state(1, 100, lv=0.5), burst(10, 27)])[1] == de.PACKETS
    assert actions(spark, [state(1, 100, lv=0.5), burst(10, 20)])[1] == ""


def test_neighbours_of_packets(spark):
    packet = [state(1, 100, cv=0.8), burst(10, 30)]
    assert actions(spark, [*packet, state(104, 150, cv=0.7, pre=0.06)])[3] == de.NEIGHBOUR
    assert actions(spark, [*packet, state(105, 150, cv=0.7, pre=0.06)])[3] == ""  # four intervals between them
    assert actions(spark, [*packet, state(104, 150, cv=0.7, pre=0.09)])[3] == ""  # a long gap
    assert actions(spark, [*packet, state(104, 150, cv=0.3, large=0.2, pre=0.06)])[3] == ""  # regular
    chain = actions(spark, [*packet, state(103, 150, cv=0.7), state(152, 200, cv=0.7)])
    assert (chain[3], chain[4]) == (de.NEIGHBOUR, "")


def test_what_states_strike_out(spark):
    rows = [state(1, 100, short=0.8, bridged=0.95), burst(10, 17), burst(20, 28), burst(40, 44, duration=0.3), {"start": 95, "end": 120, "label": "tonic"}, {"start": 101, "end": 120, "label": "pause"}]
    got = actions(spark, rows)
    assert [got[i] for i in range(1, 7)] == ["", de.EMBEDDED, "", "", de.COVERED, ""]
    assert actions(spark, [state(1, 40, short=0.8, bridged=0.99), burst(10, 14)])[2] == ""
    assert actions(spark, [state(1, 40, short=0.9, bridged=0.99), burst(10, 14)])[2] == de.EMBEDDED
    assert actions(spark, [state(1, 40, short=0.9, bridged=0.99, q90=0.03), burst(10, 14)])[2] == ""


def plain(rows):
    """The same rules, one candidate at a time."""
    out = {i: "" for i in range(1, len(rows) + 1)}
    rows = [EMPTY | r | {"id": i} for i, r in enumerate(rows, 1)]
    by = lambda t, *labels: [r for r in rows if r["train"] == t and r["label"] in labels]
    for t in {r["train"] for r in rows}:
        packets = []
        varies = lambda h: h["cv"] >= 0.65 or h["lv"] >= 0.45 or h["mm"] >= 3
        states = by(t, "high_frequency_spiking")
        for h in states:
            held = [b for b in by(t, "burst", "long_burst") if b["start"] >= h["start"] and b["end"] <= h["end"]]
            n = h["end"] - h["start"] + 1
            cells = sorted({i for b in held for i in range(b["start"], b["end"] + 1)})
            groups, last = 0, -1
            for b in sorted(held, key=lambda b: (b["start"], b["end"])):
                groups, last = groups + (b["start"] > last), max(last, b["end"])
            share = len(cells) / n
            packet = (varies(h) or h["large"] >= 0.08) and ((groups >= 2 and share >= 0.08) or (groups >= 1 and share >= 0.18))
            packets += [h] * packet
            if groups >= max(6, math.ceil(0.055 * n)) and share >= 0.25:
                out[h["id"]] = de.DOMINATED
            elif packet:
                out[h["id"]] = de.PACKETS
        for h in states:
            if out[h["id"]] or not varies(h):
                continue
            for p in packets:
                gap, seconds = (h["start"] - p["end"] - 1, h["pre"]) if p["end"] < h["start"] else (p["start"] - h["end"] - 1, h["post"]) if h["end"] < p["start"] else (0, 0)
                if gap <= 3 and seconds <= max(h["tolerated_gap"], p["tolerated_gap"]):
                    out[h["id"]] = de.NEIGHBOUR
        for h in states:
            if out[h["id"]]:
                continue
            n = h["end"] - h["start"] + 1
            for w in by(t, "possible_burst", "tonic", "high_frequency_tonic", "pause"):
                if w["start"] <= h["end"] and w["end"] >= h["start"]:
                    out[w["id"]] = de.COVERED
            if h["q90"] <= h["q90_most"] and ((n >= 80 and h["short"] >= 0.7 and h["bridged"] >= 0.9) or (n >= 30 and h["short"] >= 0.85 and h["bridged"] >= 0.95)):
                for b in by(t, "burst", "long_burst"):
                    if b["start"] >= h["start"] and b["end"] <= h["end"] and b["end"] - b["start"] + 1 <= max(8, math.ceil(0.06 * n)) and b["duration"] <= 0.25:
                        out[b["id"]] = de.EMBEDDED
    return out


def test_rules_one_by_one(spark):
    r, rows = random.Random(11), []
    for t in range(60):
        at = 1
        for _ in range(r.randint(1, 4)):
            n = r.choice([35, 60, 90, 150])
            rows.append(state(at, at + n - 1, train=f"t{t}", cv=r.choice([0.3, 0.3, 0.7]), lv=r.choice([0.1, 0.1, 0.5]), mm=r.choice([1.5, 1.5, 3.2]), large=r.choice([0.02, 0.02, 0.1]), short=r.choice([0.5, 0.75, 0.9]), bridged=r.choice([0.8, 0.92, 0.97, 0.98]), q90=r.choice([0.02, 0.03]), pre=r.choice([0.05, 0.09]), post=r.choice([0.05, 0.09]), tolerated_gap=r.choice([0.075, 0.1])))
            for _ in range(r.choice([0, 1, 2, 25])):
                a = at + r.randint(-3, n - 2)
                rows.append(burst(a, a + r.randint(0, 5), train=f"t{t}", label=r.choice(["burst", "burst", "burst", "long_burst", "possible_burst", "tonic", "pause"]), duration=r.choice([0.1, 0.3])))
            at += n + r.choice([-10, 0, 1, 3, 4, 8])
    want = plain(rows)
    assert set(want.values()) == {"", de.DOMINATED, de.PACKETS, de.NEIGHBOUR, de.COVERED, de.EMBEDDED}
    assert actions(spark, rows) == want


def spans(spark, isi, manual=None, g=None):
    rows = de.usable(golden(spark, {"t": [0, *accumulate(isi)]}).withColumn("manual", F.lit("")))
    for k, v in (manual or {}).items():
        rows = rows.withColumn("manual", F.when(F.col("idx") == k, v).otherwise(F.col("manual")))
    g = g or Grammar()
    return sorted((r.start, r.end) for r in de.high_frequency_spiking(rows, de.references(rows, g), g).collect())


def test_hard_break_parts_states(spark):
    one = [0.01] * 40
    assert spans(spark, [*one, 0.036, *one]) == [(2, 82)]  # over the bridge, under the hard break
    assert spans(spark, [*one, 0.05, *one]) == [(2, 41), (43, 82)]  # tolerated once, but as long as the hard break
    assert spans(spark, [*one, 0.05, *one], g=Grammar(hfs_break=0.06)) == [(2, 82)]
    assert spans(spark, [*one, 0.036, *one], g=Grammar(hfs_max=0.03)) == [(2, 41), (43, 82)]
    assert spans(spark, [*one, *[0.036] * 4, *one]) == [(2, 41), (46, 85)]  # four in a row


def test_artifacts_and_labels_by_hand_in_gaps(spark):
    long, short = [0.01] * 40, [0.01] * 20
    assert spans(spark, [*short, 0.0001, *short]) == [(2, 42)]  # too short alone: the artifact doesn't part it
    assert spans(spark, [*long, 0.0001, *long]) == [(2, 41), (43, 82)]  # long enough alone
    assert spans(spark, [*short, 0.0001, *short, 0.0001, *short]) == [(2, 42)]  # it has grown: the rest is too short
    assert spans(spark, [*long, 0.036, *long], {42: "burst"}) == [(2, 41), (43, 82)]
    assert spans(spark, [*short, 0.0001, *short], {22: "burst"}) == []  # a label by hand inside
    assert spans(spark, [*long, 0.036, *long], {42: "tonic"}) == [(2, 82)]


def test_runs_across_artifacts_are_a_fold(spark):
    r = random.Random(3)
    isi = {f"t{k}": [r.choices([0.01, 0.036, 0.0001, 0.2], [8, 2, 3, 0.4])[0] for _ in range(120)] for k in range(12)}
    rows = de.usable(golden(spark, {k: [0, *accumulate(v)] for k, v in isi.items()})).withColumn("side", F.lit(5))
    got = {(x.train, x.start, x.end, x.support) for x in support_runs(rows, F.col("isi") <= 0.02, 0.04, 0.05, 2, transparent=F.col("artifact"), short_side="side").collect()}
    want = set()
    for t, v in isi.items():
        kind = ["" for _ in range(2)] + ["s" if 0.001 <= x <= 0.02 else "g" if 0.001 <= x <= 0.04 else "a" if x < 0.001 else "" for x in v]
        runs, k = [], 2
        while k < len(kind):
            if kind[k] == "s":
                e = k
                while e + 1 < len(kind) and kind[e + 1] == "s":
                    e += 1
                runs.append([k, e])
                k = e
            k += 1
        grown = []
        for a, b in runs:
            if grown:
                between = kind[grown[-1][1] + 1 : a]
                if all(between) and len(between) <= 2 and ("a" not in between or grown[-1][1] - grown[-1][0] + 1 <= 5):
                    grown[-1][1] = b
                    continue
            grown.append([a, b])
        want |= {(t, a, b, kind[a : b + 1].count("s")) for a, b in grown}
    assert got == want


def detected(spark, trains, g):
    rows = golden(spark, trains).withColumn("manual", F.lit(""))
    out, ledger = de.detect(rows, g)
    return {(r.train, r.idx): r.auto for r in out.collect()}, sorted((r.train, r.start, r.end, r.layer, r.gate, r.label, r.action, round(r.score, 9), r.selected) for r in ledger.collect())


def test_settings_of_a_table(spark):
    r = random.Random(8)
    isi = [r.choices([0.006, 0.012, 0.03, 0.05, 0.3], [5, 3, 3, 3, 1])[0] * r.uniform(0.9, 1.1) for _ in range(150)]
    trains = {k: [0, *accumulate(isi)] for k in ("a", "b", "c")}
    g = Grammar(seed_high=0.011, bridge=0.017, pause_min=0.2, hfs_spikes=12)
    own = "train string, seed_high double, bridge double, pause_min double, hfs_spikes int, long_spikes_low int"
    same = spark.createDataFrame([(k, 0.011, 0.017, 0.2, 12, None) for k in trains], own)
    assert detected(spark, trains, same) == detected(spark, trains, g)
    apart = spark.createDataFrame([("a", 0.011, 0.017, 0.2, 12, 11), ("b", 0.02, 0.04, 0.2, 12, 11)], own)  # c has the defaults
    labels, ledger = detected(spark, trains, apart)
    for k, alone in (("a", g), ("b", Grammar(seed_high=0.02, bridge=0.04, pause_min=0.2, hfs_spikes=12)), ("c", Grammar())):
        want, rows = detected(spark, {k: trains[k]}, alone)
        assert {x: v for x, v in labels.items() if x[0] == k} == want
        assert [x for x in ledger if x[0] == k] == rows
    one = lambda k: [v for (t, _), v in sorted(labels.items()) if t == k]
    assert one("a") != one("b") != one("c")


def test_unknown_settings(spark):
    with pytest.raises(ValueError):
        Bounds(spark.createDataFrame([("a", 1.0)], "train string, odd double"))
    assert Bounds(Grammar(max_extension=3)).most("max_extension") == 3
