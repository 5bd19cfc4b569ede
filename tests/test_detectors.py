"""Detectors on small trains whose results are known."""

from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.grammar import Grammar
from pulsegrid.operators import detectors as de
from pulsegrid.operators import support as su
from pulsegrid.operators import thresholds as th
from pulsegrid.sources.csv import GOLDEN, golden

MID, SLOW = [0.45, 0.48, 0.50, 0.47, 0.46, 0.49, 0.45, 0.48], [0.45]


def times(isi):
    return [0, *accumulate(isi)]


TRAINS = GOLDEN | {
    "gap": times([0.010] * 90 + [0.110] + [0.010] * 90),
    "pause": times([*MID, 1.2, *MID]),
    "adaptive": times(SLOW * 6 + [0.04] * 6 + SLOW * 8 + [1.2] + SLOW * 7 + [0.04] * 6 + SLOW * 7),
}


@pytest.fixture(scope="module")
def found(spark):
    rows, ledger = de.detect(golden(spark, TRAINS).withColumn("manual", F.lit("")))
    labels = {}
    for r in rows.where("auto <> ''").orderBy("train", "idx").collect():
        labels.setdefault(r.train, {})[r.idx] = r.auto
    return labels, {(r.train, r.start, r.end, r.layer): r for r in ledger.where("label <> 'reject'").collect()}


def test_burst_in_the_middle(found):
    labels, ledger = found
    r = ledger["middle_burst", 4, 6, "burst"]
    assert (r.label, r.priority, r.gate, r.selected) == ("burst", 1250.0, "two_sided", True)
    assert r.score == pytest.approx(20.83, abs=1e-8)
    assert labels["middle_burst"] == {4: "burst", 5: "burst", 6: "burst", 7: "pause"}


def test_burst_at_the_edge(found):
    labels, ledger = found
    r = ledger["boundary_start", 2, 4, "burst"]
    assert (r.label, r.priority, r.gate) == ("possible_burst", 760.0, "edge_limited")
    assert labels["boundary_start"] == {2: "possible_burst", 3: "possible_burst", 4: "possible_burst", 5: "pause"}


def test_pause_parts_spiking_states(found):
    labels, ledger = found
    assert labels["gap"][92] == "pause"
    assert {v for k, v in labels["gap"].items() if k != 92} == {"high_frequency_spiking"}
    assert not any(t == "gap" and s < 92 < e and r.selected for (t, s, e, _), r in ledger.items())


def test_relative_pause(found):
    labels, _ = found
    assert [k for k, v in labels["pause"].items() if v == "pause"] == [10]
    assert {k for k, v in labels["pause"].items() if v == "tonic"} >= {4, 5, 7, 8, 13, 14, 16, 17}


def test_bands_of_a_slow_train(spark):
    rows = golden(spark, {"adaptive": TRAINS["adaptive"]}).withColumn("manual", F.lit(""))
    bands = th.resolved(spark, th.histogram_bands(rows))
    out, _ = de.detect(rows, th.settings(bands))
    n = {r["auto"]: r["count"] for r in out.groupBy("auto").count().collect()}
    assert n["tonic"] >= 20 and n["burst"] >= 10 and n["pause"] == 1


def test_bands_resolve_by_priority(spark):
    r = {(x.pattern, x.field): x for x in th.resolved(spark, th.DEFAULT_BANDS, manual={"burst": (None, 0.009, None)}, user={"burst": (0.02, None, None)}).collect()}
    assert (r["burst", "low"].source, r["burst", "high"].source, r["burst", "bridge"].source) == ("user", "manual", "histogram")
    assert r["burst", "low"].effective < r["burst", "high"].effective <= r["burst", "bridge"].effective


def test_selection_is_best(spark):
    import itertools
    import random

    rnd = random.Random(4)
    rows = [("t", i + 1, s := rnd.randint(2, 30), s + rnd.randint(0, 8), "x", "tonic", 0.0, float(rnd.randint(1, 40)), 1) for i in range(12)]
    df = spark.createDataFrame(rows, "train string, candidate int, start long, end long, layer string, label string, score double, priority double, n_isi long")
    df = df.withColumn("train", F.lit(1).cast("long"))
    got = {r.candidate for r in de.select(df).where("selected").collect()}
    worth = {r[1]: r[7] * 10000 + 1 for r in rows}
    apart = lambda c: all(a[3] < b[2] or b[3] < a[2] for a, b in itertools.combinations(c, 2))
    best = max(sum(worth[x[1]] for x in c) for n in range(1, 13) for c in itertools.combinations(rows, n) if apart(c))
    assert sum(worth[c] for c in got) == best and apart([r for r in rows if r[1] in got])


def test_manual_labels_win(spark):
    rows = golden(spark, {"middle_burst": GOLDEN["middle_burst"]}).withColumn("manual", F.when(F.col("idx").between(4, 6), "burst").otherwise(""))
    out, _ = de.detect(rows)
    final = de.final_labels(out)
    assert out.where("auto = 'burst'").count() == 0
    assert [r.idx for r in final.where("final = 'burst' and source = 'manual'").orderBy("idx").collect()] == [4, 5, 6]


def test_mean_interval(spark):
    df = golden(spark, {"a": [0, 0.01, 0.02, 0.03, 0.5, 0.51, 0.52, 0.53], "b": [0, 1]})
    r = {x.train: x for x in su.mean_isi(df).collect()}
    assert r["a"].status == "resolved" and r["a"].mean == pytest.approx(0.53 / 7) and r["a"].ml == pytest.approx(0.01)
    assert r["b"].status == "unresolved" and r["b"].ml is None


def test_settings():
    g = Grammar()
    assert g.digest() == Grammar.from_dict(dict((k, __import__("json").loads(v)) for k, v in g.flat())).digest()
    assert not g.issues() and Grammar(bridge=0.001).issues()
    with pytest.raises(ValueError):
        Grammar.from_dict({"nothing": 1})
