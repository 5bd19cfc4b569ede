"""Detection under several settings as one scan finds what the detectors find as a plan."""

import random

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.grammar import Grammar
from pulsegrid.operators import runs
from pulsegrid.operators import tuning as tu
from pulsegrid.operators import variant_scan as vs
from pulsegrid.plans import registry
from pulsegrid.sources.csv import golden
from pulsegrid.sources.shared import stored

KINDS = {"a": (0.0003, 0.004), "b": (0.002, 0.014), "f": (0.02, 0.022), "p": (0.1, 0.6), "s": (0.006, 0.05), "t": (0.03, 0.05), "x": (0.011, 0.03)}
#: Settings that differ from the defaults, by variant.
GIVEN = {
    "baseline": {},
    "bursts": {"seed_high": 0.0075, "bridge": 0.019, "max_extension": 2, "max_candidates": 7, "min_spikes": 4, "contrast": 1.8, "possible_contrast": 1.3, "strong_rescue_ratio": 3.2},
    "spiking": {"hfs_spikes": 10, "hfs_gap": 2, "hfs_max": 0.06, "hfs_tolerated": 0.09, "hfs_large_share": 0.4, "pause_min": 0.15, "pause_local": 1.2},
    "tonic": {"hft_floor": 0.004, "hft_max": 0.035, "hft_cv": 0.9, "hft_lv": 1.0, "hft_mm": 3.0, "min_seeds": 4, "tonic_max": 0.045, "tonic_spikes": 4, "tonic_lv": 0.8},
}
NAMES = list(dict.fromkeys(k for v in GIVEN.values() for k in v))


def train(r, n):
    t = [0.0]
    while len(t) < n:
        kind = r.choice("abbfpssstx")
        for _ in range(1 if kind == "p" else r.randint(20, 60) if kind == "s" else r.randint(2, 14)):
            t.append(t[-1] + (r.choice([0.0004, 0.2]) if kind == "s" and r.random() < 0.04 else r.uniform(*KINDS[kind])))
    return t


def table(spark):
    base = Grammar()
    kind = lambda k: "int" if isinstance(getattr(base, k), int) or k == "max_candidates" else "double"
    rows = [(v, i, *(x.get(k, getattr(base, k)) for k in NAMES)) for i, (v, x) in enumerate(GIVEN.items())]
    return spark.createDataFrame(rows, "variant string, place int, " + ", ".join(f"{k} {kind(k)}" for k in NAMES)).coalesce(1)


def test_scan_finds_what_the_plan_finds(spark):
    r = random.Random(5)
    rows = golden(spark, {f"t{i}": train(r, n) for i, n in enumerate([1, 2, 3, 7, 12, 40, *[150] * 12, 400, 900])})
    by_hand = F.when(F.col("isi") < 0.012, "burst").when(F.col("isi") > 0.3, "pause").when(F.col("isi").between(0.03, 0.05), "tonic").when(F.col("isi") > 0.06, "other").otherwise("")
    rows = stored(rows.withColumn("manual", F.coalesce(by_hand, F.lit(""))), "rows")
    names = table(spark)
    grammars = tu.grammars(names)
    assert list(grammars) == list(GIVEN) and all(getattr(grammars[v], k) == x for v, some in GIVEN.items() for k, x in some.items())
    want = stored(tu.detected_variants(rows, rows.select("train").distinct().join(names.drop("place"))), "plan")
    got = [tuple(x) for x in vs.detected(rows, grammars).collect()]
    assert sorted(got) == sorted(tuple(x) for x in want.collect())
    assert {x[2] for x in got} == set(vs.LABELS) - {""} and len({x[0] for x in got}) == 4
    truth = runs.segments(rows, F.col("manual")).where("label <> ''").select("train", "label", "start", "end")
    want = {tuple(x) for x in tu.counts(want, truth, names).collect()}
    got = [tuple(x) for x in vs.counts(rows, grammars).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {x[2] for x in got} >= {"other", "tonic"}


def test_scan_goes_on_over_batches(spark):
    r = random.Random(6)
    rows = stored(golden(spark, {f"t{i}": train(r, 120) for i in range(8)}), "rows")
    want = sorted(tuple(x) for x in vs.detected(rows, {"one": Grammar()}).collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        assert sorted(tuple(x) for x in vs.detected(rows, {"one": Grammar()}).collect()) == want and want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_must_be_whole(spark):
    rows = golden(spark, {"a": [0.0, 0.1, 0.2, 0.3]})
    with pytest.raises(Exception, match="numbered from 1"):
        vs.detected(rows.where("idx <> 2"), {"one": Grammar()}).collect()


def test_queries_make_no_row_for_each_variant_and_interval(spark, monkeypatch):
    """Under nine variants the old plan stored the trains nine times."""
    from pulsegrid.operators import detectors

    def fail(*_args, **_kw):
        raise AssertionError("detected as a plan")

    monkeypatch.setattr(detectors, "detect", fail)
    assert registry.QUERIES["setting_scan"](spark, "/root/testdata/sf0.001").count() == 9


def test_holdout_detects_in_the_scan(spark, monkeypatch):
    """Both holdout queries: twenty repeats, and a summary that is that of their metrics."""
    from pulsegrid.operators import detectors
    from pulsegrid.plans import validation_queries as vq

    def fail(*_args, **_kw):
        raise AssertionError("detected as a plan")

    monkeypatch.setattr(detectors, "detect", fail)
    out = {k: v.collect() for k, v in vq.holdout(spark, "/root/testdata/sf0.001").items()}
    assert [x.repeat for x in sorted(out["repeats"], key=lambda x: x.repeat)] == list(range(1, 21))
    assert {x.label for x in out["summary"]} == {x.label for x in out["metrics"]}
    for s in out["summary"]:
        f1 = [x.f1 for x in out["metrics"] if x.label == s.label and x.f1 is not None]
        assert s.f1 == (pytest.approx(sum(f1) / len(f1)) if f1 else None)
