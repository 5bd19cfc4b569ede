"""Measures of spans: given twice, across batches, and against plain Python."""

import math
import statistics

import numpy as np
import pytest

from pulsegrid.operators.statistics import span_metrics


def plain(isi, valid, a, b, low, bridge):
    x = [isi[i] for i in range(a, b + 1) if valid[i]]
    mean = sum(x) / len(x)
    lv = [3 * (p - q) ** 2 / (p + q) ** 2 for p, q in zip(x, x[1:], strict=False)]
    at = lambda i: None if i not in isi or math.isnan(isi[i]) else isi[i]
    return [len(x), mean, max(x), sum(x), statistics.stdev(x) / mean if len(x) > 1 else None, max(x) / mean, sum(v <= low for v in x), sum(low < v <= bridge for v in x), sum(lv) / len(lv) if lv else None, *np.percentile(x, [10, 50, 90, 95]), at(a - 1), at(b + 1)]


NAMES = ["n_isi", "mean_isi", "max_isi", "duration", "cv", "mm", "core", "bridges", "lv", "q10", "q50", "q90", "q95", "pre", "post"]


def rows_of(spark, trains):
    rows = [(t, i, None if i == 1 else float(v), i > 1 and i % 7 != 0, i % 3 == 0, float(i)) for t, x in trains.items() for i, v in enumerate(x, 1)]
    return spark.createDataFrame(rows, "train string, idx int, isi double, valid boolean, suspect boolean, w double")


def test_a_span_that_is_given_twice_is_one(spark):
    rows = rows_of(spark, {"a": [0.01, 0.02, 0.05, 0.01, 0.03]})
    spans = spark.createDataFrame([("a", 2, 4), ("a", 2, 4)], "train string, start int, end int")
    [r] = span_metrics(rows, spans, 0.015, 0.03).collect()
    assert r.n_isi == 3 and r.duration == pytest.approx(0.08) and r.cv == pytest.approx(statistics.stdev([0.02, 0.05, 0.01]) / (0.08 / 3))


@pytest.mark.parametrize("batch", ["10000", "5"])
def test_spans_of_many_trains(spark, batch):
    rng = np.random.default_rng(4)
    trains = {t: rng.exponential(0.03, n) for t, n in (("a", 60), ("b", 3), ("c", 200), ("d", 1), ("e", 40))}
    spans = sorted({(t, int(a), int(min(len(x), a + rng.integers(0, 30)))) for t, x in trains.items() if len(x) > 1 for a in rng.integers(2, len(x) + 1, 12)})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        m = span_metrics(rows_of(spark, trains), spark.createDataFrame(spans, "train string, start int, end int"), 0.01, 0.03, intervals=True, most=("max", "w"), mean_w=("avg", "w"), flagged=("count", "suspect"))
        got = {(r.train, r.start, r.end): r for r in m.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for t, a, b in spans:
        isi = {i: math.nan if i == 1 else float(v) for i, v in enumerate(trains[t], 1)}
        valid = {i: i > 1 and i % 7 != 0 for i in isi}
        some = [i for i in range(a, b + 1) if valid[i]]
        if not some:
            assert (t, a, b) not in got
            continue
        r = got.pop((t, a, b))
        assert [r[n] for n in NAMES] == [None if v is None else pytest.approx(v, rel=1e-9) for v in plain(isi, valid, a, b, 0.01, 0.03)]
        assert (r.most, r.flagged, r.mean_w) == (max(some), sum(i % 3 == 0 for i in some), pytest.approx(sum(some) / len(some))) and r.isi_values == [isi[i] for i in some]
    assert not got


def test_columns_of_spans_go_through(spark):
    rows = rows_of(spark, {"a": [0.01, 0.02, 0.05, 0.01, 0.03]})
    spans = spark.createDataFrame([("a", 2, 4, "x"), ("a", 2, 4, "y"), ("a", 3, 5, None)], "train string, start int, end int, label string")
    got = {(r.start, r.end, r.label): (r.n_isi, r.duration) for r in span_metrics(rows, spans, 0.015, 0.03, keep=("label",)).collect()}
    assert got == {(2, 4, "x"): (3, pytest.approx(0.08)), (2, 4, "y"): (3, pytest.approx(0.08)), (3, 5, None): (3, pytest.approx(0.09))}


@pytest.mark.parametrize("batch", ["10000", "4"])
def test_context_beside_spans(spark, batch):
    """Medians of what lies beyond a gap on both sides, in the one pass that measures the spans."""
    rng = np.random.default_rng(5)
    trains = {t: rng.exponential(0.03, n) for t, n in (("a", 80), ("b", 4), ("c", 33))}
    spans = sorted({(t, int(a), int(min(len(x), a + rng.integers(0, 9)))) for t, x in trains.items() for a in rng.integers(2, len(x) + 1, 15)})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        m = span_metrics(rows_of(spark, trains), spark.createDataFrame(spans, "train string, start int, end int"), 0.01, 0.03, context=(2, 5))
        assert "SortMergeJoin" not in m._jdf.queryExecution().toString()
        got = {(r.train, r.start, r.end): r.context for r in m.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for t, a, b in spans:
        x = {i: float(v) for i, v in enumerate(trains[t], 1) if i > 1 and i % 7 != 0}
        if any(a <= i <= b for i in x):
            beside = [v for i, v in x.items() if a - 7 <= i <= a - 3 or b + 3 <= i <= b + 7]
            assert got[t, a, b] == (pytest.approx(statistics.median(beside)) if beside else None)


def test_equal_quantiles_of_a_train_and_a_span_are_equal(spark):
    """The tenth of 55 intervals and that of five lie at the same place between the same two: as SQL has it, and not an ulp apart."""
    from pulsegrid.functions.stats import between
    from pulsegrid.operators.ranges import quantile_settings

    low, high = 0.004301745728, 0.005028163174
    x = [low, high, 0.012101285735, 0.013776513005, 0.018843552324, *(0.001 + i / 10_000 for i in range(5)), *(0.02 + i / 1000 for i in range(45))]
    rows = spark.createDataFrame([("a", 1, None, False, False), *(("a", i, v, True, False) for i, v in enumerate(x, 2))], "train string, idx int, isi double, valid boolean, suspect boolean")
    [r] = span_metrics(rows, spark.createDataFrame([("a", 2, 6)], "train string, start int, end int"), 0.01, 0.02).collect()
    [s] = quantile_settings(rows, {"floor": 0.1, "half": 0.45}).collect()
    assert r.q10 == s.floor == math.fma(low, 1 - 0.4, high * 0.4)
    assert s.half == math.fma(sorted(x)[24], 1 - (54 * 0.45 - 24), sorted(x)[25] * (54 * 0.45 - 24))
    rng = np.random.default_rng(2)
    a, d = rng.random(3000), rng.random(3000)
    b = a + rng.random(3000)
    assert between(a, b, d).tolist() == [math.fma(float(p), 1 - float(w), float(q * w)) for p, q, w in zip(a, b, d, strict=True)]


@pytest.mark.parametrize("name", ["spiking_state_verdicts", "protected_candidates"])
def test_a_state_with_the_ends_of_a_burst(spark, tmp_path, name):
    """Eight intervals are a spiking state and a burst at once. Their variation, just over the limit, must be that of eight and not of sixteen."""
    import datetime

    import duckdb

    import pulsegrid.plans  # noqa: F401
    from pulsegrid.plans import registry

    us = np.cumsum([0, 200_000, *[1000 + 4100 * i for i in range(8)], 200_000, 1000]) * 1_000_000
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(microseconds=int(u)), 1, "view", 0.0, None) for i, u in enumerate(us)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = registry.QUERIES[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(f'''"{c}"''' for c in columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


def test_labels_are_written_without_a_range_join(spark):
    from pyspark.sql import functions as F

    from pulsegrid.operators.detectors import written

    rows = rows_of(spark, {"a": [0.01] * 12}).withColumns({"t": F.col("idx") * 0.01, "artifact": F.lit(False), "manual": F.lit("")})
    chosen = spark.createDataFrame([("a", 3, 6, "burst", True), ("a", 7, 9, "pause", True), ("a", 5, 11, "tonic", False)], "train string, start int, end int, label string, selected boolean")
    out = written(rows, chosen)
    assert {r.idx: r.auto for r in out.collect() if r.auto} == {i: "burst" if i < 7 else "pause" for i in range(3, 10)}
    assert "_bucket" not in out._jdf.queryExecution().optimizedPlan().toString()
