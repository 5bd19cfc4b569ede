"""Medians around rows against plain Python, and what a detection reads and stores."""

import math
import statistics

import numpy as np
import pytest

from pulsegrid.operators.medians import with_medians
from pulsegrid.operators.runs import extended, extensions, runs, runs_beside


def table(spark):
    rng = np.random.default_rng(5)
    rows = [(t, i, float(rng.exponential(0.02)) if i > 1 else None, bool(i > 1 and rng.random() > 0.2)) for t, n in (("a", 70), ("b", 1), ("c", 9), ("d", 150), ("e", 2)) for i in range(1, n + 1)]
    return rows, spark.createDataFrame(rows, "train string, idx int, isi double, valid boolean").selectExpr("*", "if(valid, isi, null) as x", "idx % 3 = 0 as some")


def middle(values):
    return statistics.median(values) if values else None


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_medians_around_rows_of_many_trains(spark, batch):
    rows, df = table(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.train, r.idx): r for r in with_medians(df, {"near": ("x", 4)}, 3, "x").collect()}
        few = {(r.train, r.idx): r.near for r in with_medians(df, {"near": ("x", 4)}, only="some").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) and few == {k: r.near for k, r in got.items() if k[1] % 3 == 0}
    for t, i, _, _ in rows:
        x = {j: v for u, j, v, ok in rows if u == t and ok}
        r = got[t, i]
        want = middle([v for j, v in x.items() if j != i and abs(j - i) <= 4]), middle([v for j, v in x.items() if j < i][-3:]), middle([v for j, v in x.items() if j > i][:3])
        for a, b in zip((r.near, r.before, r.after), want, strict=True):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-12))


def test_runs_know_what_is_beside_them(spark):
    _, df = table(spark)
    flag = df.valid & df.isi.between(0.002, 0.015)
    want = {tuple(r) for r in extensions(df, runs(df, flag), 0.03, 3).select("train", "start", "end", "s", "e").collect()}
    got = {tuple(r) for r in extended(runs_beside(df, flag, 0.03, 3)).select("train", "start", "end", "s", "e").collect()}
    assert got == want and any(s < a for _, a, _, s, _ in got) and any(e > b for _, _, b, _, e in got)


def test_near_misses_find_their_settings_once(spark, monkeypatch):
    from pulsegrid.operators import thresholds as th
    from pulsegrid.plans import registry

    calls, plain = [], th.histogram_bands
    monkeypatch.setattr(th, "histogram_bands", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    registry.QUERIES["near_misses"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_candidates_are_stored_once_where_no_label_denies_them(spark, monkeypatch):
    from pulsegrid.operators import detectors as de
    from pulsegrid.sources.events import labelled, trains

    names, plain = [], de.stored
    monkeypatch.setattr(de, "stored", lambda df, what: (names.append(what), plain(df, what))[1])
    de.detect(labelled(trains(spark, "/root/testdata/sf0.001")))
    assert not {"judged", "protected", "burst-measures"} & set(names) and names.count("candidates") == 1


def test_proposals_take_surroundings_in_one_scan(spark, monkeypatch):
    """Of each row they are found once; windows and scores join nothing with all rows."""
    from pulsegrid.operators import proposals as pp
    from pulsegrid.sources.events import trains

    names, plain = [], pp.stored
    monkeypatch.setattr(pp, "stored", lambda df, what: (names.append(what), plain(df, what))[1])
    rows = pp.surrounded(trains(spark, "/root/testdata/sf0.001"))
    for df in (pp.context_windows(rows), pp.seed_blocks(rows), pp.scored(rows, rows.selectExpr("train", "idx as start", "idx as end"))):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert names == ["surroundings"]
