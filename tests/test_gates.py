"""Gates, vetoes, bands of single trains, runs over files: on trains whose results are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import batch
from pulsegrid.operators import detectors as de
from pulsegrid.operators import gates as ga
from pulsegrid.operators import ranges as ra
from pulsegrid.operators import runs
from pulsegrid.operators import statistics as st
from pulsegrid.operators import support as su
from pulsegrid.operators import thresholds as th
from pulsegrid.operators import validation as va
from pulsegrid.sources import csv
from pulsegrid.sources.csv import golden


def train(isis, start=0.0):
    out = [start]
    for x in isis:
        out.append(out[-1] + x)
    return out


def test_a_negative_label_strikes_out_a_burst(spark):
    rows = golden(spark).where("train = 'middle_burst'").withColumn("manual", F.lit(""))
    labels = {r.idx: r.auto for r in de.detect(rows)[0].collect()}
    assert [labels[i] for i in (4, 5, 6)] == ["burst"] * 3
    no = rows.withColumn("negative", F.when(F.col("idx") == 5, " Not_Burst ").otherwise(""))
    out, ledger = de.detect(no)
    assert not any(r.auto in ga.BURSTS for r in out.collect())
    assert {r.gate for r in ledger.where("start <= 5 and end >= 5 and layer in ('burst', 'episode')").collect()} <= {"manual_negative_veto", "reject"}
    one = ga.negative_overlap(no, spark.createDataFrame([("middle_burst", 4, 6), ("middle_burst", 6, 7)], "train string, start long, end long"))
    assert {(r.start, round(r.negative_share, 6)) for r in one.collect()} == {(4, 0.333333), (6, 0.0)}


def test_limits_trim_a_state_and_drop_what_is_left_of_it(spark):
    isis = [0.01] * 40 + [0.06] + [0.01] * 10 + [0.2] * 3
    rows = golden(spark, {"a": train(isis)}).withColumns({"manual": F.lit(""), "auto": F.when((F.col("idx") >= 2) & (F.col("idx") <= 52), "high_frequency_spiking").otherwise("")})
    out = {r.idx: (r.auto, r.removed) for r in ga.validated(rows, limits={"high_frequency_spiking": (None, 0.05)}).collect()}
    assert out[42] == ("", "trimmed")  # the long interval
    assert {out[i] for i in range(2, 42)} == {("high_frequency_spiking", None)}
    assert {out[i] for i in range(43, 53)} == {("", "fragment")}  # 11 spikes, 30 are asked for
    out = {r.idx: r.removed for r in ga.validated(rows.withColumn("manual", F.when(F.col("idx") == 45, "tonic").otherwise("")), limits={"high_frequency_spiking": (None, 0.05)}).collect()}
    assert out[45] is None and out[44] == "fragment"


def test_spans_are_gated_by_quantiles_or_by_every_interval(spark):
    rows = golden(spark, {"a": train([0.1, *[0.005] * 9, 0.02, 0.1])})
    spans = spark.createDataFrame([("a", label, 3, 12) for label in ("burst", "tonic", "pause")], "train string, label string, start long, end long")
    got = {r.label: (r.reason, r.passed) for r in ga.pattern_gate(rows, spans, {"burst": (0.001, 0.010), "tonic": (0.006, 0.015)}).collect()}
    assert got == {"burst": ("pattern_isi_gate_pass", True), "tonic": ("below_pattern_Min_ISI;above_pattern_Max_ISI", False), "pause": ("pattern_isi_gate_disabled", True)}
    v = {r.label: r for r in ga.vetoes(rows, spans, 0.005, 0.5, (0.004, 0.01)).collect()}
    assert v["burst"].anti_burst and v["burst"].anti_tonic and v["burst"].lv == pytest.approx(3 * 0.015**2 / 0.025**2 / 9)


def test_canonical_bursts(spark):
    core = [0.004, 0.005, 0.004]
    rows = golden(spark, {"clear": train([*[0.1] * 20, *core, *[0.1] * 20]), "edge": train([*core, *[0.1] * 30]), "close": train([*[0.1] * 10, 0.012, *core, 0.012, *[0.1] * 20])})
    spans = spark.createDataFrame([("clear", "burst", 22, 24), ("edge", "burst", 2, 4), ("close", "burst", 13, 15)], "train string, label string, start long, end long")
    got = {r.train: (r.final_label, r.decision) for r in ga.canonical_bursts(rows, spans).collect()}
    assert got == {"clear": ("burst", "canonical_burst_gate_pass"), "edge": ("possible_burst", "one_sided_boundary_burst_review"), "close": ("reject", "edge_ratio_fail")}
    low = {r.train: r.decision for r in ga.canonical_bursts(rows, spans, ga.BurstGate(ceiling=0.0045, fuzzy_percent=10)).collect()}
    assert low["clear"] == "fuzzy_abs_ceiling_pass_requires_review"  # q90 = 0.0048
    assert {r.decision for r in ga.canonical_bursts(rows, spans, ranges=spark.createDataFrame([("clear", 0.003)], "train string, high double")).where("train = 'clear'").collect()} == {"reject_abs_ceiling_fail"}
    assert {r.prior for r in ga.phenotype(rows).collect()} <= {"low_spike_count_unreliable", "mixed", "tonic_dominant"}


def test_bursts_longer_than_any_window(spark):
    rows = golden(spark, {"a": train([0.1] * 5 + [0.01, 0.012] * 100 + [0.1] * 5 + [0.01] + [0.1] * 5)})
    # ml is 2.21 / 201 = 0.010995: the first 199 of them have a lower mean, all 200 a higher one, and the one alone is no window
    assert {(r.start, r.end) for r in su.mean_isi_bursts(rows).collect()} == {(7, 205)}


def test_scan_takes_windows_by_percentile_too(spark):
    rows = golden(spark, {"a": train([0.5, 0.5, 0.05, 0.051, 0.052, 0.5, 0.5])})
    by_time = runs.structure_scan(rows, (3, 3), 0.02, None, 2.0, 2.0)
    assert by_time.count() == 0
    from pulsegrid.operators.isi import percentile_rank

    r = runs.structure_scan(percentile_rank(rows), (3, 3), 0.02, 50.0, 2.0, 2.0).collect()
    assert [(x.start, x.end) for x in r] == [(4, 6)] and r[0].q90 == pytest.approx(0.0518) and r[0].max_pct == pytest.approx(300 / 7)
    wide = runs.structure_scan(rows, (2, 13), 1.0, None, 0.0, 0.0)
    assert wide.where("width > 6").count() == 0 and wide.where("width = 3 and start = 4").first().q90 == pytest.approx(0.0518)


def test_histogram_bands_by_hand(spark):
    few = golden(spark, {"a": train([0.1, 0.1])})
    assert th.histogram_bands(few) == th.SPARSE_BANDS
    # 40 intervals of 4 ms, 10 of 12 ms, 50 of 100 ms: bins 0-5 ms hold 40, 5-10 none, so the seed band ends at 10 ms
    rows = golden(spark, {"a": train([0.004] * 40 + [0.012] * 10 + [0.1] * 50)})
    b = th.histogram_bands(rows)
    assert b["burst"] == pytest.approx((0.0025, 0.010, 0.015, 2.5))
    assert b["high_frequency_spiking"][:3] == pytest.approx((0.0025, 0.015, 0.030))
    assert b["high_frequency_tonic"][:3] == pytest.approx((0.010, 0.020, 0.030))  # quartile 4 ms
    assert b["tonic"][:3] == pytest.approx((0.020, 0.1, 0.1)) and b["pause"][:3] == pytest.approx((0.1, 0.15, 0.15))
    frozen = ra.frozen_bands(golden(spark, {"a": train([0.004] * 40 + [0.012] * 10 + [0.1] * 50), "b": train([0.3] * 90)}), spark.createDataFrame([("a",)], "train string"))
    assert frozen["burst"] == pytest.approx(b["burst"])


def test_manual_bands_are_medians_and_quartiles_of_events(spark):
    ev = [("burst", [0.002, 0.004], 0.1, 0.2), ("long_burst", [0.004, 0.006], 0.05, None), ("tonic", [0.03, 0.03], None, None)]
    got = {r.pattern: r for r in th.manual_bands(spark.createDataFrame(ev, "label string, isi_values array<double>, pre double, post double")).collect()}
    b = got["burst"]
    assert (b.events, b.low, b.high, b.bridge, b.contrast) == pytest.approx((2, 0.0021 + 0.25 * 0.002, 0.0048, 0.0039 + 0.75 * 0.002, 0.1 / 0.0038))
    assert (got["tonic"].low, got["tonic"].bridge, got["tonic"].contrast) == (0.03, 0.03, None)


def test_bands_are_put_in_order(spark):
    r = {(x.pattern, x.field): x for x in th.resolved(spark, {}, manual={"burst": (0.03, 0.02, None, None)}, mode="manual").collect()}
    assert r["burst", "high"].effective == pytest.approx(0.031) and r["burst", "bridge"].effective == pytest.approx(0.031)
    assert r["high_frequency_tonic", "low"].effective == pytest.approx(0.031) and r["high_frequency_tonic", "high"].effective == pytest.approx(0.0465)
    assert (r["tonic", "contrast"].effective, r["tonic", "contrast"].source) == (None, "none")


def test_train_settings(spark):
    o = spark.createDataFrame([("hard", True, 0.008, 0.0, None, 0.3), ("soft", False, 0.008, 0.012, 0.013, 0.0)], "train string, hard boolean, burst_max double, tonic_min double, tonic_max double, pause_min double")
    got = {r.train: tuple(r)[1:] for r in ra.train_settings(o.select("train").unionByName(spark.createDataFrame([("none",)], "train string")), o, 0.01, 0.015, (0.02, 0.06), 0.1).collect()}
    assert got["hard"] == pytest.approx((0.008, 0.015, 0.02, 0.06, 0.3)) and got["none"] == pytest.approx((0.01, 0.015, 0.02, 0.06, 0.1))
    assert got["soft"] == pytest.approx((0.01, 0.015, 0.01725, 0.01725 * 1.25, 0.1))


def test_raters(spark):
    ev = [("a", 1, "burst", 2, 4), ("a", 1, "tonic", 10, 12), ("b", 1, "burst", 2, 5), ("b", 1, "pause", 10, 12), ("b", 1, "pause", 20, 20)]
    x = va.rater_agreement(spark.createDataFrame(ev, "rater string, train long, label string, start long, end long")).collect()
    assert len(x) == 1
    r = x[0]
    assert (r.event_union_n, r.matched_event_n, r.same_label_match_n) == (3, 2, 1)
    assert (r.event_f1_same_label, r.mean_iou_matched, r.mean_boundary_abs_error_isi) == pytest.approx((0.4, 0.875, 0.25))
    assert r.label_kappa == pytest.approx((1 / 3 - 1 / 9) / (1 - 1 / 9))


def test_adjusted_p_values_without_keys(spark):
    p = [0.01, 0.04, 0.03, 0.04, 0.5, 0.005]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*p, None])], "i int, p double").repartition(3)
    q = {r.i: r.q for r in st.benjamini_hochberg(df, [], "p", span=2).collect()}
    order = sorted(p)
    want = [min(min(1.0, order[j] * len(p) / (j + 1)) for j in range(len(p)) if order[j] >= v) for v in p]
    assert [q[i] for i in range(len(p))] == pytest.approx(want) and q[len(p)] is None


def test_files_to_result_tables(spark, tmp_path):
    (tmp_path / "one.csv").write_text("u1,u2\n" + "\n".join(f"{a:.4f},{b:.4f}" for a, b in zip(train([0.1] * 10 + [0.004] * 4 + [0.1] * 10), train([0.05] * 24), strict=True)))
    (tmp_path / "two.csv").write_text("u1\n" + "\n".join(f"{a:.4f}" for a in train([0.1] * 10 + [0.004] * 4 + [0.1] * 10, 1.7e9)))
    tables = batch.run(spark, [f"file://{tmp_path}/one.csv", f"file://{tmp_path}/two.csv"], f"file://{tmp_path}/out", run_id="r")
    ev = spark.read.parquet(f"file://{tmp_path}/out/events").collect()
    assert {r.train for r in ev if r.label == "burst"} == {"one/u1", "two/u1"}
    assert all(r.event_id.startswith("r:event:") and r.pattern_family for r in ev)
    assert {r.train for r in tables["train_summary"].collect()} == {"one/u1", "one/u2", "two/u1"}
    assert {x.name for x in (tmp_path / "out").iterdir()} >= {"events", "candidates", "thresholds", "settings", "interval_labels", "events_high_confidence"}


def test_times_since_1970(spark, tmp_path):
    (tmp_path / "a.csv").write_text("u,event\n1700000000.0,1700000000.5\n1700000000.25,\n1700000001.0,\n")
    x = csv.read_raw(spark, f"file://{tmp_path}/a.csv")
    assert [r.isi for r in x.spikes.orderBy("idx").collect()] == [None, 0.25, 0.75]
    assert x.task_events.first().event_us == 500_000_000_000
    (tmp_path / "b.csv").write_text("u\n0\n1700000001.0\n")
    with pytest.raises(ValueError):
        csv.read_raw(spark, f"file://{tmp_path}/b.csv")
