"""CSV files in and out."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import csv


def test_raw(spark, tmp_path):
    p = tmp_path / "raw.csv"
    p.write_text("STN_L_ch1_u2,b,event_cue\n0,5,0.5\n0.1,,x\n0.1,1,\n0.3,nan,2.5\n,inf,\n")
    d = csv.read_raw(spark, str(p))
    got = {t: [(r.idx, r.us, r.isi) for r in d.spikes.where(F.col("train") == t).orderBy("idx").collect()] for t in ("STN_L_ch1_u2", "b")}
    assert [x[1] for x in got["STN_L_ch1_u2"]] == [0, 10**11, 10**11, 3 * 10**11] and got["STN_L_ch1_u2"][0][2] is None
    assert [x[1] for x in got["b"]] == [10**12, 5 * 10**12]
    t = {r.train: r for r in d.trains.collect()}
    assert (t["STN_L_ch1_u2"].structure, t["STN_L_ch1_u2"].side, t["STN_L_ch1_u2"].channel, t["STN_L_ch1_u2"].unit) == ("STN", "left", 1, 2)
    assert (t["STN_L_ch1_u2"].dropped, t["STN_L_ch1_u2"].groups, t["b"].unsorted) == (1, 1, 1)
    assert sorted((r.event_name, r.event_us, r.event_id) for r in d.task_events.collect()) == [("cue", 5 * 10**11, "cue_1"), ("cue", 25 * 10**11, "cue_2")]
    c = csv.read_raw(spark, str(p), duplicates="collapse_exact").spikes.where("train like 'STN%'").orderBy("idx").collect()
    assert [r.us for r in c] == [0, 10**11, 3 * 10**11]
    with pytest.raises(ValueError):
        csv.read_raw(spark, str(p), duplicates="error_keep")


def test_duplicate_groups(spark):
    df = spark.createDataFrame([("t", i, us) for i, us in enumerate([0, 1, 1, 1, 3, 4, 4])], "train string, input_order long, us long")
    kept, counts = csv.collapse_duplicates(df)
    assert tuple(counts.select("dropped", "groups").first()) == (3, 2)
    assert sorted(r.input_order for r in kept.collect()) == [0, 1, 4, 5]


def test_labelled(spark, tmp_path):
    p = tmp_path / "lab.csv"
    p.write_text("a_timestamp,a_ISI,a_manual,a_not_burst,a_auto\n0,,,,\n10,10,burst,,x\n30,25,,yes,\n")
    d = csv.read(spark, str(p), "labelled", unit="ms")
    r = d.spikes.orderBy("idx").collect()
    assert [(x.manual, x.negative, x.auto) for x in r] == [("", "", ""), ("burst", "", "x"), ("", "yes", "")]
    assert r[1].isi == pytest.approx(0.010) and r[2].mismatch == pytest.approx(0.005)


def test_results_are_refused(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("train,pattern,start_isi,end_isi\na,burst,1,2\n")
    with pytest.raises(ValueError):
        csv.read_raw(spark, str(p))
    assert csv.is_result_table([], "out/burst_events.csv") and not csv.is_result_table(["a", "b"], "raw.csv")


def test_write(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.5], "=A1"), (2, [], "ok")], "id int, v array<double>, s string")
    csv.write({"t": df}, str(tmp_path), "csv")
    got = {r.id: (r.v, r.s) for r in spark.read.option("header", True).csv(str(tmp_path / "t")).collect()}
    assert got["1"] == ("0.5;1.5", "'=A1") and got["2"][1] == "ok"
    csv.write({"t2": df}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 2


def test_many_files_in_one_scan(spark, tmp_path):
    """Each file has its own columns; what comes out is what each file gives when it is read alone."""
    files = {"a": 'x,"y, left",event_go\n0.1,0.2,0.15\n0.3,,\nbad,0.5,\n', "b": "z\n1.0\n1.5\n1.25\n", "c": "x,z\n,3\n2,inf\n2.5,4\n", "d": 'far\n1700000000.5\n"1700000001.0"\n', "empty": "q\n"}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    paths = [f"file://{tmp_path}/{n}.csv" for n in files]
    got = csv.read_files(spark, paths)
    columns = ["train", "idx", "us", "t", "isi", "valid"]
    want = []
    for p in paths[:-1]:
        want += csv.read_raw(spark, p, by_file=True).spikes.select(columns).collect()
    assert sorted(got.select(columns).collect()) == sorted(want) and {r.train for r in want} == {"a/x", "a/y, left", "b/z", "c/x", "c/z", "d/far"}
    (tmp_path / "results.csv").write_text("train,start_isi,end_isi\nt,1,2\n")
    with pytest.raises(ValueError):
        csv.read_files(spark, [*paths, f"file://{tmp_path}/results.csv"])
    (tmp_path / "twice.csv").write_text("w\n1\n1\n2\n")
    assert csv.read_files(spark, [f"file://{tmp_path}/twice.csv"], duplicates="collapse_exact").count() == 2
    with pytest.raises(ValueError):
        csv.read_files(spark, [f"file://{tmp_path}/twice.csv"], duplicates="error_keep")
