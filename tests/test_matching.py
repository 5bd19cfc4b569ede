"""Matches by a scan of partitions, tables that are told not to be broadcast, surrogates without a join."""

from pyspark.sql import functions as F

from pulsegrid.operators import models as mo
from pulsegrid.operators import validation as va


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_greedy_matches_of_many_trains_are_one_scan(spark):
    pred = [(t, "x", s, s + 4) for t in range(40) for s in (1, 6, 11)]
    truth = [(t, "x", s, s + 5) for t in range(40) for s in (2, 8, 14)]
    schema = "train long, label string, start long, end long"
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a train goes on in the next batch
    try:
        m = va.matched(spark.createDataFrame(pred, schema), spark.createDataFrame(truth, schema), 0.1)
        assert "FlatMapGroupsInPandas" not in plan(m)
        got = {(r.train, r.pred_start, r.truth_start) for r in m.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = set()
    for t in range(40):
        pairs = []
        for _, _, a, b in pred[:3]:
            for _, _, c, d in truth[:3]:
                v = max(0, min(b, d) - max(a, c) + 1) / (max(b, d) - min(a, c) + 1)
                pairs += [(-v, a, c)] if v >= 0.1 else []
        p, q = set(), set()
        for _, a, c in sorted(pairs):
            if a not in p and c not in q:
                p.add(a), q.add(c), want.add((t, a, c))
    assert got == want


def test_draws_of_the_bootstrap_are_not_broadcast(spark):
    per = spark.range(20).select(F.col("id").alias("train"), F.lit("x").alias("label"), F.lit(3).alias("truth_n"), F.lit(2).alias("pred_n"), F.lit(1).alias("tp"))
    text = plan(va.cluster_bootstrap(per, 10))
    assert "SortMergeJoin [_k" in text


def test_label_surrogates_are_made_without_a_join(spark):
    x = spark.createDataFrame([(1, i * 2, "ab"[i % 2]) for i in range(9)], "train long, idx int, state string")
    out = mo.label_surrogates(x, 4)
    assert "Join" not in plan(out)
    rows = out.collect()
    for s in range(1, 5):
        mine = sorted((r.idx, r.state) for r in rows if r.surrogate == s)
        assert [i for i, _ in mine] == [i * 2 for i in range(9)] and sorted(v for _, v in mine) == sorted("ababababa")


def test_surrogates_of_intervals_stand_in_a_row_each(spark):
    x = spark.createDataFrame([(1, i + 2, float(i % 3 + 1), i != 3) for i in range(7)], "train long, idx int, isi double, valid boolean")
    lists = va.shuffled_lists(x, 5)
    assert "Window" not in plan(lists) and "Join" not in plan(lists)
    rows = lists.withColumn("lv", va.mean_lv(F.col("intervals"))).collect()
    assert len(rows) == 5
    for r in rows:
        assert sorted(s.isi for s in r.intervals) == [1, 1, 1, 2, 2, 3, 3]
        v = [s.isi for s in r.intervals if s.valid]
        assert abs(r.lv - sum(3 * (a - b) ** 2 / (a + b) ** 2 for a, b in zip(v, v[1:], strict=False)) / (len(v) - 1)) < 1e-12
