"""Queries that compare detected events with events by hand."""

from pyspark.sql import functions as F

from pulsegrid.operators import runs
from pulsegrid.operators import validation as va
from pulsegrid.sources.events import labelled, trains
from pulsegrid.sources.shared import stored

from .join_queries import SPANS, spans
from .registry import query, rounded


@query(f"""{SPANS}, o AS (SELECT p.train, p.label, p.start AS pred_start, p.e AS pred_end, m.start AS truth_start, m.e AS truth_end, (least(m.e, p.e) - greatest(m.start, p.start) + 1) / (greatest(m.e, p.e) - least(m.start, p.start) + 1) AS iou
 FROM p JOIN m ON m.train = p.train AND m.label = p.label AND p.start <= m.e AND m.start <= p.e) SELECT train, label, pred_start, pred_end, truth_start, truth_end, round(iou, 9) AS iou FROM o""")
def event_overlaps(spark, d):
    m, p = spans(spark, d)
    return rounded(va.overlaps(p, m, ["train", "label"]))


@query()
def greedy_matches(spark, d):
    m, p = spans(spark, d)
    return rounded(va.matched(p, m))


@query()
def match_table(spark, d):
    m, p = spans(spark, d)
    return rounded(va.match_table(p, m))


@query(f"""{SPANS}, o AS (SELECT p.label, p.train, p.start FROM p JOIN m ON m.train = p.train AND m.label = p.label AND m.start = p.start AND m.e = p.e), k AS (SELECT label FROM m UNION SELECT label FROM p),
c AS (SELECT label, (SELECT count(*) FROM m WHERE m.label = k.label) AS truth_n, (SELECT count(*) FROM p WHERE p.label = k.label) AS pred_n, (SELECT count(*) FROM o WHERE o.label = k.label) AS tp FROM k)
SELECT label, truth_n, pred_n, tp, greatest(pred_n - tp, 0) AS fp, truth_n - tp AS fn, CASE WHEN pred_n > 0 THEN round(tp / pred_n, 9) END AS precision, CASE WHEN truth_n > 0 THEN round(tp / truth_n, 9) END AS recall,
 CASE WHEN tp > 0 THEN round(2 * (tp / pred_n) * (tp / truth_n) / (tp / pred_n + tp / truth_n), 9) END AS f1 FROM c""")
def exact_event_metrics(spark, d):
    m, p = spans(spark, d)
    return rounded(va.event_metrics(p, m, va.matched(p, m, 1.0), ["label"]))


@query()
def iou_sensitivity(spark, d):
    m, p = spans(spark, d)
    return rounded(va.iou_sensitivity(p, m))


@query()
def bootstrap_f1(spark, d):
    m, p = spans(spark, d)
    c = va.event_metrics(p, m, va.matched(p, m), ["train", "label"]).select("train", "label", "truth_n", "pred_n", "tp")
    return rounded(va.cluster_bootstrap(stored(c, "per-train")))


@query()
def train_split(spark, d):
    return va.split(trains(spark, d))


SCORES = ", x AS (SELECT least(value / 200, 1) AS score, (kind IN ('click', 'error'))::INT AS outcome FROM s), c AS (SELECT least(floor(score * 10), 9)::BIGINT AS bin, count(*) AS n, avg(score) AS mean_score, avg(outcome) AS rate, avg((score - outcome) ** 2) AS brier FROM x GROUP BY ALL)"


def scores(spark, d):
    return trains(spark, d).select(F.least(F.col("value") / 200, F.lit(1.0)).alias("score"), F.col("kind").isin("click", "error").cast("int").alias("outcome"))


@query(f"{SCORES} SELECT bin, n, round(mean_score, 9) AS mean_score, round(rate, 9) AS rate, round(brier, 9) AS brier, round(abs(mean_score - rate), 9) AS gap FROM c")
def calibration_bins(spark, d):
    return rounded(va.calibration(scores(spark, d)))


@query(f"{SCORES} SELECT sum(n)::BIGINT AS n, round(sum(n * abs(mean_score - rate)) / sum(n), 9) AS ece, round(max(abs(mean_score - rate)), 9) AS mce, round(sum(n * brier) / sum(n), 9) AS brier FROM c")
def calibration_errors(spark, d):
    return rounded(va.calibration_errors(va.calibration(scores(spark, d))))


@query()
def parameter_delta(spark, d):
    rows = labelled(trains(spark, d))
    a = runs.segments(rows, F.col("auto")).where("label <> ''").select("train", "label", "start", "end")
    b = runs.segments(rows.withColumn("auto", F.when(F.col("isi") < 0.012, "burst").otherwise(F.col("auto"))), F.col("auto")).where("label <> ''").select("train", "label", "start", "end")
    return va.delta(a, b).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT g AS surrogate, train, count(isi) AS n, round(sum(isi), 9) AS total, round(min(isi), 9) AS shortest, round(max(isi), 9) AS longest FROM s, (SELECT unnest(range(1, 4)) AS g) GROUP BY ALL")
def interval_surrogates(spark, d):
    x = va.shuffled_intervals(trains(spark, d), 3)
    return rounded(x.groupBy(F.col("surrogate").cast("long").alias("surrogate"), "train").agg(F.count("isi").alias("n"), F.sum("isi").alias("total"), F.min("isi").alias("shortest"), F.max("isi").alias("longest")))


@query()
def surrogate_significance(spark, d):
    """Is the local variation of each train larger than that of its shuffled intervals?"""
    from pulsegrid.operators.isi import valid_pairs
    from pulsegrid.operators.statistics import benjamini_hochberg

    rows = trains(spark, d)
    seen = valid_pairs(rows).groupBy("train").agg(F.avg("lv").alias("lv"))
    lv = va.shuffled_lists(rows, 50).select("surrogate", "train", va.mean_lv(F.col("intervals")).alias("lv"))
    return rounded(benjamini_hochberg(stored(va.empirical_p(seen, lv, "lv"), "train-p"), [], "p"))


@query("SELECT CASE WHEN manual IN ('burst', 'long_burst', 'possible_burst') THEN 'burst_family' WHEN manual = '' THEN 'none' ELSE manual END AS truth, CASE WHEN auto IN ('burst', 'long_burst', 'possible_burst') THEN 'burst_family' WHEN auto = '' THEN 'none' ELSE auto END AS pred, count(*) AS n FROM s GROUP BY ALL")
def family_confusion(spark, d):
    from pulsegrid.functions.labels import family
    from pulsegrid.operators.statistics import confusion

    x = labelled(trains(spark, d))
    return confusion(x.select(family(F.col("manual")).alias("manual"), family(F.col("auto")).alias("auto")), "manual", "auto")


TUNED = ["seed_high", "bridge", "tonic_max", "pause_min"]


def variant_counts(spark, d):
    """(names of the variants, counts of what each of them finds against the labels by hand, trains with their durations, events by hand)."""
    from pulsegrid.operators import tuning as tu
    from pulsegrid.operators import variant_scan as vs

    from .detector_queries import settings

    rows = stored(labelled(trains(spark, d)), "labelled")
    names = stored(tu.variants(spark, TUNED, settings(spark, d, rows)), "variants")
    each = stored(rows.groupBy("train").agg((F.max("t") - F.min("t")).alias("duration")), "durations")
    truth = stored(runs.segments(rows, F.col("manual")).where("label <> ''").select("train", "label", "start", "end"), "true-events")
    return names, stored(vs.counts(rows, tu.grammars(names)), "variant-counts"), each, truth


@query()
def setting_scan(spark, d):
    """How the detectors' agreement with the labels by hand depends on four settings, with paired tests over trains."""
    from pulsegrid.operators import tuning as tu

    names, c, _, _ = variant_counts(spark, d)
    return rounded(tu.sensitivity(c, names))


def holdout(spark, d):
    from pulsegrid.operators import tuning as tu

    names, c, each, truth = variant_counts(spark, d)
    return tu.repeated_holdout(c, names, each, truth, repeats=20)


@query()
def nested_tuning(spark, d):
    return rounded(holdout(spark, d)["repeats"])


@query()
def holdout_summary(spark, d):
    return rounded(holdout(spark, d)["summary"])


@query()
def holdout_splits(spark, d):
    from pulsegrid.operators import tuning as tu

    rows = labelled(trains(spark, d))
    each = rows.groupBy("train").agg((F.max("t") - F.min("t")).alias("duration"))
    own = stored(tu.strata(each, runs.segments(rows, F.col("manual")).where("label <> ''")), "strata")
    splits = tu.stratified_splits(own.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(20)))), ["repeat"])
    return splits.join(own.select("train", "stratum"), "train")
