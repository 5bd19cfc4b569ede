"""Queries over interval features."""

from pyspark.sql import functions as F

from pulsegrid.functions.stats import q
from pulsegrid.operators import isi
from pulsegrid.sources.events import trains

from .registry import query, r, rounded


@query("""SELECT train, count(*) AS n_spikes, count(*) FILTER (valid) AS n_valid, count(*) FILTER (artifact) AS n_artifact, count(*) FILTER (suspect) AS n_suspect,
 round(max(t) - min(t), 9) AS duration, round(count(*) / (max(t) - min(t)), 6) AS rate, round(avg(isi) FILTER (valid), 9) AS mean_isi,
 round(quantile_cont(isi, 0.5) FILTER (valid), 9) AS median_isi, round(quantile_cont(isi, 0.1) FILTER (valid), 9) AS q10, round(quantile_cont(isi, 0.9) FILTER (valid), 9) AS q90,
 round(stddev_samp(isi) FILTER (valid) / avg(isi) FILTER (valid), 9) AS cv, round(max(isi) FILTER (valid) / avg(isi) FILTER (valid), 9) AS mm,
 any_value(lv) AS lv, any_value(cv2) AS cv2, any_value(lvr) AS lvr
FROM s LEFT JOIN (SELECT train, round(avg(3 * (a - isi) ** 2 / (a + isi) ** 2), 9) AS lv, round(avg(2 * abs(a - isi) / (a + isi)), 9) AS cv2,
   round(avg(3 * (1 - 4 * a * isi / (a + isi) ** 2) * (1 + 4 * 0.005 / (a + isi))), 9) AS lvr
   FROM (SELECT train, isi, lag(isi) OVER (PARTITION BY train ORDER BY idx) AS a FROM s WHERE valid) GROUP BY train) USING (train)
GROUP BY train""")
def train_summary(spark, d):
    return rounded(isi.train_summary(trains(spark, d)).withColumn("rate", r("rate", 6)))


@query("SELECT train, event_id, idx, round(t, 12) AS t, round(isi, 12) AS isi, valid, artifact, suspect FROM s")
def intervals(spark, d):
    return rounded(trains(spark, d).select("train", "event_id", "idx", "t", "isi", "valid", "artifact", "suspect"), 12)


@query("SELECT train, event_id, idx, round(t, 12) AS t, round(isi, 12) AS isi, valid, artifact, suspect FROM s")
def intervals_in_ranges(spark, d):
    from pulsegrid.sources import events

    return rounded(events.intervals_in_ranges(events.spikes(spark, d)).select("train", "event_id", "idx", "t", "isi", "valid", "artifact", "suspect"), 12)


@query("SELECT train, idx, CASE WHEN valid THEN round(100 * cume_dist() OVER (PARTITION BY train, valid ORDER BY isi), 9) END AS pct FROM s")
def isi_percentile(spark, d):
    return rounded(isi.percentile_rank(trains(spark, d)).select("train", "idx", "pct"))


@query("SELECT train, p, round(quantile_cont(isi, 0.25) FILTER (p = 25), 9) AS isi FROM s, (VALUES (25)) v(p) WHERE valid GROUP BY train, p UNION ALL SELECT train, 90, round(quantile_cont(isi, 0.9), 9) FROM s WHERE valid GROUP BY train")
def isi_at_percentile(spark, d):
    rows = trains(spark, d).where("valid").groupBy("train").agg(q("isi", 0.25).alias("a"), q("isi", 0.9).alias("b"))
    return rounded(rows.select("train", F.explode(F.create_map(F.lit(25), "a", F.lit(90), "b")).alias("p", "isi")))


@query("SELECT train, count(*) FILTER (valid) AS n_valid, count(*) FILTER (valid) >= 50 AS reliable FROM s GROUP BY train")
def percentile_reliability(spark, d):
    return trains(spark, d).groupBy("train").agg(F.count_if("valid").alias("n_valid")).withColumn("reliable", F.col("n_valid") >= 50)


@query(""", v AS (SELECT *, min(isi) OVER w AS lo, max(isi) OVER w AS hi, quantile_cont(isi, 0.01) OVER w AS q01, quantile_cont(isi, 0.99) OVER w AS q99 FROM s WHERE valid WINDOW w AS (PARTITION BY train))
SELECT train, idx, round(least(greatest(100 * (isi - lo) / (hi - lo), 0), 100), 6) AS linear, round(least(greatest(100 * (ln(isi) - ln(lo)) / (ln(hi) - ln(lo)), 0), 100), 6) AS logarithmic,
 round(least(greatest(100 * (ln(isi) - ln(q01)) / (ln(q99) - ln(q01)), 0), 100), 6) AS robust FROM v""")
def isi_range_metrics(spark, d):
    return rounded(isi.range_metrics(trains(spark, d)).select("train", "idx", "linear", "logarithmic", "robust"), 6)


@query(""", v AS (SELECT train, idx, CASE WHEN valid THEN isi END AS x FROM s)
SELECT a.train, a.idx, round(quantile_cont(b.x, 0.5), 9) AS local_median FROM v a LEFT JOIN v b ON a.train = b.train AND b.idx BETWEEN a.idx - 5 AND a.idx + 5 AND b.idx <> a.idx GROUP BY ALL""")
def isi_local_median(spark, d):
    return rounded(isi.local_median(trains(spark, d)).select("train", "idx", "local_median"))


@query(""", v AS (SELECT train, idx, CASE WHEN valid AND isi <= 0.1 THEN isi END AS x FROM s)
SELECT a.train, a.idx, round(quantile_cont(b.x, 0.5), 9) AS detector_median FROM v a LEFT JOIN v b ON a.train = b.train AND b.idx BETWEEN a.idx - 11 AND a.idx + 11 GROUP BY ALL""")
def isi_detector_median(spark, d):
    return rounded(isi.detector_median(trains(spark, d), left_out=F.col("isi") > 0.1).select("train", "idx", "detector_median"))


@query(""", v AS (SELECT train, idx, isi, row_number() OVER (PARTITION BY train ORDER BY idx) AS k FROM s WHERE valid)
SELECT a.train, a.idx, round(quantile_cont(b.isi, 0.5) FILTER (b.k < a.k), 9) AS pre, round(quantile_cont(b.isi, 0.5) FILTER (b.k > a.k), 9) AS post
FROM v a JOIN v b ON a.train = b.train AND b.k BETWEEN a.k - 3 AND a.k + 3 GROUP BY ALL""")
def isi_k_context(spark, d):
    return rounded(isi.k_context(trains(spark, d)).select("train", "idx", "pre", "post"))


@query(""", p AS (SELECT train, count(*) AS n, round(quantile_cont(isi, 0.1), 9) AS q10, round(quantile_cont(isi, 0.25), 9) AS q25, round(quantile_cont(isi, 0.5), 9) AS q50, round(quantile_cont(isi, 0.75), 9) AS q75,
 round(quantile_cont(isi, 0.9), 9) AS q90, round(avg((isi <= 0.01)::INT), 9) AS short_share, round(avg((isi > 0.07)::INT), 9) AS long_share, round(stddev_samp(isi) / avg(isi), 9) AS cv FROM s WHERE valid GROUP BY train)
SELECT *, CASE WHEN short_share >= 0.3 THEN 'bursty' WHEN long_share >= 0.3 THEN 'pausing' WHEN cv <= 0.5 THEN 'regular' ELSE 'irregular' END AS phenotype FROM p""")
def train_state_profile(spark, d):
    return rounded(isi.state_profile(trains(spark, d)))


@query(""", b AS (SELECT train, floor(isi / 0.005)::BIGINT AS bin, count(*) AS n FROM s WHERE valid GROUP BY ALL),
e AS (SELECT train, unnest(range(0, max(bin) + 1)) AS bin FROM b GROUP BY train)
SELECT train, bin, coalesce(n, 0) AS n FROM e LEFT JOIN b USING (train, bin)""")
def isi_histogram(spark, d):
    return isi.histogram(trains(spark, d))


@query("""SELECT train, idx, round(log10(isi), 9) AS x, round(log10(nxt), 9) AS y, auto FROM (SELECT *, lead(isi) OVER (PARTITION BY train ORDER BY idx) AS nxt FROM s WHERE valid) WHERE nxt IS NOT NULL""")
def phase_portrait(spark, d):
    from pulsegrid.sources.events import labelled

    return rounded(isi.phase_portrait(labelled(trains(spark, d))).select("train", "idx", "x", "y", "auto"))


@query("""SELECT train, idx, round(CASE WHEN n >= 4 THEN least(greatest(isi, a), b) ELSE isi END, 9) AS clipped FROM (
 SELECT *, count(*) OVER w AS n, quantile_cont(isi, 0.01) OVER w AS a, quantile_cont(isi, 0.99) OVER w AS b FROM s WHERE valid WINDOW w AS (PARTITION BY train))""")
def isi_winsorised(spark, d):
    return rounded(isi.winsorised(trains(spark, d)).select("train", "idx", "clipped"))


@query(""", v AS (SELECT train, idx, isi, row_number() OVER (PARTITION BY train ORDER BY idx) AS k FROM s WHERE valid),
n AS (SELECT a.train, a.idx, avg(b.isi) AS m, quantile_cont(b.isi, 0.5) AS med, stddev_samp(b.isi) AS sd, quantile_cont(b.isi, 0.1) AS q1, quantile_cont(b.isi, 0.9) AS q9,
 quantile_cont(b.isi, 0.75) - quantile_cont(b.isi, 0.25) AS iqr, avg(b.isi) FILTER (b.k < a.k) AS pre, avg(b.isi) FILTER (b.k > a.k) AS post
 FROM v a JOIN v b ON a.train = b.train AND b.k BETWEEN a.k - 5 AND a.k + 5 GROUP BY ALL)
SELECT v.train, v.idx, round(lag(isi, 1) OVER w, 9) AS lag1, round(lag(isi, 2) OVER w, 9) AS lag2, round(lag(isi, 3) OVER w, 9) AS lag3,
 round(lead(isi, 1) OVER w, 9) AS lead1, round(lead(isi, 2) OVER w, 9) AS lead2, round(lead(isi, 3) OVER w, 9) AS lead3,
 round(m, 9) AS local_mean, round(med, 9) AS local_median, round(sd, 9) AS local_sd, round(q1, 9) AS local_q10, round(q9, 9) AS local_q90, round(iqr, 9) AS local_iqr, round(sd / m, 9) AS local_cv,
 round(2 * abs(lag(isi) OVER w - isi) / (lag(isi) OVER w + isi), 9) AS cv2, round(isi - lag(isi) OVER w, 9) AS delta, round(ln(isi / lag(isi) OVER w), 9) AS log_ratio, round(1 / isi, 6) AS rate, round(pre / post, 9) AS pre_post
FROM v JOIN n USING (train, idx) WINDOW w AS (PARTITION BY v.train ORDER BY v.idx)""")
def isi_state_features(spark, d):
    rows = isi.state_features(trains(spark, d)).drop("event_id", "us", "t", "kind", "value", "isi", "valid", "artifact", "suspect")
    return rounded(rows.withColumn("rate", r("rate", 6)))


@query(""", v AS (SELECT *, min(t) OVER w AS a, max(t) OVER w AS b, count(*) OVER w AS n FROM s WHERE valid WINDOW w AS (PARTITION BY train)),
m AS (SELECT train, least(greatest(ceil((t - a) / (b - a) * 8), 1), 8) AS bin, quantile_cont(isi, 0.5) AS m FROM v WHERE n >= 60 AND b > a GROUP BY ALL),
o AS (SELECT train, count(*) AS k, max(m) / min(m) AS r FROM m GROUP BY train),
n AS (SELECT train, count(*) AS spikes, count(*) FILTER (valid) AS valids FROM s GROUP BY train)
SELECT n.train, CASE WHEN spikes < 3 THEN 'unavailable' WHEN valids < 60 THEN 'low_n' WHEN coalesce(k, 0) < 3 THEN 'unavailable' WHEN r >= 6 THEN 'warning_high_drift' WHEN r >= 3 THEN 'warning' ELSE 'ok' END AS status,
 CASE WHEN k >= 3 THEN round(r, 6) END AS ratio, CASE WHEN k >= 3 THEN round(log10(r), 6) END AS log_range, coalesce(k, 0) AS bins FROM n LEFT JOIN o USING (train)""")
def train_stationarity(spark, d):
    return rounded(isi.stationarity(trains(spark, d)), 6)


@query(""", x AS (SELECT train, log10(isi) AS x FROM s WHERE valid),
m AS (SELECT train, count(*) AS n, avg(x) AS mean, stddev_samp(x) AS sd, stddev_pop(x) AS sp, quantile_cont(x, 0.1) AS q10, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.9) AS q90, quantile_cont(x, 0.95) AS q95 FROM x GROUP BY train)
SELECT m.train, any_value(n) AS n, round(any_value(mean), 6) AS mean, round(any_value(sd), 6) AS sd, round(avg(((x - mean) / sd) ** 3), 6) AS skew, round(avg(((x - mean) / sd) ** 4) - 3, 6) AS kurtosis,
 round(any_value(q10), 6) AS q10, round(any_value(q50), 6) AS q50, round(any_value(q90), 6) AS q90, round(any_value(q95), 6) AS q95,
 round(any_value((q90 + q10 - 2 * q50) / (q90 - q10)), 6) AS robust_skew, round(any_value((q95 - q50) / (q50 - q10)), 6) AS tail_ratio
FROM x JOIN m USING (train) GROUP BY m.train""")
def log_isi_moments(spark, d):
    return rounded(isi.moments(trains(spark, d)), 6)


@query("""SELECT train, count(*) AS n_spikes, count(*) FILTER (valid) AS n_valid, count(*) FILTER (artifact) AS n_artifact, count(*) FILTER (suspect) AS n_suspect, round(max(t) - min(t), 9) AS duration,
 round(count(*) / (max(t) - min(t)), 6) AS rate, round(count(*) FILTER (artifact) / greatest(count(*) - 1, 1), 9) AS artifact_share,
 CASE WHEN max(t) <= min(t) THEN 'error' WHEN count(*) < 10 OR count(*) FILTER (artifact OR suspect) > 0 THEN 'warn' ELSE 'ok' END AS level,
 concat_ws(';', CASE WHEN max(t) <= min(t) THEN 'invalid duration' END, CASE WHEN count(*) < 10 THEN 'few spikes' END, CASE WHEN count(*) FILTER (artifact) > 0 THEN 'artifact intervals' END,
  CASE WHEN count(*) FILTER (suspect) > 0 THEN 'refractory suspects' END) AS messages FROM s GROUP BY train""")
def train_quality(spark, d):
    return rounded(isi.quality(trains(spark, d)).withColumn("rate", r("rate", 6)))
