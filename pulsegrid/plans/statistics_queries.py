"""Queries over distributions, spans and agreement."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.stats import entropy
from pulsegrid.operators import isi, runs
from pulsegrid.operators import statistics as st
from pulsegrid.sources.events import labelled, trains

from .join_queries import SPANS, spans
from .registry import query, r, rounded


@query("""SELECT train, v AS threshold, round(avg((isi <= v)::INT), 9) AS at_most, round(avg((isi >= v)::INT), 9) AS at_least FROM s, (VALUES (0.01::DOUBLE), (0.05::DOUBLE)) t(v) WHERE valid GROUP BY ALL""")
def ecdf_mass(spark, d):
    return rounded(st.ecdf_mass(trains(spark, d), [0.01, 0.05]))


@query(""", x AS (SELECT train, isi, kind IN ('click', 'view') AS a FROM s WHERE valid), u AS (SELECT DISTINCT train, isi FROM x),
g AS (SELECT u.train, u.isi, avg((x.isi <= u.isi)::INT) FILTER (a) AS fa, avg((x.isi <= u.isi)::INT) FILTER (NOT a) AS fb FROM u JOIN x USING (train) GROUP BY u.train, u.isi)
SELECT train, round(max(abs(fa - fb)), 9) AS ks FROM g WHERE fa IS NOT NULL AND fb IS NOT NULL GROUP BY train""")
def ks_distance(spark, d):
    return rounded(st.ks_distance(trains(spark, d).where("valid"), "isi", F.col("kind").isin("click", "view")))


@query(""", x AS (SELECT train, isi, kind IN ('click', 'view') AS a, row_number() OVER (PARTITION BY train, kind IN ('click', 'view') ORDER BY isi) AS k, count(*) OVER (PARTITION BY train, kind IN ('click', 'view')) AS n FROM s WHERE valid),
p AS (SELECT i / 100.0::DOUBLE AS p FROM (SELECT unnest(range(0, 101)) AS i)),
h AS (SELECT DISTINCT train, a, n, p, (n + 1 / 3.0::DOUBLE) * p + 1 / 3.0::DOUBLE AS h FROM x, p),
v AS (SELECT h.*, (SELECT isi FROM x WHERE x.train = h.train AND x.a = h.a AND x.k = least(greatest(floor(h), 1), h.n)) AS lo, (SELECT isi FROM x WHERE x.train = h.train AND x.a = h.a AND x.k = least(greatest(floor(h) + 1, 1), h.n)) AS hi FROM h),
w AS (SELECT train, a, p, lo + (h - floor(h)) * (hi - lo) AS q FROM v)
SELECT a.train, round(avg(abs(a.q - b.q)), 9) AS w1 FROM w a JOIN w b ON a.train = b.train AND a.p = b.p AND a.a AND NOT b.a GROUP BY a.train""")
def wasserstein_distance(spark, d):
    return rounded(st.wasserstein(trains(spark, d).where("valid"), "isi", F.col("kind").isin("click", "view")))


@query("SELECT train, kind, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS sem FROM s GROUP BY ALL")
def standard_error(spark, d):
    return trains(spark, d).groupBy("train", "kind").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), 6).alias("mean"), r(F.stddev_samp("value") / F.sqrt(F.count("value")), 6).alias("sem"))


SPAN_SQL = """, f AS (SELECT *, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM s WHERE valid AND isi <= 0.025),
c AS (SELECT train, min(idx) AS start, max(idx) AS e FROM f GROUP BY train, run HAVING count(*) >= 2)"""


def short_spans(spark, d):
    return runs.runs(trains(spark, d), F.col("valid") & (F.col("isi") <= 0.025), least=2).select("train", "start", "end")


@query(f"""{SPAN_SQL}, x AS (SELECT c.*, s.idx, s.isi, s.suspect, lag(s.isi) OVER (PARTITION BY c.train, c.start ORDER BY s.idx) AS a FROM c JOIN s ON s.train = c.train AND s.idx BETWEEN c.start AND c.e),
g AS (SELECT train, start, e, count(*) AS n_isi, quantile_cont(isi, 0.1) AS q10, quantile_cont(isi, 0.5) AS q50, quantile_cont(isi, 0.9) AS q90, quantile_cont(isi, 0.95) AS q95, avg(isi) AS mean_isi, max(isi) AS max_isi, sum(isi) AS duration,
 stddev_samp(isi) / avg(isi) AS cv, max(isi) / avg(isi) AS mm, count(*) FILTER (isi <= 0.01) AS core, count(*) FILTER (isi > 0.01 AND isi <= 0.025) AS bridges, count(*) FILTER (suspect) AS suspects,
 avg(3 * (a - isi) ** 2 / (a + isi) ** 2) AS lv FROM x GROUP BY ALL)
SELECT g.train, g.start, g.e AS "end", n_isi, round(q10, 9) AS q10, round(q50, 9) AS q50, round(q90, 9) AS q90, round(q95, 9) AS q95, round(mean_isi, 9) AS mean_isi, round(max_isi, 9) AS max_isi, round(duration, 9) AS duration,
 round(cv, 9) AS cv, round(mm, 9) AS mm, core, bridges, suspects, round(lv, 9) AS lv, round(p.isi, 9) AS pre, round(q.isi, 9) AS post, round(p.isi / q90, 6) AS pre_ratio, round(q.isi / q90, 6) AS post_ratio,
 CASE WHEN p.isi IS NOT NULL AND q.isi IS NOT NULL THEN round(least(p.isi, q.isi) / q90, 6) END AS contrast, round(sqrt(p.isi / q90 * q.isi / q90), 6) AS geometric,
 round(100 * (least(p.isi, q.isi) / q90 - 1), 4) AS percent
FROM g LEFT JOIN s p ON p.train = g.train AND p.idx = g.start - 1 LEFT JOIN s q ON q.train = g.train AND q.idx = g.e + 1""")
def span_metrics(spark, d):
    rows = trains(spark, d)
    out = st.span_metrics(rows, short_spans(spark, d), 0.01, 0.025)
    return rounded(out.withColumns({c: r(c, 6) for c in ("pre_ratio", "post_ratio", "contrast", "geometric")} | {"percent": r("percent", 4)}))


@query(f"""{SPAN_SQL} SELECT c.train, count(*) FILTER (suspect) AS suspects, round(avg(suspect::INT), 9) AS share, round(min(isi) FILTER (suspect), 9) AS shortest FROM c JOIN s ON s.train = c.train AND s.idx BETWEEN c.start AND c.e GROUP BY c.train""")
def refractory_summary(spark, d):
    from pulsegrid.operators.joins import range_join

    at = trains(spark, d).select("train", F.col("idx").alias("start"), F.col("idx").alias("end"), "isi", "suspect")
    x = range_join(short_spans(spark, d), at, ["train"])
    return rounded(x.groupBy("train").agg(F.count_if("r_suspect").alias("suspects"), F.avg(F.col("r_suspect").cast("double")).alias("share"), F.min(F.when(F.col("r_suspect"), F.col("r_isi"))).alias("shortest")))


@query(""", n AS (SELECT train, auto, count(*) AS n FROM s WHERE trim(auto) <> '' GROUP BY ALL)
SELECT train, auto AS mode FROM (SELECT *, row_number() OVER (PARTITION BY train ORDER BY n DESC, auto) AS k FROM n) WHERE k = 1""")
def first_mode(spark, d):
    return labelled(trains(spark, d)).groupBy("train").agg(st.first_mode(F.col("auto")).alias("mode")).where("mode is not null")


@query(""", m AS (SELECT manual AS label, isi FROM s WHERE manual <> ''), c AS (SELECT label, quantile_cont(isi, 0.5) AS centre, count(*) AS n FROM m GROUP BY label),
d AS (SELECT label, quantile_cont(abs(ln(isi) - ln(centre)), 0.5) * 1.4826 AS mad FROM m JOIN c USING (label) GROUP BY label)
SELECT label, round(centre, 9) AS centre, n, round(greatest(mad, CASE WHEN n < 3 THEN 0.8 WHEN n < 8 THEN 0.55 ELSE 0.3 END), 9) AS spread, round(n / (n + 6), 9) AS confidence FROM c JOIN d USING (label)""")
def manual_anchors(spark, d):
    return rounded(st.anchors(labelled(trains(spark, d)).where("manual <> ''").withColumnRenamed("manual", "label"), ["label"], "isi"))


CONFUSION = """, t AS (SELECT CASE WHEN manual = '' THEN 'none' ELSE manual END AS truth, CASE WHEN auto = '' THEN 'none' ELSE auto END AS pred, count(*) AS n FROM s GROUP BY ALL),
k AS (SELECT truth AS label FROM t UNION SELECT pred FROM t),
m AS (SELECT label, coalesce((SELECT sum(n) FROM t WHERE truth = label), 0)::BIGINT AS truth_n, coalesce((SELECT sum(n) FROM t WHERE pred = label), 0)::BIGINT AS pred_n, coalesce((SELECT sum(n) FROM t WHERE truth = label AND pred = label), 0)::BIGINT AS tp FROM k),
p AS (SELECT *, CASE WHEN pred_n > 0 THEN tp / pred_n END AS pr, CASE WHEN truth_n > 0 THEN tp / truth_n END AS re, 1.959963984540054 ** 2 AS zz FROM m),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) END AS f1 FROM p)"""


@query(f"{CONFUSION} SELECT truth, pred, n FROM t")
def confusion_table(spark, d):
    return st.confusion(labelled(trains(spark, d)), "manual", "auto")


@query(f"""{CONFUSION} SELECT label, truth_n, pred_n, tp, round(pr, 9) AS precision, round(re, 9) AS recall, round(f1, 9) AS f1,
 CASE WHEN truth_n > 0 THEN round(greatest((re + zz / (2 * truth_n)) / (1 + zz / truth_n) - sqrt(zz) / (1 + zz / truth_n) * sqrt(re * (1 - re) / truth_n + zz / (4 * truth_n ** 2)), 0), 9) END AS recall_low,
 CASE WHEN truth_n > 0 THEN round(least((re + zz / (2 * truth_n)) / (1 + zz / truth_n) + sqrt(zz) / (1 + zz / truth_n) * sqrt(re * (1 - re) / truth_n + zz / (4 * truth_n ** 2)), 1), 9) END AS recall_high FROM f""")
def class_metrics(spark, d):
    return rounded(st.class_metrics(st.confusion(labelled(trains(spark, d)), "manual", "auto")))


@query(f"""{CONFUSION}, a AS (SELECT sum(truth_n)::BIGINT AS n, sum(tp)::DOUBLE AS hit, sum(truth_n * pred_n)::DOUBLE AS chance, avg(re) AS b, avg(f1) AS mf FROM f)
SELECT n, round(hit / n, 9) AS accuracy, round(b, 9) AS balanced_accuracy, round(mf, 9) AS macro_f1, round((hit / n - chance / n / n) / (1 - chance / n / n), 9) AS kappa FROM a""")
def kappa_agreement(spark, d):
    return rounded(st.agreement(st.confusion(labelled(trains(spark, d)), "manual", "auto")))


@query(""", p AS (SELECT train, kind, count(*) / sum(count(*)) OVER (PARTITION BY train) AS p FROM s GROUP BY train, kind)
SELECT train, round(sum(-p * log2(p)), 9) AS entropy, round(sum(-p * log2(p)) / log2(count(*)), 9) AS normalised FROM p GROUP BY train HAVING count(*) > 1""")
def kind_entropy(spark, d):
    p = trains(spark, d).groupBy("train", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("train")))
    return rounded(p.groupBy("train").agg(entropy(F.col("p")).alias("entropy"), (entropy(F.col("p")) / F.log2(F.count(F.lit(1)))).alias("normalised"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"))


@query(""", x AS (SELECT train, idx, coalesce(isi, quantile_cont(isi, 0.5) OVER (PARTITION BY train)) AS isi FROM s),
c AS (SELECT train, quantile_cont(isi, 0.5) AS c, stddev_samp(isi) AS sd FROM x GROUP BY train), m AS (SELECT x.train, quantile_cont(abs(isi - c), 0.5) * 1.4826 AS mad FROM x JOIN c USING (train) GROUP BY x.train)
SELECT x.train, x.idx, round((isi - c) / CASE WHEN mad > 0 THEN mad ELSE sd END, 9) AS isi_scaled FROM x JOIN c USING (train) JOIN m USING (train)""")
def robust_scaling(spark, d):
    return rounded(st.scaled(trains(spark, d).select("train", "idx", "isi"), ["isi"]).select("train", "idx", "isi_scaled"))


@query("SELECT train, idx, CASE WHEN sd > 0 THEN round((value - m) / sd, 9) ELSE 0 END AS value_scaled FROM (SELECT *, avg(value) OVER (PARTITION BY train) AS m, stddev_samp(value) OVER (PARTITION BY train) AS sd FROM s)")
def z_scaling(spark, d):
    return rounded(st.scaled(trains(spark, d).select("train", "idx", "value"), ["value"], robust=False).select("train", "idx", "value_scaled"))


@query(f"""{SPAN_SQL}, g AS (SELECT train, avg((isi <= 0.02)::INT) AS whole FROM s WHERE valid GROUP BY train),
o AS (SELECT c.train, c.start, c.e, avg((isi <= 0.02)::INT) FILTER (idx BETWEEN c.start AND c.e) AS inside, avg((isi <= 0.02)::INT) FILTER (idx NOT BETWEEN c.start AND c.e) AS flanks
 FROM c JOIN s ON s.train = c.train AND valid AND s.idx BETWEEN c.start - 10 AND c.e + 10 GROUP BY ALL)
SELECT train, start, e AS "end", round(inside, 9) AS inside, round(flanks, 9) AS flanks, round(whole, 9) AS whole, CASE WHEN inside IS NULL THEN 'unresolved' WHEN inside - coalesce(flanks, whole) >= 0.5 AND inside > whole THEN 'supported'
 WHEN inside <= whole THEN 'not_supported' ELSE 'weak' END AS verdict FROM o JOIN g USING (train)""")
def distributional_support(spark, d):
    return rounded(st.distributional_support(trains(spark, d), short_spans(spark, d)))


@query(""", p AS (SELECT train, idx, (idx * 37 % 101 + 1) / 102.0::DOUBLE AS p FROM s), k AS (SELECT *, count(*) OVER (PARTITION BY train) AS n, count(*) OVER (PARTITION BY train ORDER BY p) AS last FROM p)
SELECT train, idx, round(p, 9) AS p, round(min(least(p * n / last, 1)) OVER (PARTITION BY train ORDER BY p DESC), 9) AS q FROM k""")
def bh_adjustment(spark, d):
    p = trains(spark, d).select("train", "idx", ((F.col("idx") * 37 % 101 + 1) / F.lit(102.0)).alias("p"))
    return rounded(st.benjamini_hochberg(p, ["train"], "p"))


@query(f"""{SPANS}, c AS (SELECT 'manual' AS source, label, count(*) AS n FROM m GROUP BY label UNION ALL SELECT 'auto', label, count(*) FROM p GROUP BY label) SELECT * FROM c""")
def event_counts(spark, d):
    m, p = spans(spark, d)
    return m.withColumn("source", F.lit("manual")).unionByName(p.withColumn("source", F.lit("auto"))).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT train, count(*) AS n, round(min(isi), 9) AS shortest, round(max(isi), 9) AS longest, round(sum(isi), 9) AS dwell FROM s WHERE valid GROUP BY train HAVING count(*) >= 50 ORDER BY train")
def long_trains(spark, d):
    x = trains(spark, d).where("valid").groupBy("train").agg(F.count(F.lit(1)).alias("n"), F.min("isi").alias("shortest"), F.max("isi").alias("longest"), F.sum("isi").alias("dwell"))
    return rounded(x.where("n >= 50").orderBy("train"))


@query("SELECT train, event_id, kind, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY train ORDER BY value DESC, event_id) AS k FROM s) WHERE k <= 3")
def top_k_by_value(spark, d):
    k = F.row_number().over(Window.partitionBy("train").orderBy(F.desc("value"), "event_id"))
    return trains(spark, d).withColumn("k", k).where("k <= 3").select("train", "event_id", "kind", r("value", 6).alias("value"))


@query("SELECT train, max_by(event_id, (value, -event_id)) AS best, min_by(kind, (us, event_id)) AS first_kind FROM s GROUP BY train")
def argmax_first(spark, d):
    return trains(spark, d).groupBy("train").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"), F.min_by("kind", F.struct("us", "event_id")).alias("first_kind"))


@query(""", k AS (SELECT train, idx, count(*) OVER (PARTITION BY train) AS n FROM s) SELECT train, idx FROM k WHERE n <= 20 OR floor((idx - 1) * 20 / n) > floor((idx - 2) * 20 / n)""")
def even_subsample(spark, d):
    n = F.count(F.lit(1)).over(Window.partitionBy("train"))
    x = trains(spark, d).withColumn("n", n)
    return x.where((F.col("n") <= 20) | (F.floor((F.col("idx") - 1) * 20 / F.col("n")) > F.floor((F.col("idx") - 2) * 20 / F.col("n")))).select("train", "idx")


@query("SELECT train, list(kind ORDER BY idx)[1:5]::VARCHAR[] AS preview FROM s GROUP BY train")
def preview(spark, d):
    from pulsegrid.operators.isi import in_train

    x = trains(spark, d).withColumn("p", F.collect_list("kind").over(in_train().rowsBetween(0, 4))).where("idx = 1")
    return x.select("train", F.col("p").alias("preview"))


@query(f"""{SPANS}, u AS (SELECT train, label, start, e FROM m UNION ALL SELECT train, label, start, e FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY train, start, e ORDER BY label) AS k FROM u) SELECT train, label, start, e AS "end" FROM k WHERE k = 1""")
def distinct_windows(spark, d):
    m, p = spans(spark, d)
    k = F.row_number().over(Window.partitionBy("train", "start", "end").orderBy("label"))
    return m.unionByName(p).withColumn("k", k).where("k = 1").drop("k")


@query("SELECT train FROM s WHERE kind = 'error' INTERSECT SELECT train FROM s WHERE isi > 0.1")
def train_intersection(spark, d):
    rows = trains(spark, d)
    return rows.where("kind = 'error'").select("train").intersect(rows.where("isi > 0.1").select("train"))


@query(f"{SPANS} SELECT DISTINCT train, label FROM m EXCEPT SELECT train, label FROM p")
def missing_classes(spark, d):
    m, p = spans(spark, d)
    keys = ["train", "label"]
    return m.select(*keys).distinct().join(p, keys, "left_anti")


@query(f"{SPANS} SELECT label FROM m UNION SELECT label FROM p")
def union_of_classes(spark, d):
    m, p = spans(spark, d)
    return m.select("label").union(p.select("label")).distinct()


@query("""SELECT event_id, lower(trim(kind)) AS kind, CASE WHEN auto IN ('burst', 'possible_burst', 'long_burst') THEN 'burst_family' ELSE auto END AS family, regexp_replace(auto, '^possible_', '') AS promoted,
 concat_ws(';', CASE WHEN artifact THEN 'artifact' END, CASE WHEN suspect THEN 'suspect' END, CASE WHEN NOT valid THEN 'invalid' END) AS reasons, round(sqrt(value + 0.375), 9) AS anscombe, round(ln(1 + value), 9) AS log1p,
 least(greatest(value / 100, 0), 1) AS clamped, try_cast(regexp_extract(props, '(\\d+)', 1) AS INT) AS k, CASE WHEN regexp_matches(kind, '^[=+@-]') THEN '''' || kind ELSE kind END AS safe FROM s JOIN (SELECT event_id AS eid, props FROM events) ON eid = event_id""")
def scalar_functions(spark, d):
    from pulsegrid.functions.labels import family, promoted
    from pulsegrid.functions.stats import clamp
    from pulsegrid.sources.events import events

    x = labelled(trains(spark, d)).join(events(spark, d).select("event_id", "props"), "event_id")
    reasons = F.concat_ws(";", F.when(F.col("artifact"), "artifact"), F.when(F.col("suspect"), "suspect"), F.when(~F.col("valid"), "invalid"))
    return x.select("event_id", F.lower(F.trim("kind")).alias("kind"), family(F.col("auto")).alias("family"), promoted(F.col("auto")).alias("promoted"), reasons.alias("reasons"), r(F.sqrt(F.col("value") + 0.375)).alias("anscombe"), r(F.log1p("value")).alias("log1p"),
        clamp(F.col("value") / 100).alias("clamped"), F.regexp_extract("props", r"(\d+)", 1).try_cast("int").alias("k"), F.when(F.col("kind").rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), "kind")).otherwise(F.col("kind")).alias("safe"))
