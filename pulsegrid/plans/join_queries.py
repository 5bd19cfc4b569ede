"""Queries over joins."""

from pyspark.sql import functions as F

from pulsegrid.operators import joins, runs
from pulsegrid.sources.events import labelled, task_events, trains
from pulsegrid.sources.shared import stored

from .registry import query, rounded

SEC = 1_000_000_000_000
#: SQL: runs of equal labels by hand (m) and by bands (p), with an id in order of their starts.
SPANS = """, mc AS (SELECT *, idx - row_number() OVER (PARTITION BY train, manual ORDER BY idx) AS run FROM s WHERE manual <> ''),
m AS (SELECT train, manual AS label, min(idx) AS start, max(idx) AS e FROM mc GROUP BY train, manual, run),
pc AS (SELECT *, idx - row_number() OVER (PARTITION BY train, auto ORDER BY idx) AS run FROM s WHERE auto <> ''),
p AS (SELECT train, auto AS label, min(idx) AS start, max(idx) AS e FROM pc GROUP BY train, auto, run)"""


def spans(spark, d):
    rows = labelled(trains(spark, d))
    made = [stored(runs.segments(rows, F.col(c)).where("label <> ''").select("train", "label", "start", "end"), f"{c}-spans") for c in ("manual", "auto")]
    return made


@query(f"""{SPANS}, o AS (SELECT m.*, p.start AS t_id, greatest(0, least(m.e, p.e) - greatest(m.start, p.start) + 1) / (greatest(m.e, p.e) - least(m.start, p.start) + 1) AS iou,
 least(m.e, p.e) - greatest(m.start, p.start) + 1 AS overlap FROM m JOIN p ON m.train = p.train AND p.start <= m.e AND m.start <= p.e),
k AS (SELECT *, row_number() OVER (PARTITION BY train, start ORDER BY iou DESC, t_id) AS k FROM o)
SELECT m.train, m.start AS q_id, m.start, m.e AS "end", m.label, k.t_id, round(k.iou, 9) AS iou, k.overlap FROM m LEFT JOIN k ON m.train = k.train AND m.start = k.start AND k.k = 1""")
def best_overlap(spark, d):
    m, p = spans(spark, d)
    return rounded(joins.best_overlap(m.withColumn("q_id", F.col("start")), p.withColumn("t_id", F.col("start")).drop("label"), ["train"]))


@query(f"""{SPANS} SELECT m.train, m.label AS truth, p.label AS pred, count(*) AS n, sum(least(m.e, p.e) - greatest(m.start, p.start) + 1)::BIGINT AS overlap
FROM m JOIN p ON m.train = p.train AND p.start <= m.e AND m.start <= p.e GROUP BY ALL""")
def manual_event_overlap(spark, d):
    m, p = spans(spark, d)
    pairs = joins.range_join(m, p, ["train"])
    return pairs.groupBy("train", F.col("l_label").alias("truth"), F.col("r_label").alias("pred")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1).alias("overlap"))


@query(f"""{SPANS} SELECT train, label, start, e AS "end" FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.train = p.train AND p.start <= m.e AND m.start <= p.e)""")
def overlap_anti_join(spark, d):
    m, p = spans(spark, d)
    hit = joins.range_join(p, m, ["train"]).select("train", F.col("l_start").alias("start"), F.col("l_label").alias("label")).distinct()
    return p.join(hit, ["train", "start", "label"], "left_anti").select("train", "label", "start", "end")


@query(f"""{SPANS}, o AS (SELECT p.train, p.start, p.label, max((least(m.e, p.e) - greatest(m.start, p.start) + 1) / least(m.e - m.start + 1, p.e - p.start + 1)) AS share
 FROM p JOIN m ON m.train = p.train AND p.start <= m.e AND m.start <= p.e GROUP BY ALL)
SELECT label, count(*) FILTER (share >= 0.1) AS n, round(avg(share), 9) AS share FROM o GROUP BY label""")
def overlap_fraction(spark, d):
    m, p = spans(spark, d)
    x = joins.range_join(p, m, ["train"])
    size = lambda s: F.col(f"{s}_end") - F.col(f"{s}_start") + 1
    share = (F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1) / F.least(size("l"), size("r"))
    o = x.groupBy("train", "l_start", F.col("l_label").alias("label")).agg(F.max(share).alias("share"))
    return rounded(o.groupBy("label").agg(F.count_if(F.col("share") >= 0.1).alias("n"), F.avg("share").alias("share")))


@query(""", e AS (SELECT train, event_id AS trial, us AS event_us FROM s WHERE kind = 'error')
SELECT e.train, trial, idx, us - event_us AS lag_us FROM e JOIN s ON s.train = e.train AND us - event_us BETWEEN -50000000000 AND 100000000000""")
def event_window_join(spark, d):
    rows = trains(spark, d)
    pairs = joins.band_join(task_events(rows), rows.select("train", "idx", "us"), ["train"], "event_us", "us", 5 * SEC // 100, SEC // 10)
    return pairs.select("train", "trial", "idx", (F.col("us") - F.col("event_us")).alias("lag_us"))


@query(""", e AS (SELECT train, event_id AS trial, us AS event_us FROM s WHERE kind = 'error'), n AS (
SELECT s.train, idx, trial, us - event_us AS rel_us, row_number() OVER (PARTITION BY s.train, idx ORDER BY abs(us - event_us), trial) AS k
FROM e JOIN s ON s.train = e.train AND us - event_us BETWEEN -50000000000 AND 50000000000)
SELECT train, idx, trial, rel_us FROM n WHERE k = 1""")
def nearest_event_join(spark, d):
    from pyspark.sql.window import Window

    rows = trains(spark, d)
    pairs = joins.band_join(task_events(rows), rows.select("train", "idx", "us"), ["train"], "event_us", "us", SEC // 20, SEC // 20).withColumn("rel_us", F.col("us") - F.col("event_us"))
    k = F.row_number().over(Window.partitionBy("train", "idx").orderBy(F.abs("rel_us"), "trial"))
    return pairs.withColumn("k", k).where("k = 1").select("train", "idx", "trial", "rel_us")


@query(""", v AS (SELECT train, us, value FROM s WHERE kind = 'purchase'), q AS (SELECT train, idx, us FROM s WHERE kind <> 'purchase'),
j AS (SELECT q.*, (SELECT max(us) FROM v WHERE v.train = q.train AND v.us <= q.us) AS p, (SELECT min(us) FROM v WHERE v.train = q.train AND v.us >= q.us) AS n FROM q),
k AS (SELECT j.*, a.value AS prev, b.value AS next FROM j LEFT JOIN v a ON a.train = j.train AND a.us = j.p LEFT JOIN v b ON b.train = j.train AND b.us = j.n)
SELECT train, idx, prev, next, round(CASE WHEN p IS NULL THEN next WHEN n IS NULL OR n = p THEN prev ELSE prev + (us - p) / (n - p) * (next - prev) END, 6) AS interpolated,
 CASE WHEN p IS NULL OR n - us < us - p THEN next ELSE prev END AS nearest FROM k""")
def as_of_join(spark, d):
    rows = trains(spark, d)
    out = joins.as_of(rows.where("kind <> 'purchase'").select("train", "idx", "us"), rows.where("kind = 'purchase'").select("train", "us", "value"), "train", "us", "value")
    nearest = F.when(F.col("prev_at").isNull() | (F.col("next_at") - F.col("us") < F.col("us") - F.col("prev_at")), F.col("next")).otherwise(F.col("prev"))
    return out.select("train", "idx", "prev", "next", F.round("interpolated", 6).alias("interpolated"), nearest.alias("nearest"))


@query(""", g AS (SELECT train, us - lag(us) OVER (PARTITION BY train ORDER BY idx) AS len, us FROM s), i AS (SELECT train, us - len AS a, us AS b FROM g WHERE len > 0),
x AS (SELECT *, unnest(range(a // 100000000000, (b - 1) // 100000000000 + 1)) AS bin FROM i)
SELECT train, bin, count(*) AS n, sum(least(b, (bin + 1) * 100000000000) - greatest(a, bin * 100000000000))::BIGINT AS overlap_us FROM x GROUP BY ALL""")
def interval_bin_overlap(spark, d):
    from pulsegrid.operators.isi import in_train

    rows = trains(spark, d)
    i = rows.select("train", F.lag("us").over(in_train()).alias("a"), F.col("us").alias("b")).where("b > a")
    return joins.bin_overlap(i, "a", "b", SEC // 10).groupBy("train", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap").alias("overlap_us"))


@query(""", x AS (SELECT train, us, min(us) OVER w AS a, max(us) OVER w AS b FROM s WINDOW w AS (PARTITION BY train))
SELECT train, least((us - a) // 200000000000, (b - a - 1) // 200000000000) + 1 AS bin, count(*) AS n FROM x GROUP BY ALL""")
def bin_lookup(spark, d):
    from pulsegrid.operators.isi import by_train

    rows = trains(spark, d).withColumns({"a": F.min("us").over(by_train()), "b": F.max("us").over(by_train())})
    w = SEC // 5
    at = F.least(F.floor((F.col("us") - F.col("a")) / w), F.floor((F.col("b") - F.col("a") - 1) / w)) + 1
    return rows.groupBy("train", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(""", c AS (SELECT train, us // 50000000000 AS bin, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT train AS a, lead(train) OVER (ORDER BY train) AS b FROM (SELECT DISTINCT train FROM s))
SELECT a, b, count(*) AS bins, sum(x.n * y.n)::BIGINT AS product FROM t JOIN c x ON x.train = a JOIN c y ON y.train = b AND x.bin = y.bin - 1 GROUP BY ALL""")
def lag_join(spark, d):
    rows = trains(spark, d)
    counts = rows.groupBy("train", F.floor(F.col("us") / (SEC // 20)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return joins.lag_join(counts, neighbours(rows), 1).groupBy("a", "b").agg(F.count(F.lit(1)).alias("bins"), F.sum(F.col("n_a") * F.col("n_b")).alias("product"))


def neighbours(rows):
    """Each train with the next one: as many pairs as trains."""
    from pulsegrid.sources.shared import ranked, stored

    names = stored(ranked(rows.select(F.col("train").alias("a")).distinct(), F.col("a"), name="k"), "numbered-trains")
    return names.join(names.select(F.col("a").alias("b"), (F.col("k") - 1).alias("k")), "k").select("a", "b")


@query(""", e AS (SELECT train, event_id AS trial, us AS event_us FROM s WHERE kind = 'error'),
w AS (SELECT e.train, trial, s.idx, s.us FROM e JOIN s ON s.train = e.train AND us - event_us BETWEEN -100000000000 AND 100000000000)
SELECT floor((b.us - a.us) / 10000000000)::BIGINT AS lag_bin, count(*) AS n FROM w a JOIN w b ON a.train = b.train AND a.trial = b.trial AND a.idx <> b.idx AND b.us - a.us BETWEEN -50000000000 AND 50000000000 GROUP BY ALL""")
def event_correlogram(spark, d):
    rows = trains(spark, d)
    w = joins.band_join(task_events(rows), rows.select("train", "idx", "us"), ["train"], "event_us", "us", SEC // 10, SEC // 10).select("train", "trial", "idx", "us")
    other = w.select("train", "trial", F.col("idx").alias("idx2"), F.col("us").alias("us2"))
    pairs = joins.band_join(w, other, ["train", "trial"], "us", "us2", SEC // 20, SEC // 20).where("idx <> idx2")
    return pairs.groupBy(F.floor((F.col("us2") - F.col("us")) / (SEC // 100)).alias("lag_bin")).agg(F.count(F.lit(1)).alias("n"))
