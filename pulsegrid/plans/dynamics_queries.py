"""Queries over sequences of states and binned activity."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.operators import dynamics as dy
from pulsegrid.operators import joins, runs
from pulsegrid.operators.isi import in_train
from pulsegrid.sources.events import labelled, task_events, trains

from .join_queries import SEC
from .registry import query, r, rounded

STATES = ", st AS (SELECT train, idx, CASE WHEN auto = '' THEN 'none' ELSE auto END AS state, isi FROM s)"


def states(spark, d):
    return dy.states(labelled(trains(spark, d)), F.col("auto"))


TRANSITIONS = f"""{STATES}, n AS (SELECT *, lead(state) OVER (PARTITION BY train ORDER BY idx) AS target FROM st),
c AS (SELECT train, state AS source, target, count(*) AS n FROM n WHERE target IS NOT NULL GROUP BY ALL),
t AS (SELECT *, n / sum(n) OVER (PARTITION BY train, source) AS r, n / sum(n) OVER (PARTITION BY train) AS j FROM c)"""


@query(f'{TRANSITIONS} SELECT train, source, target, n, round(r, 9) AS "row", round(j, 9) AS joint FROM t')
def transition_counts(spark, d):
    return rounded(dy.transitions(states(spark, d)))


@query(f"""{TRANSITIONS}, h AS (SELECT train, source, sum(-r * log2(r)) AS h, sum(n) AS n FROM t GROUP BY ALL)
SELECT train, round(sum(h * n) / sum(n), 9) AS entropy_rate, count(*) AS states FROM h GROUP BY train""")
def entropy_rate(spark, d):
    return rounded(dy.entropy_rate(dy.transitions(states(spark, d))))


@query(f"""{STATES}, c AS (SELECT * FROM (SELECT *, lag(state) OVER (PARTITION BY train ORDER BY idx) AS b FROM st) WHERE b IS NULL OR b <> state),
m AS (SELECT train, state || '>' || lead(state, 1) OVER w || '>' || lead(state, 2) OVER w AS motif FROM c WINDOW w AS (PARTITION BY train ORDER BY idx))
SELECT train, motif, count(*) AS n FROM m WHERE motif IS NOT NULL GROUP BY ALL""")
def motif_counts(spark, d):
    return dy.motifs(states(spark, d))


SEGMENTS = f"""{STATES}, g AS (SELECT *, sum(CASE WHEN b = state THEN 0 ELSE 1 END) OVER (PARTITION BY train ORDER BY idx) AS run FROM (SELECT *, lag(state) OVER (PARTITION BY train ORDER BY idx) AS b FROM st)),
sg AS (SELECT train, state AS label, count(*) AS n, coalesce(sum(isi), 0) AS dwell FROM g GROUP BY train, run, state)"""


@query(f"""{SEGMENTS}, l AS (SELECT train, label, sum(dwell) AS time FROM sg GROUP BY ALL), p AS (SELECT *, time / sum(time) OVER (PARTITION BY train) AS p FROM l),
e AS (SELECT train, count(*) AS states, max(p) AS largest, sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) AS entropy, max_by(label, (p, label)) AS dominant FROM p GROUP BY train)
SELECT e.train, states, round(largest, 9) AS largest, round(entropy, 9) AS entropy, dominant, round(avg(dwell), 9) AS dwell_mean, round(stddev_samp(dwell) / avg(dwell), 9) AS dwell_cv, count(*) AS segments
FROM e JOIN sg USING (train) GROUP BY ALL""")
def sequence_metrics(spark, d):
    seg = runs.segments(states(spark, d), F.col("state"), F.coalesce(F.sum("isi"), F.lit(0.0)).alias("dwell"))
    return rounded(dy.sequence_metrics(seg))


BINS = """, c AS (SELECT train, us // 50000000000 AS bin, count(*) AS n FROM s GROUP BY ALL), e AS (SELECT train, unnest(range(min(bin), max(bin) + 1)) AS bin FROM c GROUP BY train),
b AS (SELECT train, bin, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (train, bin))"""


@query(f"{BINS} SELECT * FROM b")
def tumbling_bins(spark, d):
    return dy.binned(trains(spark, d), SEC // 20)


@query(f"""{BINS}, m AS (SELECT train, count(*) AS bins, avg(n) AS mean, var_samp(n) AS variance, max(n) AS most, avg((n = 0)::INT) AS p0, avg((n = 1)::INT) AS p1, avg((n >= 2)::INT) AS p2, avg((n >= 3)::INT) AS p3 FROM b GROUP BY train),
k AS (SELECT m.*, unnest(range(0, most + 1)) AS n FROM m), g AS (SELECT k.train, sum(abs(coalesce(c, 0) / bins - exp(k.n * ln(mean) - mean - lgamma(k.n + 1)))) AS l1
 FROM k LEFT JOIN (SELECT train, n, count(*) AS c FROM b GROUP BY ALL) USING (train, n) GROUP BY k.train)
SELECT m.train, bins, round(mean, 9) AS mean, round(variance, 9) AS variance, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3, round(l1, 6) AS poisson_l1, round(variance / mean, 9) AS fano FROM m JOIN g USING (train)""")
def spike_count_distribution(spark, d):
    x = dy.count_distribution(dy.binned(trains(spark, d), SEC // 20))
    return rounded(x.withColumn("poisson_l1", r("poisson_l1", 6)))


EVENTS = ", ev AS (SELECT train, event_id AS trial, us AS event_us FROM s WHERE kind = 'error')"


@query(f"""{EVENTS}, n AS (SELECT trial, floor((us - event_us) / 20000000000)::BIGINT AS bin, count(*) AS n FROM ev JOIN s ON s.train = ev.train AND us - event_us BETWEEN -100000000000 AND 199999999999 GROUP BY ALL),
g AS (SELECT DISTINCT trial, bin FROM ev, (SELECT unnest(range(-5, 10)) AS bin)), p AS (SELECT g.bin, coalesce(n, 0) / 0.02 AS rate FROM g LEFT JOIN n USING (trial, bin)),
m AS (SELECT bin, avg(rate) AS mean, stddev_samp(rate) / sqrt(count(*)) AS sem FROM p GROUP BY bin), z AS (SELECT avg(mean) AS bm, stddev_samp(mean) AS bs FROM m WHERE bin < 0)
SELECT bin, round(mean, 6) AS mean, round(sem, 6) AS sem, round((mean - bm) / bs, 5) AS z FROM m, z""")
def peristimulus_rates(spark, d):
    rows = trains(spark, d)
    ev = task_events(rows)
    near = joins.band_join(ev, rows.select("train", "us"), ["train"], "event_us", "us", SEC // 10, SEC // 5 - 1).withColumn("lag_us", F.col("us") - F.col("event_us"))
    x = dy.psth(near, ev, SEC // 10, SEC // 5, SEC // 50)
    return x.select("bin", r("mean", 6).alias("mean"), r("sem", 6).alias("sem"), r("z", 5).alias("z"))


@query(f"""{STATES}, g AS (SELECT s.train, us - lag(us) OVER (PARTITION BY s.train ORDER BY s.idx) AS len, us, state FROM s JOIN st USING (train, idx)), i AS (SELECT train, us - len AS a, us AS e, state FROM g WHERE len > 0),
x AS (SELECT *, unnest(range(a // 200000000000, (e - 1) // 200000000000 + 1)) AS bin FROM i), o AS (SELECT train, bin, state AS label, sum(least(e, (bin + 1) * 200000000000) - greatest(a, bin * 200000000000))::BIGINT AS overlap FROM x GROUP BY ALL),
r AS (SELECT *, overlap / sum(overlap) OVER (PARTITION BY train, bin) AS share, list_position(['burst', 'possible_burst', 'tonic', 'pause', 'none'], label) AS k FROM o)
SELECT train, bin, label, overlap, round(share, 9) AS share, first_value(label) OVER (PARTITION BY train, bin ORDER BY overlap DESC, k) AS dominant FROM r""")
def fractional_occupancy(spark, d):
    rows = trains(spark, d)
    st = states(spark, d).select("train", "idx", F.col("state").alias("label"))
    i = rows.withColumn("a", F.lag("us").over(in_train())).where("us > a").join(st, ["train", "idx"]).select("train", "label", "a", F.col("us").alias("b"))
    x = joins.bin_overlap(i, "a", "b", SEC // 5)
    return rounded(dy.occupancy(x, ["burst", "possible_burst", "tonic", "pause", "none"]))


@query(f"""{BINS} SELECT a.train, a.bin, a.n, round(sum(x.n * exp(-(((x.bin - a.bin) / 1.5) ** 2) / 2)) / sum(exp(-(((x.bin - a.bin) / 1.5) ** 2) / 2)), 9) AS smooth
FROM b a JOIN b x ON a.train = x.train AND x.bin BETWEEN a.bin - 5 AND a.bin + 5 GROUP BY ALL""")
def gaussian_smoothing(spark, d):
    return rounded(dy.smoothed(dy.binned(trains(spark, d), SEC // 20), "n", 1.5))


@query(f"""{STATES} SELECT train, idx, state FROM (SELECT *, lag(state) OVER (PARTITION BY train ORDER BY idx) AS b FROM st) WHERE state IN ('burst', 'pause') AND (b IS NULL OR b <> state)""")
def state_onsets(spark, d):
    return dy.onsets(states(spark, d), ["burst", "pause"]).select("train", "idx", "state")


@query(""", c AS (SELECT train, us // 200000000000 AS bin, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT train AS a, lead(train) OVER (ORDER BY train) AS b FROM (SELECT DISTINCT train FROM s))
SELECT a, b, count(*) AS bins, round(corr(x.n, y.n), 6) AS r FROM t JOIN c x ON x.train = a JOIN c y ON y.train = b AND x.bin = y.bin GROUP BY ALL HAVING count(*) >= 5 AND stddev_pop(x.n) > 0 AND stddev_pop(y.n) > 0""")
def pair_correlation(spark, d):
    from .join_queries import neighbours

    rows = trains(spark, d)
    c = rows.groupBy("train", F.floor(F.col("us") / (SEC // 5)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    x = dy.pair_correlation(c, neighbours(rows)).where("bins >= 5 and r is not null and not isnan(r)")
    return rounded(x, 6)


@query(""", n AS (SELECT train, count(*) AS k FROM s GROUP BY train), c AS (SELECT train FROM n ORDER BY k DESC, train LIMIT 20), b AS (SELECT train, us // 200000000000 AS bin, count(*) AS n FROM s JOIN c USING (train) GROUP BY ALL)
SELECT x.train AS a, y.train AS b, lag, count(*) AS bins, round(corr(x.n, y.n), 6) AS r FROM (SELECT unnest(range(-2, 3)) AS lag) JOIN b x ON true JOIN b y ON x.train < y.train AND y.bin = x.bin + lag GROUP BY ALL HAVING count(*) >= 5 AND stddev_pop(x.n) > 0 AND stddev_pop(y.n) > 0""")
def chosen_pair_correlation(spark, d):
    """All pairs of the twenty trains with the most spikes, at lags of up to two bins either way."""
    from pulsegrid.operators.joins import lag_join

    rows = trains(spark, d)
    chosen = rows.groupBy("train").count().orderBy(F.desc("count"), "train").limit(20).select("train")
    counts = rows.join(chosen, "train", "left_semi").groupBy("train", F.floor(F.col("us") / (SEC // 5)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    pairs = chosen.select(F.col("train").alias("a")).join(chosen.select(F.col("train").alias("b")), F.col("a") < F.col("b"))  # 190 of them
    x = None
    for lag in range(-2, 3):
        part = lag_join(counts, pairs, lag).groupBy("a", "b").agg(F.count(F.lit(1)).alias("bins"), F.corr("n_a", "n_b").alias("r")).withColumn("lag", F.lit(lag).cast("long"))
        x = part if x is None else x.unionByName(part)
    return rounded(x.where("bins >= 5 and r is not null and not isnan(r)"), 6)


@query("SELECT train, idx, round(sum(isi) OVER (PARTITION BY train ORDER BY idx), 9) AS elapsed, count(valid OR NULL) OVER (PARTITION BY train ORDER BY idx) AS n_valid FROM s")
def cumulative_sums(spark, d):
    w = in_train().rowsBetween(Window.unboundedPreceding, 0)
    return rounded(trains(spark, d).select("train", "idx", F.sum("isi").over(w).alias("elapsed"), F.count_if("valid").over(w).alias("n_valid")))


@query(""", p AS (SELECT train, idx, t, ln(1 + value) AS x, value / 100 AS y FROM s), q AS (SELECT train, idx, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM p WINDOW w AS (PARTITION BY train ORDER BY idx)),
v AS (SELECT *, sqrt(dx * dx + dy * dy) AS speed FROM q), o AS (SELECT *, lag(speed) OVER w AS s0, dx * lag(dx) OVER w + dy * lag(dy) OVER w AS dot FROM v WINDOW w AS (PARTITION BY train ORDER BY idx))
SELECT train, idx, round(speed, 9) AS speed, CASE WHEN speed * s0 > 0 THEN round(acos(greatest(-1, least(1, dot / (speed * s0)))), 5) END AS turn FROM o""")
def path_speed(spark, d):
    p = trains(spark, d).select("train", "idx", F.log1p("value").alias("x"), (F.col("value") / 100).alias("y"))
    return dy.latent_speed(p, ["x", "y"]).select("train", "idx", r("speed").alias("speed"), r("turn", 5).alias("turn"))


@query(f"""{SEGMENTS}, k AS (SELECT train, label, run, min(idx) AS a, max(idx) AS e FROM (SELECT *, state AS label FROM g) GROUP BY ALL),
x AS (SELECT k.*, sa.us AS a_us, se.us AS e_us FROM k JOIN s sa ON sa.train = k.train AND sa.idx = k.a JOIN s se ON se.train = k.train AND se.idx = k.e)
SELECT train, label, a AS start, round((lead(a_us) OVER (PARTITION BY train, label ORDER BY a) - e_us) / 1e12, 9) AS gap FROM x""")
def inter_event_gaps(spark, d):
    rows = labelled(trains(spark, d)).withColumn("state", F.when(F.col("auto") == "", "none").otherwise(F.col("auto")))
    seg = runs.segments(rows, F.col("state"), F.min("us").alias("a_us"), F.max("us").alias("e_us"))
    gap = (F.lead("a_us").over(Window.partitionBy("train", "label").orderBy("start")) - F.col("e_us")) / F.lit(1e12)
    return rounded(seg.select("train", "label", "start", gap.alias("gap")))
