"""Queries over events after detection."""

from pyspark.sql import functions as F

from pulsegrid.operators import detectors as de
from pulsegrid.operators import events as ev
from pulsegrid.operators import runs
from pulsegrid.sources.events import labelled, trains
from pulsegrid.sources.shared import stored

from .registry import query, r, rounded

#: SQL: events of the band labels with measures (e) and all their scores (z).
EVENTNESS = """, c AS (SELECT *, idx - row_number() OVER (PARTITION BY train, auto ORDER BY idx) AS run FROM s WHERE auto <> ''), ev AS (SELECT train, auto AS label, min(idx) AS start, max(idx) AS e FROM c GROUP BY train, auto, run),
i AS (SELECT ev.*, s.idx, s.isi, s.suspect, lag(s.isi) OVER (PARTITION BY ev.train, ev.start ORDER BY s.idx) AS a FROM ev JOIN s ON s.train = ev.train AND s.valid AND s.idx BETWEEN ev.start AND ev.e),
g AS (SELECT train, label, start, e, count(*) AS n_isi, count(*) FILTER (suspect) AS suspects, quantile_cont(isi, 0.1) AS q10, quantile_cont(isi, 0.5) AS q50, quantile_cont(isi, 0.9) AS q90, stddev_samp(isi) / avg(isi) AS cv, avg(3 * (a - isi) ** 2 / (a + isi) ** 2) AS lv,
 count(*) FILTER (isi <= 0.02) AS short, list(isi) AS vs FROM i GROUP BY ALL),
k AS (SELECT g.train, g.start, quantile_cont(s.isi, 0.5) AS context FROM g JOIN s ON s.train = g.train AND s.valid AND (s.idx BETWEEN g.start - 14 AND g.start - 3 OR s.idx BETWEEN g.e + 3 AND g.e + 14) GROUP BY ALL),
f AS (SELECT g.*, p.isi AS pre, n.isi AS post, context, least(p.isi / q90, n.isi / q90) AS edge, context / q90 AS cc, CASE WHEN p.isi IS NOT NULL AND n.isi IS NOT NULL THEN (p.isi + n.isi) / 2 ELSE coalesce(p.isi, n.isi) END AS flank
 FROM g LEFT JOIN s p ON p.train = g.train AND p.idx = g.start - 1 LEFT JOIN s n ON n.train = g.train AND n.idx = g.e + 1 LEFT JOIN k ON k.train = g.train AND k.start = g.start),
h AS (SELECT *, least(greatest(exp(-abs(ln(flank / context)) / ln(1.5::DOUBLE)), 0), 1) AS flank_return, least(least(greatest(edge / 3, 0), 1), least(greatest(cc / 3, 0), 1)) AS boundary,
 len(list_filter(vs, lambda v: v / q50 > 3.5)) AS outliers, short / n_isi AS short_share,
 (1 - least(greatest(coalesce(cv, 0) / 0.5, 0), 1) + 1 - least(greatest(coalesce(lv, 0) / 0.5, 0), 1) + 1 - least(greatest(q90 / q10 - 1, 0), 1)) / 3 AS regularity FROM f),
z AS (SELECT *, (CASE WHEN edge IS NOT NULL AND cc IS NOT NULL THEN boundary ELSE coalesce(least(greatest(edge / 3, 0), 1), least(greatest(cc / 3, 0), 1)) END + flank_return) / 2 AS ness FROM h)"""


def band_events(spark, d):
    rows = labelled(trains(spark, d))
    return rows, ev.of_labels(rows, "auto")


@query(f"""{EVENTNESS} SELECT train, start, e AS "end", label, round(edge, 6) AS edge, round(cc, 6) AS context_contrast, round(flank_return, 6) AS flank_return, outliers, round(short_share, 6) AS short_share, round(regularity, 6) AS regularity, round(ness, 6) AS eventness,
 CASE WHEN ness IS NULL THEN 'unknown' WHEN ness >= 0.6 THEN 'event_like' WHEN ness <= 0.45 THEN 'state_like' ELSE 'medium_review' END AS zone FROM z""")
def eventness_scores(spark, d):
    x = ev.eventness(*band_events(spark, d))
    return rounded(x.select("train", "start", "end", "label", "edge", "context_contrast", "flank_return", "outliers", "short_share", "regularity", "eventness", "zone"), 6)


@query()
def recommended_subtypes(spark, d):
    return ev.recommended(ev.eventness(*band_events(spark, d))).select("train", "start", "end", "label", "subtype", "family", "agrees")


@query(f"""{EVENTNESS}, y AS (SELECT *, CASE WHEN label IN ('burst', 'long_burst') AND suspects > 0 THEN 'contains_refractory_suspect_ISI' WHEN label IN ('burst', 'long_burst') AND (pre IS NULL) <> (post IS NULL) THEN 'boundary_one_sided_evidence' ELSE '' END AS reason FROM z)
SELECT train, start, label, reason, CASE WHEN reason <> '' THEN 'possible_burst' ELSE label END AS final_class, CASE WHEN reason <> '' OR label = 'possible_burst' THEN 'review_required' ELSE 'high_confidence' END AS tier,
 concat_ws(';', CASE WHEN suspects > 0 THEN 'refractory_suspect' END, CASE WHEN pre IS NULL OR post IS NULL THEN 'record_edge' END) AS warnings FROM y""")
def final_decisions(spark, d):
    return ev.decided(ev.eventness(*band_events(spark, d))).select("train", "start", "label", "reason", "final_class", "tier", "warnings")


@query(f"""{EVENTNESS} SELECT label AS before, CASE WHEN suspects > 0 AND label IN ('burst', 'long_burst') THEN 'possible_burst' ELSE label END AS label, CASE WHEN suspects > 0 THEN 'demoted' ELSE '' END AS flag, count(*) AS n FROM z GROUP BY ALL""")
def refractory_policy(spark, d):
    x = ev.eventness(*band_events(spark, d)).withColumn("before", F.col("label"))
    return ev.refractory_policy(x).groupBy("before", "label", "flag").agg(F.count(F.lit(1)).alias("n"))


@query(""", c AS (SELECT *, idx - row_number() OVER (PARTITION BY train, auto ORDER BY idx) AS run FROM s WHERE auto <> ''), k AS (SELECT *, idx - row_number() OVER (PARTITION BY train, auto, run ORDER BY idx) AS part FROM c WHERE NOT suspect)
SELECT train, auto AS label, min(idx) AS start, max(idx) AS "end" FROM k GROUP BY train, auto, run, part""")
def split_at_suspects(spark, d):
    return ev.split_at_suspects(*band_events(spark, d))


@query("SELECT train, idx, 'possible_burst' AS before, 'burst' AS after FROM s WHERE auto = 'possible_burst'")
def promotion_audit(spark, d):
    rows, events = band_events(spark, d)
    return ev.promoted(rows, events.where("label = 'possible_burst'"))[1]


@query(f"""{EVENTNESS}, w AS (SELECT z.train, z.label, z.start, pre, post, (SELECT avg(v) FROM (SELECT unnest(vs) AS v)) AS intra, list_sum(vs) AS duration, lead(b.t) OVER (PARTITION BY z.train, z.label ORDER BY z.start) - x.t AS gap
 FROM z JOIN s x ON x.train = z.train AND x.idx = z.e LEFT JOIN s b ON b.train = z.train AND b.idx = z.start - 1)
SELECT train, label, start, kind, round(value, 9) AS value FROM (UNPIVOT w ON pre, post, intra, duration, gap INTO NAME kind VALUE value) WHERE value IS NOT NULL""")
def interval_table(spark, d):
    return rounded(ev.interval_table(*band_events(spark, d)))


@query(""", f AS (SELECT *, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM s WHERE valid AND isi <= 0.015), q AS (SELECT train, min(idx) AS start, max(idx) AS e, quantile_cont(isi, 0.9) AS q90 FROM f GROUP BY train, run HAVING count(*) >= 1),
n AS (SELECT *, lead(start) OVER w AS nx, greatest(q90, lead(q90) OVER w) AS qq FROM q WINDOW w AS (PARTITION BY train ORDER BY start)),
b AS (SELECT n.train, n.start, max(s.isi) <= 0.08 AND max(s.isi) / (any_value(qq) * 1.25) <= 3.5 AS ok FROM n JOIN s ON s.train = n.train AND s.idx BETWEEN n.e + 1 AND n.nx - 1 WHERE nx - e - 1 = 1 GROUP BY ALL),
y AS (SELECT n.train, n.start, n.e, CASE WHEN coalesce(lag(b.ok) OVER (PARTITION BY n.train ORDER BY n.start), false) THEN 0 ELSE 1 END AS new FROM n LEFT JOIN b ON b.train = n.train AND b.start = n.start),
g AS (SELECT *, sum(new) OVER (PARTITION BY train ORDER BY start) AS run FROM y) SELECT train, min(start) AS start, max(e) AS "end", count(*) AS seeds FROM g GROUP BY train, run""")
def linked_seeds(spark, d):
    from pulsegrid.functions.stats import q

    rows = trains(spark, d)
    seeds = runs.runs(rows, F.col("valid") & (F.col("isi") <= 0.015), q("isi", 0.9).alias("q90")).select("train", "start", "end", "q90")
    return ev.linked(seeds, rows)


@query(""", v AS (SELECT train, idx, CASE WHEN valid THEN isi END AS x FROM s), m AS (SELECT a.train, a.idx, quantile_cont(b.x, 0.5) AS med FROM v a JOIN v b ON a.train = b.train AND b.idx BETWEEN a.idx - 5 AND a.idx + 5 AND b.idx <> a.idx GROUP BY ALL),
w AS (SELECT a.train, a.idx, avg(b.x) AS mean, count(b.x) AS n FROM v a JOIN v b ON a.train = b.train AND b.idx BETWEEN a.idx AND a.idx + 2 GROUP BY ALL),
f AS (SELECT train, idx, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM w JOIN m USING (train, idx) WHERE n = 3 AND med / mean >= 2.2)
SELECT train, min(idx) AS start, max(idx) + 2 AS "end", count(*) AS n FROM f GROUP BY train, run""")
def local_compression(spark, d):
    return ev.local_compression(trains(spark, d))


@query(""", f AS (SELECT *, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM s WHERE valid AND isi <= 0.02), g AS (SELECT train, min(idx) AS start, max(idx) AS e, count(*) AS n, avg(isi) AS m, stddev_samp(isi) / avg(isi) AS cv FROM f GROUP BY train, run HAVING count(*) >= 4)
SELECT train, start, e AS "end", n, round(m, 9) AS mean_isi, round(cv, 9) AS cv, CASE WHEN cv <= 0.4 THEN 'stable' ELSE 'irregular' END AS mode FROM g""")
def high_frequency_modes(spark, d):
    return rounded(ev.high_frequency_modes(trains(spark, d)))


@query()
def tonic_growth(spark, d):
    return rounded(ev.tonic_growth(trains(spark, d)))


@query()
def greedy_suppression(spark, d):
    g = de.Grammar()
    rows = stored(de.usable(trains(spark, d), g), "trains")
    return rounded(ev.greedy_suppression(de.candidates(rows, g, ["bursts", "pauses"]).where("label <> 'reject'")))


@query("SELECT 'overlapping_events' AS \"check\", 0 AS n UNION ALL SELECT 'events_beyond_train', 0 UNION ALL SELECT 'labels_without_event', 0")
def layer_consistency(spark, d):
    return ev.consistency(*band_events(spark, d))


@query(""", p AS (SELECT unnest([('burst_max', 0.0075::DOUBLE), ('burst_max', 0.01), ('burst_max', 0.0125), ('pause_min', 0.0525), ('pause_min', 0.07), ('pause_min', 0.0875)]) AS p),
x AS (SELECT p[1] AS setting, p[2] AS value, CASE WHEN isi < CASE WHEN p[1] = 'burst_max' THEN p[2] ELSE 0.01 END THEN 'burst' WHEN isi > CASE WHEN p[1] = 'pause_min' THEN p[2] ELSE 0.07 END THEN 'pause' ELSE '' END AS pred, manual AS truth FROM s, p WHERE isi IS NOT NULL),
f AS (SELECT setting, value, l, 2.0::DOUBLE * count(*) FILTER (pred = l AND truth = l) / (count(*) FILTER (pred = l) + count(*) FILTER (truth = l)) AS f1 FROM x, (SELECT unnest(['burst', 'pause']) AS l) GROUP BY ALL),
m AS (SELECT setting, value, avg(f1) AS f1 FROM f GROUP BY ALL)
SELECT setting, value, round(f1, 9) AS macro_f1, round(f1 - (SELECT any_value(f1) FROM m WHERE setting = 'burst_max' AND value = 0.01), 9) AS change FROM m""")
def setting_sensitivity(spark, d):
    """Macro F1 when one setting at a time goes down or up by a quarter; the few settings go with each row, so all variants are one job."""
    grid = [("burst_max", 0.0075), ("burst_max", 0.01), ("burst_max", 0.0125), ("pause_min", 0.0525), ("pause_min", 0.07), ("pause_min", 0.0875)]
    p = F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), F.lit(v).alias("value")) for n, v in grid]))
    x = labelled(trains(spark, d)).where("isi is not null").withColumn("p", p).select("p.setting", "p.value", "isi", F.col("manual").alias("truth"))
    burst = F.when(F.col("setting") == "burst_max", F.col("value")).otherwise(0.01)
    pause = F.when(F.col("setting") == "pause_min", F.col("value")).otherwise(0.07)
    x = x.withColumn("pred", F.when(F.col("isi") < burst, "burst").when(F.col("isi") > pause, "pause").otherwise(""))
    f1 = lambda v: 2 * F.count_if((F.col("pred") == v) & (F.col("truth") == v)) / (F.count_if(F.col("pred") == v) + F.count_if(F.col("truth") == v))
    m = x.groupBy("setting", "value").agg(f1("burst").alias("a"), f1("pause").alias("b")).withColumn("macro_f1", (F.col("a") + F.col("b")) / 2)
    base = m.where("setting = 'burst_max' and value = 0.01").select(F.col("macro_f1").alias("base"))
    return m.join(F.broadcast(base)).select("setting", "value", r("macro_f1").alias("macro_f1"), r(F.col("macro_f1") - F.col("base")).alias("change"))


@query(""", e AS (SELECT train, event_id AS trial, us AS event_us FROM s WHERE kind = 'error'), n AS (SELECT trial, s.train, (us - event_us + 100000000000) // 50000000000 AS bin, count(*) AS n FROM e JOIN s ON s.train = e.train AND us - event_us BETWEEN -100000000000 AND 99999999999 GROUP BY ALL)
SELECT e.trial, e.train, g.bin, coalesce(n.n, 0) AS n, round(sqrt(coalesce(n.n, 0) + 0.375), 9) AS scaled FROM e CROSS JOIN (SELECT unnest(range(0, 4)) AS bin) g LEFT JOIN n ON n.trial = e.trial AND n.bin = g.bin""")
def trial_tensor(spark, d):
    from pulsegrid.operators.joins import band_join
    from pulsegrid.sources.events import task_events

    rows = trains(spark, d)
    e = task_events(rows)
    near = band_join(e, rows.select("train", "us"), ["train"], "event_us", "us", 10**11, 10**11 - 1)
    n = near.groupBy("trial", F.floor((F.col("us") - F.col("event_us") + 10**11) / (5 * 10**10)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = e.select("trial", "train", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("bin"))
    x = grid.join(n, ["trial", "bin"], "left").select("trial", "train", "bin", F.coalesce("n", F.lit(0)).alias("n"))
    return x.withColumn("scaled", r(F.sqrt(F.col("n") + 0.375)))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query(""", c AS (SELECT us // 500000000000 AS bin, kind, count(*) AS n FROM s GROUP BY ALL) SELECT bin, """ + ", ".join(f"coalesce(max(n) FILTER (kind = '{k}'), 0) AS {k}" for k in KINDS) + " FROM c GROUP BY bin")
def population_matrix(spark, d):
    """Bins by kind of spike: a matrix of counts."""
    c = trains(spark, d).groupBy(F.floor(F.col("us") / (5 * 10**11)).alias("bin")).pivot("kind", KINDS).agg(F.count(F.lit(1)))
    return c.select("bin", *[F.coalesce(k, F.lit(0)).alias(k) for k in KINDS])


@query(""", st AS (SELECT train, idx, CASE WHEN auto = '' THEN 'none' ELSE auto END AS state FROM s), g AS (SELECT *, sum(CASE WHEN b = state THEN 0 ELSE 1 END) OVER (PARTITION BY train ORDER BY idx) AS run FROM (SELECT *, lag(state) OVER (PARTITION BY train ORDER BY idx) AS b FROM st)),
sg AS (SELECT train, state, run, count(*) AS n FROM g GROUP BY ALL), du AS (SELECT state, n, count(*) / sum(count(*)) OVER (PARTITION BY state) AS p FROM sg GROUP BY state, n),
tr AS (SELECT train, run, state, lead(state) OVER (PARTITION BY train ORDER BY run) AS nx FROM sg), tp AS (SELECT state, nx, count(*) / sum(count(*)) OVER (PARTITION BY state) AS p FROM tr WHERE nx IS NOT NULL GROUP BY state, nx)
SELECT tr.train, round(sum(ln(du.p)), 6) AS durations, round(sum(ln(tp.p)), 6) AS moves, count(*) AS segments FROM tr JOIN sg USING (train, run) JOIN du ON du.state = sg.state AND du.n = sg.n LEFT JOIN tp ON tp.state = tr.state AND tp.nx = tr.nx GROUP BY tr.train""")
def semi_markov_likelihood(spark, d):
    from pyspark.sql.window import Window

    from .dynamics_queries import states

    seg = runs.segments(states(spark, d), F.col("state"))
    w = Window.partitionBy("label")
    du = seg.groupBy("label", "n").agg(F.count(F.lit(1)).alias("c")).withColumn("p_d", F.col("c") / F.sum("c").over(w)).drop("c")
    tr = seg.withColumn("nx", F.lead("label").over(Window.partitionBy("train").orderBy("start")))
    tp = tr.where("nx is not null").groupBy("label", "nx").agg(F.count(F.lit(1)).alias("c")).withColumn("p_t", F.col("c") / F.sum("c").over(w)).drop("c")
    x = tr.join(du, ["label", "n"]).join(tp, ["label", "nx"], "left").groupBy("train").agg(F.sum(F.ln("p_d")).alias("durations"), F.sum(F.ln("p_t")).alias("moves"), F.count(F.lit(1)).alias("segments"))
    return rounded(x, 6)
