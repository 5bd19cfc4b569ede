"""Queries over gates on events, bands of single trains, and agreement of raters."""

from pyspark.sql import functions as F

from pulsegrid.operators import gates as ga
from pulsegrid.operators import ranges as ra
from pulsegrid.operators import runs
from pulsegrid.operators import validation as va
from pulsegrid.sources.events import labelled, trains
from pulsegrid.sources.shared import stored

from .registry import query, r, rounded

#: Runs of automatic labels, and a label by hand that denies a burst on short intervals of errors.
EVENTS = """, c AS (SELECT *, idx - row_number() OVER (PARTITION BY train, auto ORDER BY idx) AS run FROM s WHERE auto <> ''),
ev AS (SELECT train, auto AS label, min(idx) AS start, max(idx) AS e FROM c GROUP BY train, auto, run)"""
NEGATIVE = "(kind = 'error' AND isi < 0.006)"
LIMITS = {"burst": (0.002, 0.0075), "tonic": (0.021, 0.045), "pause": (0.075, None)}


def auto_spans(rows):
    return runs.segments(rows, F.col("auto")).where("label <> ''").select("train", "label", "start", "end")


def denied(rows):
    return rows.withColumn("negative", F.when((F.col("kind") == "error") & (F.col("isi") < 0.006), "not_burst").otherwise(""))


@query(f"""{EVENTS}, m AS (SELECT ev.*, min(isi) FILTER (valid) AS a, max(isi) FILTER (valid) AS b, quantile_cont(isi, 0.9) FILTER (valid) AS q90 FROM ev JOIN s ON s.train = ev.train AND s.idx BETWEEN ev.start AND ev.e GROUP BY ALL),
l AS (SELECT m.*, lo, hi FROM m LEFT JOIN (VALUES ('burst', 0.002, 0.0075), ('possible_burst', 0.002, 0.0075), ('tonic', 0.021, 0.045), ('pause', 0.075, NULL)) AS t(label, lo, hi) USING (label)),
w AS (SELECT *, concat_ws(';', CASE WHEN a < lo THEN 'below_pattern_Min_ISI' END, CASE WHEN label IN ('burst', 'possible_burst') AND q90 > hi THEN 'burst_family_q90_above_pattern_Max_ISI' WHEN label NOT IN ('burst', 'possible_burst') AND b > hi THEN 'above_pattern_Max_ISI' END) AS why FROM l),
x AS (SELECT *, CASE WHEN lo IS NULL AND hi IS NULL THEN 'pattern_isi_gate_disabled' WHEN a IS NULL THEN 'no_valid_isi_for_pattern_isi_gate' WHEN why = '' THEN 'pattern_isi_gate_pass' ELSE why END AS reason FROM w)
SELECT train, label, start, e AS "end", reason, reason IN ('pattern_isi_gate_pass', 'pattern_isi_gate_disabled') AS passed FROM x""")
def pattern_gates(spark, d):
    rows = labelled(trains(spark, d))
    return ga.pattern_gate(rows, auto_spans(rows), LIMITS)


@query(f"""{EVENTS}, n AS (SELECT ev.*, s.idx, isi, lag(isi) OVER (PARTITION BY ev.train, ev.start ORDER BY s.idx) AS p FROM ev JOIN s ON s.train = ev.train AND s.idx BETWEEN ev.start AND ev.e WHERE isi IS NOT NULL)
SELECT train, label, start, e AS "end", round(avg(3 * (isi - p) ** 2 / (isi + p) ** 2), 6) AS lv, round(avg(isi), 9) AS mean, count(*) FILTER (isi <= 0.008) >= 2 OR coalesce(min((isi + p) / 2) <= 0.008, false) AS anti_burst,
 coalesce(count(*) >= 2 AND avg(3 * (isi - p) ** 2 / (isi + p) ** 2) <= 0.35 AND avg(isi) BETWEEN 0.02 AND 0.06, false) AS anti_tonic FROM n GROUP BY ALL""")
def burst_tonic_vetoes(spark, d):
    rows = labelled(trains(spark, d))
    x = ga.vetoes(rows, auto_spans(rows), 0.008, 0.35, (0.02, 0.06))
    return x.select("train", "label", "start", "end", r("lv", 6).alias("lv"), r("mean").alias("mean"), "anti_burst", "anti_tonic")


@query(f"""{EVENTS} SELECT ev.train, ev.label, ev.start, ev.e AS "end", round(avg({NEGATIVE}::INT), 9) AS negative_share FROM (SELECT * FROM ev) ev JOIN (SELECT train, idx, kind, coalesce(isi, 1) AS isi FROM s) s ON s.train = ev.train AND s.idx BETWEEN ev.start AND ev.e GROUP BY ALL""")
def negative_overlap(spark, d):
    rows = denied(labelled(trains(spark, d)))
    return rounded(ga.negative_overlap(rows, auto_spans(rows)))


@query(""", x AS (SELECT train, idx, CASE WHEN kind = 'error' THEN ' Needs_Review ' WHEN kind = 'search' THEN 'ambiguous' ELSE manual END AS label FROM s)
SELECT lower(trim(label)) IN ('ambiguous', 'manual_uncertain', 'uncertain', 'needs_review', 'review', 'unknown', 'possible_uncertain', 'boundary_uncertain') AS left_out, label, count(*) AS n FROM x GROUP BY ALL""")
def ambiguous_labels(spark, d):
    label = F.when(F.col("kind") == "error", " Needs_Review ").when(F.col("kind") == "search", "ambiguous").otherwise(F.col("manual"))
    kept, left = ga.clear_events(labelled(trains(spark, d)).select("train", "idx", label.alias("label")))
    count = lambda df, flag: df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit(flag).alias("left_out"), "label", "n")
    return count(kept, False).unionByName(count(left, True))


@query(""", u AS (SELECT *, isi IS NOT NULL AND NOT artifact AS real FROM s), v AS (SELECT *, lag(isi) OVER (PARTITION BY train ORDER BY idx) AS p, quantile_cont(isi, 0.5) OVER (PARTITION BY train) AS med FROM u WHERE real),
x AS (SELECT train, count(*) AS n, quantile_cont(isi, 0.1) AS q10, quantile_cont(isi, 0.9) AS q90, avg(3 * (isi - p) ** 2 / (isi + p) ** 2) AS lv, avg((isi <= 0.02)::INT) AS fast, avg((isi >= greatest(0.1, 2.5 * med))::INT) AS slow FROM v GROUP BY train)
SELECT t.train, CASE WHEN n IS NULL OR n < 30 THEN 'low_spike_count_unreliable' WHEN slow >= 0.12 THEN 'pause_dominant' WHEN fast >= 0.6 AND lv <= 0.35 THEN 'hf_tonic_dominant' WHEN lv <= 0.35 AND q90 / q10 <= 2.5 THEN 'tonic_dominant' WHEN fast >= 0.15 THEN 'burst_capable' ELSE 'mixed' END AS prior
FROM (SELECT DISTINCT train FROM s) t LEFT JOIN x USING (train)""")
def train_phenotypes(spark, d):
    return ga.phenotype(trains(spark, d))


GATE = ga.BurstGate(edge=1.5, context=1.2, tonic_edge=1.5, tonic_context=1.2, pause_context=1.3, ceiling=0.008, fuzzy_percent=10.0, one_flank=1.6)


@query(f"""{EVENTS}, cand AS (SELECT * FROM ev WHERE label IN ('burst', 'possible_burst')),
u AS (SELECT *, isi IS NOT NULL AND NOT artifact AS real FROM s), v AS (SELECT *, lag(isi) OVER (PARTITION BY train ORDER BY idx) AS p, quantile_cont(isi, 0.5) OVER (PARTITION BY train) AS med FROM u WHERE real),
t AS (SELECT train, count(*) AS n, quantile_cont(isi, 0.1) AS q10, quantile_cont(isi, 0.9) AS q90, avg(3 * (isi - p) ** 2 / (isi + p) ** 2) AS lv, avg((isi <= 0.02)::INT) AS fast, avg((isi >= greatest(0.1, 2.5 * med))::INT) AS slow FROM v GROUP BY train),
prior AS (SELECT train, CASE WHEN n < 30 THEN 'low_spike_count_unreliable' WHEN slow >= 0.12 THEN 'pause_dominant' WHEN fast >= 0.6 AND lv <= 0.35 THEN 'hf_tonic_dominant' WHEN lv <= 0.35 AND q90 / q10 <= 2.5 THEN 'tonic_dominant' WHEN fast >= 0.15 THEN 'burst_capable' ELSE 'mixed' END AS prior FROM t),
i AS (SELECT cand.*, s.idx, isi, valid, lag(isi) OVER (PARTITION BY cand.train, cand.start ORDER BY s.idx) AS p FROM cand JOIN s ON s.train = cand.train AND s.idx BETWEEN cand.start AND cand.e WHERE valid),
m AS (SELECT train, start, e, label, quantile_cont(isi, 0.5) AS q50, quantile_cont(isi, 0.9) AS q90, quantile_cont(isi, 0.95) AS q95, max(isi) AS mx, stddev_samp(isi) / avg(isi) AS cv, avg(3 * (isi - p) ** 2 / (isi + p) ** 2) AS lv FROM i GROUP BY train, start, e, label),
vk AS (SELECT train, idx, isi, row_number() OVER (PARTITION BY train ORDER BY idx) AS k FROM s WHERE valid),
bef AS (SELECT m.train, m.start, m.e, quantile_cont(vk.isi, 0.5) AS b FROM m JOIN vk ON vk.train = m.train AND vk.idx < m.start AND vk.k > (SELECT count(*) FROM vk z WHERE z.train = m.train AND z.idx < m.start) - 5 GROUP BY ALL),
aft AS (SELECT m.train, m.start, m.e, quantile_cont(vk.isi, 0.5) AS a FROM m JOIN vk ON vk.train = m.train AND vk.idx > m.e AND vk.k <= (SELECT count(*) FROM vk z WHERE z.train = m.train AND z.idx <= m.e) + 5 GROUP BY ALL),
neg AS (SELECT m.train, m.start, m.e, avg(coalesce({NEGATIVE}, false)::INT) AS neg FROM m JOIN s ON s.train = m.train AND s.idx BETWEEN m.start AND m.e GROUP BY ALL),
x AS (SELECT m.*, prior, neg, CASE WHEN f.isi >= 0.0009 THEN f.isi END AS pre, CASE WHEN g.isi >= 0.0009 THEN g.isi END AS post, (coalesce(b, a) + coalesce(a, b)) / 2 AS ctx,
 CASE WHEN m.q90 <= 0.008 THEN 'strict' WHEN m.q90 <= 0.008 * 1.1 THEN 'fuzzy' ELSE 'fail' END AS zone
 FROM m JOIN prior USING (train) JOIN neg USING (train, start, e) LEFT JOIN bef USING (train, start, e) LEFT JOIN aft USING (train, start, e) LEFT JOIN s f ON f.train = m.train AND f.idx = m.start - 1 LEFT JOIN s g ON g.train = m.train AND g.idx = m.e + 1),
y AS (SELECT *, least(pre, post) / q90 AS er, ctx / q90 AS cr, least(pre, post) / ctx AS rr, CASE WHEN zone = 'fuzzy' THEN 4.0 ELSE 1.5 END AS need, CASE WHEN prior = 'pause_dominant' THEN 1.3 ELSE 1.2 END AS cneed FROM x),
z AS (SELECT *, coalesce(er >= need, false) AS ep, coalesce(cr >= cneed, false) AS cp, coalesce(rr >= 0.6, true) AS rp, coalesce(q95 / q50 <= 3.5, true) AND coalesce(mx / q50 <= 5, true) AND coalesce(cv <= 1.5, true) AND coalesce(lv <= 2, true) AS ok FROM y),
d AS (SELECT *, pre IS NOT NULL AND post IS NOT NULL AND zone <> 'fail' AND cp AND ok AND neg = 0 AND ep AND rp AS whole, NOT (pre IS NOT NULL AND post IS NOT NULL) AND zone <> 'fail' AND cp AND ok AND neg = 0 AND coalesce(er >= greatest(need, 1.6), false) AS one FROM z)
SELECT train, start, e AS "end", label, CASE WHEN whole AND zone <> 'fuzzy' AND label <> 'possible_burst' THEN 'burst' WHEN whole OR one THEN 'possible_burst' ELSE 'reject' END AS final_label,
 CASE WHEN whole AND zone = 'fuzzy' THEN 'fuzzy_abs_ceiling_pass_requires_review' WHEN whole AND label = 'possible_burst' THEN 'possible_burst_candidate_passed_arbitration_gates' WHEN whole THEN 'canonical_burst_gate_pass' WHEN one THEN 'one_sided_boundary_burst_review'
 WHEN zone = 'fail' THEN 'reject_abs_ceiling_fail' WHEN neg > 0 THEN 'manual_negative_veto' WHEN NOT ep OR NOT cp THEN concat_ws(';', CASE WHEN NOT ep THEN 'edge_ratio_fail' END, CASE WHEN NOT cp THEN 'context_compression_fail' END) WHEN NOT ok THEN 'internal_coherence_fail' ELSE 'arbitration_reject' END AS decision,
 zone, prior, round(er, 6) AS edge_ratio, round(cr, 6) AS context_ratio, round(rr, 6) AS edge_return, ep AS edge_pass, cp AS context_pass, rp AS return_pass, ok AS coherent, round(neg, 9) AS negative_share FROM d""")
def canonical_burst_gate(spark, d):
    rows = denied(labelled(trains(spark, d)))
    x = ga.canonical_bursts(rows, stored(auto_spans(rows).where(F.col("label").isin("burst", "possible_burst")), "burst-spans"), GATE)
    return x.withColumns({"edge_ratio": r("edge_ratio", 6), "context_ratio": r("context_ratio", 6), "edge_return": r("edge_return", 6), "negative_share": r("negative_share")})


@query(""", l AS (SELECT *, CASE WHEN auto = 'tonic' THEN 'high_frequency_spiking' ELSE auto END AS lab FROM s),
t AS (SELECT *, lab = 'high_frequency_spiking' AND manual = '' AND isi IS NOT NULL AND NOT artifact AND isi > 0.045 AS trim FROM l), a AS (SELECT *, CASE WHEN idx = 1 OR trim THEN '' ELSE lab END AS l2, lag(t) OVER (PARTITION BY train ORDER BY idx) AS f FROM t),
g AS (SELECT *, idx - row_number() OVER (PARTITION BY train, l2 ORDER BY idx) AS run FROM a),
m AS (SELECT train, l2, run, count(*) AS n, count(*) FILTER (isi IS NOT NULL AND NOT artifact) AS real, max(t) - min(coalesce(f, t)) AS dur, min(isi) FILTER (valid) AS lo, max(isi) FILTER (valid) AS hi, quantile_cont(isi, 0.9) FILTER (valid) AS q90 FROM g WHERE l2 <> '' GROUP BY ALL),
k AS (SELECT *, CASE l2 WHEN 'burst' THEN 3 WHEN 'possible_burst' THEN 3 WHEN 'high_frequency_spiking' THEN 4 WHEN 'pause' THEN 2 ELSE 1 END AS least FROM m),
v AS (SELECT *, CASE WHEN l2 = 'burst' OR l2 = 'possible_burst' THEN q90 <= 0.0095 AND lo >= 0.002 WHEN l2 = 'high_frequency_spiking' THEN hi <= 0.045 ELSE true END AS gate, n + 1 >= least AND real >= least - 1 AND (l2 <> 'pause' OR dur >= 0.09) AS fine FROM k)
SELECT g.train, idx, CASE WHEN trim OR (g.l2 <> '' AND manual = '' AND NOT (coalesce(gate, false) AND fine)) THEN '' ELSE g.l2 END AS auto, CASE WHEN trim THEN 'trimmed' WHEN g.l2 <> '' AND manual = '' AND NOT coalesce(gate, false) THEN 'gate' WHEN g.l2 <> '' AND manual = '' AND NOT fine THEN 'fragment' END AS removed
FROM g LEFT JOIN v ON v.train = g.train AND v.l2 = g.l2 AND v.run = g.run""")
def validated_events(spark, d):
    rows = labelled(trains(spark, d)).withColumn("auto", F.when(F.col("auto") == "tonic", "high_frequency_spiking").otherwise(F.col("auto")))
    limits = {"burst": (0.002, 0.0095), "high_frequency_spiking": (None, 0.045)}
    x = ga.validated(rows, {**ga.LEAST_SPIKES, "high_frequency_spiking": 4}, {"pause": 0.09}, limits)
    return x.select("train", "idx", "auto", "removed")


@query(f"""{EVENTS} SELECT concat_ws(':', 'r1', 'event', train::VARCHAR, (row_number() OVER (PARTITION BY train ORDER BY start))::VARCHAR) AS event_id, train, label, start, e AS "end", 'r1' AS run_id, 'h' AS params_hash,
 CASE WHEN label = 'possible_burst' THEN 'review_candidate' WHEN label IN ('burst', 'long_burst') THEN 'high_confidence_burst_family_member' ELSE 'high_confidence_nonburst_or_other' END AS event_layer, CASE WHEN label IN ('burst', 'long_burst', 'possible_burst') THEN 'burst_family' ELSE label END AS pattern_family FROM ev""")
def event_ledger(spark, d):
    return ga.event_ledger(auto_spans(labelled(trains(spark, d))), "r1", "h")


@query(f"""{EVENTS}, l AS (SELECT 'high_confidence' AS layer, * FROM ev WHERE label <> 'possible_burst' UNION ALL SELECT 'review_candidates', * FROM ev WHERE label = 'possible_burst'
UNION ALL SELECT 'burst_family', * FROM ev WHERE label IN ('burst', 'long_burst', 'possible_burst') UNION ALL SELECT 'all_event_family_map', * FROM ev) SELECT layer, train, count(*) AS n FROM l GROUP BY ALL""")
def result_layers(spark, d):
    out = None
    for name, df in ga.result_layers(stored(auto_spans(labelled(trains(spark, d))), "event-spans")).items():
        part = df.groupBy("train").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "train", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(""", q AS (SELECT * FROM (VALUES ('burst', 0.01, 0.95), ('tonic', 0.05, 0.95), ('pause', 0.05, 0.99)) AS t(pattern, ql, qh)),
o AS (SELECT train, manual AS pattern, isi FROM s WHERE valid AND manual IN ('burst', 'tonic', 'pause')),
a AS (SELECT train, pattern, count(*) AS n, quantile_cont(isi, 0.01) AS l01, quantile_cont(isi, 0.05) AS l05, quantile_cont(isi, 0.95) AS h95, quantile_cont(isi, 0.99) AS h99, quantile_cont(isi, 0.75) - quantile_cont(isi, 0.25) AS iqr, quantile_cont(isi, 0.5) AS med FROM o GROUP BY ALL),
d AS (SELECT train, pattern, quantile_cont(abs(isi - med), 0.5) AS mad FROM o JOIN a USING (train, pattern) GROUP BY ALL),
v AS (SELECT train, isi, cume_dist() OVER (PARTITION BY train ORDER BY isi) * 100 AS pct FROM s WHERE valid), mx AS (SELECT train, max(isi) AS most FROM v GROUP BY train),
b AS (SELECT train, pattern, n, CASE WHEN pattern = 'burst' THEN l01 ELSE l05 END AS low, CASE WHEN pattern = 'pause' THEN h99 ELSE h95 END AS raw, CASE WHEN iqr > 0 THEN iqr ELSE mad END AS spread, most FROM a JOIN d USING (train, pattern) JOIN mx USING (train)),
h AS (SELECT *, CASE WHEN pattern = 'burst' THEN least(raw + 0.25 * spread, most) ELSE raw END AS high FROM b),
p AS (SELECT h.train, pattern, n, low, high, coalesce(max(pct) FILTER (isi <= low), 0) AS lp, coalesce(max(pct) FILTER (isi <= raw), 0) AS rp, coalesce(max(pct) FILTER (isi <= high), 0) AS hp FROM h JOIN v USING (train) GROUP BY ALL)
SELECT train, pattern, n, round(low, 9) AS low, round(high, 9) AS high, round(lp, 6) AS low_percent, round(CASE WHEN pattern = 'burst' THEN greatest(hp, least(100, rp + 5)) ELSE hp END, 6) AS high_percent FROM p""")
def learned_ranges(spark, d):
    x = ra.learned_ranges(labelled(trains(spark, d)))
    return x.select("train", "pattern", "n", r("low").alias("low"), r("high").alias("high"), r("low_percent", 6).alias("low_percent"), r("high_percent", 6).alias("high_percent"))


@query(""", o AS (SELECT train, min(idx) AS k, train % 2 = 0 AS hard, CASE WHEN train % 3 = 0 THEN 0.008 + 0.0001 * (train % 50) END AS bm, CASE WHEN train % 4 = 1 THEN 0.012 END AS tl, CASE WHEN train % 8 = 1 THEN 0.013 END AS th, CASE WHEN train % 5 = 0 THEN 0.2 ELSE 0 END AS pm FROM s GROUP BY train),
x AS (SELECT *, CASE WHEN bm IS NULL THEN 0.01 WHEN hard THEN bm ELSE greatest(0.01, bm) END AS seed, CASE WHEN bm IS NULL THEN 0.015 ELSE greatest(0.015, bm, bm * 1.25) END AS br FROM o),
y AS (SELECT *, greatest(seed, br, coalesce(bm, 0)) * 1.15 AS guard, tl IS NOT NULL OR th IS NOT NULL AS asked FROM x),
z AS (SELECT *, CASE WHEN asked THEN greatest(coalesce(tl, 0.02), guard) ELSE 0.02 END AS lo FROM y)
SELECT train, round(seed, 9)::DOUBLE AS seed_high, round(br, 9)::DOUBLE AS bridge, round(lo, 9)::DOUBLE AS tonic_min, round(CASE WHEN asked AND coalesce(th, 0.06) <= lo THEN greatest(lo + 0.001, lo * 1.25) ELSE coalesce(th, 0.06) END, 9)::DOUBLE AS tonic_max, CASE WHEN pm > 0 THEN pm ELSE 0.1 END::DOUBLE AS pause_min FROM z""")
def train_overrides(spark, d):
    rows, k = trains(spark, d), F.col("train")
    given = rows.select("train").distinct().select("train", (k % 2 == 0).alias("hard"), F.when(k % 3 == 0, 0.008 + 0.0001 * (k % 50)).alias("burst_max"), F.when(k % 4 == 1, 0.012).alias("tonic_min"), F.when(k % 8 == 1, 0.013).alias("tonic_max"), F.when(k % 5 == 0, 0.2).otherwise(0.0).alias("pause_min"))
    return rounded(ra.train_settings(rows, given, 0.01, 0.015, (0.02, 0.06), 0.1))


@query()
def frozen_thresholds(spark, d):
    """Bands from the calibration half of the trains."""
    rows = trains(spark, d)
    found = ra.frozen_bands(rows, va.split(rows).where("part = 'calibration'"))
    return rounded(spark.createDataFrame([(p, *band) for p, band in found.items()], "pattern string, low double, high double, bridge double, contrast double"))


@query()
def rater_agreement(spark, d):
    """Labels by hand, by bands, and by wider bands as three raters."""
    rows = labelled(trains(spark, d))
    wide = F.when(F.col("isi") < 0.012, "burst").when(F.col("isi").between(0.02, 0.06), "tonic").otherwise("")
    seg = lambda c, name: runs.segments(rows, c).where("label <> ''").select("train", "label", "start", "end", F.lit(name).alias("rater"))
    return rounded(va.rater_agreement(stored(seg(F.col("manual"), "a").unionByName(seg(F.col("auto"), "b")).unionByName(seg(wide, "c")), "rated")))


@query(f"""{EVENTS} SELECT train, start, e AS "end", label AS strict, CASE WHEN label IN ('burst', 'long_burst', 'possible_burst') THEN 'burst_family' ELSE label END AS family FROM ev""")
def metric_modes(spark, d):
    """Events with the label that each mode of scoring gives them."""
    x = auto_spans(labelled(trains(spark, d)))
    return x.select("train", "start", "end", *[va.strict_or_family(F.col("label"), m).alias(n) for n, m in (("strict", "strict"), ("family", "family"))])


@query()
def overfit_gaps(spark, d):
    """How much better the bands match labels by hand on the calibration half of the trains than on the other."""
    rows = labelled(trains(spark, d))
    part = stored(va.split(rows), "split")
    seg = lambda c: stored(runs.segments(rows, F.col(c)).where("label <> ''").select("train", "label", "start", "end"), "spans")
    return rounded(va.overfit(seg("auto"), seg("manual"), part))


@query()
def block_bootstrap(spark, d):
    """Intervals of the label sequences' measures by resampled blocks."""
    from pulsegrid.operators.dynamics import block_bootstrap as bootstrap

    rows = labelled(trains(spark, d)).where("auto <> ''").select("train", "idx", F.col("auto").alias("label"))
    return rounded(bootstrap(rows, replicates=20))
