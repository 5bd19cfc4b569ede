"""Queries over thresholds, detectors and the labels that come of them."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.grammar import Grammar
from pulsegrid.operators import detectors as de
from pulsegrid.operators import proposals as pp
from pulsegrid.operators import support as su
from pulsegrid.operators import thresholds as th
from pulsegrid.operators.statistics import span_metrics
from pulsegrid.sources.events import labelled, trains
from pulsegrid.sources.shared import stored

from .registry import query, r, rounded

POOLED = ", ".join(f"round(quantile_cont(isi, {p}), 9) AS q{int(p * 1000):03d}" for p in th.QUANTILES)


@query(f"SELECT count(*) AS n, round(min(isi), 9) AS least, {POOLED} FROM s WHERE valid")
def pooled_quantiles(spark, d):
    return rounded(th.pooled(trains(spark, d)))


@query("SELECT floor(isi / 0.005)::INT AS bin, count(*) AS n FROM s WHERE valid AND isi <= 0.08 GROUP BY ALL")
def low_tail_bins(spark, d):
    return th.low_bins(trains(spark, d), 0.08)


#: The suggested bands from the same pooled numbers: a row for each pattern.
HISTOGRAM_BANDS = """, p AS (SELECT count(*) AS n, min(isi) AS o, quantile_cont(isi, 0.005) AS q005, quantile_cont(isi, 0.1) AS q10, quantile_cont(isi, 0.15) AS q15, quantile_cont(isi, 0.2) AS q20,
 quantile_cont(isi, 0.25) AS q25, quantile_cont(isi, 0.35) AS q35, quantile_cont(isi, 0.5) AS q50, quantile_cont(isi, 0.75) AS q75, quantile_cont(isi, 0.9) AS q90, quantile_cont(isi, 0.95) AS q95 FROM s WHERE valid),
lim AS (SELECT *, least(greatest(q35, 0.03), 0.08) AS xmax, o > 0.015 AND o <= q50 * 0.45 AS slow FROM p),
cnt AS (SELECT floor(isi / 0.005)::INT + 1 AS i, count(*) AS c FROM s, lim WHERE valid AND isi <= xmax GROUP BY ALL),
bin AS (SELECT i, coalesce(c, 0) AS c, (i - 0.5) * 0.005 AS mid FROM (SELECT unnest(range(1, (SELECT ceil(round(xmax / 0.005, 9))::INT FROM lim) + 2)) AS i) LEFT JOIN cnt USING (i)),
pk AS (SELECT i AS peak, c AS height FROM bin, lim WHERE mid >= 0.001 AND mid <= least(xmax, greatest(0.04, q15, o * 1.1)) AND c > 0 ORDER BY c DESC, i LIMIT 1),
nb AS (SELECT i, c, lag(c) OVER (ORDER BY i) AS b, lead(c) OVER (ORDER BY i) AS a FROM bin),
vl AS (SELECT coalesce(min(i) FILTER (c <= b AND c <= a), min(i) FILTER (c <= 0.55 * height)) * 0.005 AS v FROM nb, pk WHERE i > peak AND i <= peak + 10 AND (SELECT sum(c) FROM bin) >= 8),
hi AS (SELECT lim.*, greatest(CASE WHEN v > 0.001 THEN v WHEN slow THEN least(greatest(q10, q15, o * 1.05, o), greatest(q25, o)) ELSE least(greatest(q10, 0.006), 0.015) END, CASE WHEN slow THEN o ELSE 0 END) AS h FROM lim, vl),
br AS (SELECT *, greatest(0.001, least(q005, h * 0.25)) AS lo, least(greatest(h * 1.5, h + 0.005), CASE WHEN slow THEN greatest(h * 1.8, q20, least(q25, q50 * 0.85)) ELSE 0.05 END) AS b0 FROM hi),
f AS (SELECT *, CASE WHEN slow AND b0 <= h THEN greatest(h * 1.25, h + 0.005) ELSE b0 END AS b FROM br),
bands AS (SELECT 'burst' AS pattern, lo AS low, h AS high, b AS bridge, 2.5 AS contrast FROM f
UNION ALL SELECT 'high_frequency_spiking', lo, greatest(b, h), greatest(b * 2, 0.03), NULL FROM f
UNION ALL SELECT 'high_frequency_tonic', greatest(h, least(q25, 0.03)), greatest(q25, b, 0.02), greatest(q25, b * 1.3, 0.03), NULL FROM f
UNION ALL SELECT 'tonic', greatest(q25, b, 0.02), greatest(q75, q50, 0.05), greatest(q90, q75, 0.08), NULL FROM f
UNION ALL SELECT 'pause', greatest(q90, 0.08), greatest(q95, q90, 0.15), greatest(q95, q90, 0.15), NULL FROM f)"""


@query(f"{HISTOGRAM_BANDS} SELECT pattern, round(low, 9) AS low, round(high, 9) AS high, round(bridge, 9) AS bridge, contrast::DOUBLE AS contrast FROM bands")
def histogram_thresholds(spark, d):
    found = th.histogram_bands(trains(spark, d))
    return rounded(spark.createDataFrame([(p, *band) for p, band in found.items()], "pattern string, low double, high double, bridge double, contrast double"))


MANUAL_BANDS = """, sides AS (SELECT *, lag(isi) OVER w AS pre, lead(isi) OVER w AS post, CASE WHEN valid THEN manual ELSE '' END AS l FROM s WINDOW w AS (PARTITION BY train ORDER BY idx)),
c AS (SELECT *, idx - row_number() OVER (PARTITION BY train, l ORDER BY idx) AS run FROM sides WHERE l <> ''),
e AS (SELECT CASE WHEN l IN ('burst', 'long_burst', 'possible_burst') THEN 'burst' ELSE l END AS pattern, quantile_cont(isi, 0.05) AS q05, quantile_cont(isi, 0.1) AS q10, quantile_cont(isi, 0.9) AS q90, quantile_cont(isi, 0.95) AS q95,
 arg_min(coalesce(pre, -1), idx) AS pre, arg_max(coalesce(post, -1), idx) AS post FROM c GROUP BY train, l, run),
m AS (SELECT pattern, count(*) AS events, CASE WHEN pattern = 'burst' THEN greatest(quantile_cont(q05, 0.25), 0) ELSE quantile_cont(q10, 0.5) END AS low, quantile_cont(q90, 0.5) AS high,
 CASE WHEN pattern = 'burst' THEN greatest(quantile_cont(q95, 0.75), quantile_cont(q90, 0.5)) ELSE quantile_cont(q95, 0.75) END AS bridge,
 CASE WHEN pattern = 'burst' THEN greatest(1.2, quantile_cont(least(pre, post) / q90, 0.25) FILTER (pre >= 0 AND post >= 0)) END AS contrast FROM e GROUP BY pattern)"""


def manual_events(rows):
    """Runs of labels by hand over valid intervals, with the intervals beside them."""
    from pulsegrid.operators.isi import in_train
    from pulsegrid.operators.runs import segments

    rows = rows.withColumns({"_pre": F.lag("isi").over(in_train()), "_post": F.lead("isi").over(in_train())})
    label = F.when(F.col("valid"), F.col("manual")).otherwise("")
    return segments(rows, label, F.collect_list("isi").alias("isi_values"), F.min_by("_pre", "idx").alias("pre"), F.max_by("_post", "idx").alias("post")).where("label <> ''")


@query(f"{MANUAL_BANDS} SELECT pattern, events, round(low, 9) AS low, round(high, 9) AS high, round(bridge, 9) AS bridge, round(contrast, 9) AS contrast FROM m")
def manual_thresholds(spark, d):
    return rounded(th.manual_bands(manual_events(labelled(trains(spark, d)))))


@query(f"""{HISTOGRAM_BANDS}{MANUAL_BANDS}, def AS (SELECT * FROM (VALUES ('burst', 0.001, 0.01, 0.015, 2.5), ('high_frequency_spiking', 0.001, 0.02, 0.03, NULL), ('high_frequency_tonic', 0.01, 0.02, 0.025, NULL), ('tonic', 0.02, 0.06, 0.075, NULL), ('pause', 0.1, 0.15, 0.15, NULL)) AS t(pattern, low, high, bridge, contrast)),
long AS (UNPIVOT (SELECT pattern, 'h' AS src, low::DOUBLE AS low, high::DOUBLE AS high, bridge::DOUBLE AS bridge, contrast::DOUBLE AS contrast FROM bands UNION ALL SELECT pattern, 'm', low, high, bridge, contrast FROM m UNION ALL SELECT pattern, 'd', low, high, bridge, contrast FROM def) ON low, high, bridge, contrast INTO NAME field VALUE v),
pick AS (SELECT p.pattern, f.field, max(v) FILTER (src = 'm') AS manual, max(v) FILTER (src = 'h') AS histogram, max(v) FILTER (src = 'd') AS "default" FROM def p CROSS JOIN (SELECT unnest(['low', 'high', 'bridge', 'contrast']) AS field) f LEFT JOIN long USING (pattern, field) GROUP BY ALL),
ch AS (SELECT *, coalesce(manual, histogram, "default") AS v, CASE WHEN manual IS NOT NULL THEN 'manual' WHEN histogram IS NOT NULL THEN 'histogram' WHEN "default" IS NOT NULL THEN 'default' ELSE 'none' END AS source FROM pick),
w AS (SELECT pattern, max(v) FILTER (field = 'low') AS l, max(v) FILTER (field = 'high') AS h0, max(v) FILTER (field = 'bridge') AS b0, max(v) FILTER (field = 'contrast') AS s, max("default") FILTER (field = 'high') AS d FROM ch GROUP BY pattern),
x AS (SELECT *, CASE WHEN h0 > l THEN h0 ELSE greatest(l + 0.001, d) END AS h FROM w),
y AS (SELECT pattern, s, CASE WHEN pattern = 'high_frequency_tonic' THEN greatest(l, (SELECT h FROM x WHERE pattern = 'burst')) ELSE l END AS l, h, greatest(b0, h) AS b FROM x),
z AS (SELECT pattern, s, l, CASE WHEN pattern = 'high_frequency_tonic' AND h <= l THEN greatest(l * 1.5, l + 0.001) ELSE h END AS h, b FROM y)
SELECT ch.pattern, field, NULL::DOUBLE AS "user", round(manual, 9) AS manual, round(histogram, 9) AS histogram, round("default"::DOUBLE, 9) AS "default",
 round(CASE field WHEN 'low' THEN l WHEN 'high' THEN h WHEN 'bridge' THEN greatest(b, h) ELSE s END, 9) AS effective, source FROM ch JOIN z USING (pattern)""")
def resolved_thresholds(spark, d):
    rows = labelled(trains(spark, d))
    return rounded(th.resolved(spark, th.histogram_bands(rows), manual=th.as_bands(th.manual_bands(manual_events(rows)))))


def settings(spark, d, rows=None) -> Grammar:
    return th.settings(th.resolved(spark, th.histogram_bands(trains(spark, d) if rows is None else rows)))


def judged(spark, d):
    """(labelled rows, all candidates, the settings that they were found with). Trains are put in order once, for the settings and for the detectors."""
    rows = stored(labelled(trains(spark, d)), "labelled")
    g = settings(spark, d, rows)
    return (*de.detect(rows, g, kept=True), g)


def detected(spark, d):
    return judged(spark, d)[:2]


#: Candidates by fixed bands, so that SQL can make them as well: runs of intervals as states, bursts inside and beside them, and tonic states.
BAND_CANDIDATES = """, fl AS (SELECT *, CASE k WHEN 1 THEN isi <= 0.15 WHEN 2 THEN isi <= 0.03 ELSE isi > 0.03 AND isi <= 0.06 END AS f FROM s, (SELECT unnest([1, 2, 3]) AS k) WHERE valid),
ru AS (SELECT *, idx - row_number() OVER (PARTITION BY train, k ORDER BY idx) AS run FROM fl WHERE f),
pr AS (SELECT *, lag(isi) OVER (PARTITION BY train, k, run ORDER BY idx) AS a FROM ru),
sp AS (SELECT train, k, min(idx) AS start, max(idx) AS e, count(*) AS n, sum(isi) AS duration, quantile_cont(isi, 0.9) AS q90, stddev_samp(isi) / avg(isi) AS cv, max(isi) / avg(isi) AS mm, avg(3 * (a - isi) ** 2 / (a + isi) ** 2) AS lv,
 count(*) FILTER (isi <= 0.06) / count(*) AS short, count(*) FILTER (isi <= 0.12) / count(*) AS bridged FROM pr GROUP BY train, k, run HAVING count(*) >= CASE k WHEN 1 THEN 8 ELSE 2 END),
ca AS (SELECT sp.*, p.isi AS pre, q.isi AS post, row_number() OVER (PARTITION BY sp.train ORDER BY k, sp.start) AS c FROM sp LEFT JOIN s p ON p.train = sp.train AND p.idx = sp.start - 1 LEFT JOIN s q ON q.train = sp.train AND q.idx = sp.e + 1)"""
#: What the rules about spiking states say of them: ve holds the states.
STATE_VERDICTS = f"""{BAND_CANDIDATES}, ct AS (SELECT h.train, h.c, b.start AS bs, b.e AS be, max(b.e) OVER (PARTITION BY h.train, h.c ORDER BY b.start, b.e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
 FROM ca h JOIN ca b ON b.train = h.train AND h.k = 1 AND b.k = 2 AND b.start >= h.start AND b.e <= h.e),
cv_ AS (SELECT train, c, count(*) AS bursts, count(*) FILTER (before IS NULL OR bs > before) AS groups, sum(greatest(0, be - greatest(coalesce(before, bs - 1), bs - 1))) AS covered FROM ct GROUP BY ALL),
st AS (SELECT ca.*, coalesce(bursts, 0) AS bursts, coalesce(groups, 0) AS groups, coalesce(covered, 0) / (e - start + 1) AS coverage, coalesce(cv >= 0.65, false) OR coalesce(lv >= 0.45, false) OR coalesce(mm >= 3, false) AS varies FROM ca LEFT JOIN cv_ USING (train, c) WHERE k = 1),
pk AS (SELECT *, (varies OR 1 - bridged >= 0.08) AND ((groups >= 2 AND coverage >= 0.08) OR (groups >= 1 AND coverage >= 0.18)) AS packet, groups >= greatest(6, ceil(0.055 * (e - start + 1))) AND coverage >= 0.25 AS dominated FROM st),
nb AS (SELECT DISTINCT h.train, h.c FROM pk h JOIN pk p ON p.train = h.train AND p.c <> h.c AND p.packet WHERE NOT h.packet AND NOT h.dominated AND h.varies
 AND CASE WHEN p.e < h.start THEN h.start - p.e - 1 WHEN h.e < p.start THEN p.start - h.e - 1 ELSE 0 END <= 3 AND CASE WHEN p.e < h.start THEN coalesce(h.pre, p.post) WHEN h.e < p.start THEN coalesce(h.post, p.pre) ELSE 0 END <= 0.3),
ve AS (SELECT pk.*, CASE WHEN dominated THEN 'reject_burst_dominated_hf_spiking_state' WHEN packet THEN 'reject_burst_packet_like_hf_spiking_state' WHEN nb.c IS NOT NULL THEN 'reject_burst_packet_neighbor_hf_spiking_state' END AS action FROM pk LEFT JOIN nb ON nb.train = pk.train AND nb.c = pk.c)"""


def band_candidates(spark, d):
    from pulsegrid.operators.runs import runs
    from functools import reduce

    rows = trains(spark, d)
    kinds = [("high_frequency_spiking", F.col("isi") <= 0.15, 8), ("burst", F.col("isi") <= 0.03, 2), ("tonic", (F.col("isi") > 0.03) & (F.col("isi") <= 0.06), 2)]
    found = [runs(rows, F.col("valid") & flag, least=least).select("train", "start", "end", F.lit(k).alias("k"), F.lit(label).alias("label")) for k, (label, flag, least) in enumerate(kinds, 1)]
    spans = reduce(lambda a, b: a.unionByName(b), found)
    m = span_metrics(rows, spans, 0.06, 0.12).join(spans, ["train", "start", "end"])
    m = m.withColumns({"short": F.col("core") / F.col("n_isi"), "bridged": (F.col("core") + F.col("bridges")) / F.col("n_isi"), "tolerated_gap": F.lit(0.3), "q90_most": F.lit(0.1), "action": F.lit("accept")})
    return stored(m.withColumns({"large": 1 - F.col("bridged"), "candidate": F.row_number().over(Window.partitionBy("train").orderBy("k", "start"))}), "band-candidates")


@query(f"{STATE_VERDICTS} SELECT train, start, e AS \"end\", bursts, groups, round(coverage, 9) AS coverage, packet AS packet_like, action FROM ve")
def spiking_state_verdicts(spark, d):
    found = band_candidates(spark, d)
    return rounded(de.state_verdicts(found).join(found.select("train", "candidate", "start", "end"), ["train", "candidate"]).drop("candidate"))


@query(f"""{STATE_VERDICTS}, ok AS (SELECT *, (coalesce(q90 <= 0.1, true)) AND ((e - start + 1 >= 80 AND short >= 0.7 AND bridged >= 0.9) OR (e - start + 1 >= 30 AND short >= 0.85 AND bridged >= 0.95)) AS strong FROM ve WHERE action IS NULL),
wk AS (SELECT DISTINCT b.train, b.c FROM ok h JOIN ca b ON b.train = h.train AND b.k = 3 AND b.start <= h.e AND b.e >= h.start),
em AS (SELECT DISTINCT b.train, b.c FROM ok h JOIN ca b ON b.train = h.train AND h.strong AND b.k = 2 AND b.start >= h.start AND b.e <= h.e WHERE b.e - b.start + 1 <= greatest(8, ceil(0.06 * (h.e - h.start + 1))) AND b.duration <= 0.25)
SELECT ca.train, ca.start, ca.e AS "end", ca.k, CASE WHEN ve.action IS NOT NULL OR wk.c IS NOT NULL OR em.c IS NOT NULL THEN 'reject' ELSE ['high_frequency_spiking', 'burst', 'tonic'][ca.k] END AS label,
 coalesce(ve.action, CASE WHEN wk.c IS NOT NULL THEN 'suppress_for_hf_spiking_state' WHEN em.c IS NOT NULL THEN 'suppress_embedded_burst_for_hf_spiking_state' END, 'accept') AS action
 FROM ca LEFT JOIN ve ON ve.train = ca.train AND ve.c = ca.c LEFT JOIN wk ON wk.train = ca.train AND wk.c = ca.c LEFT JOIN em ON em.train = ca.train AND em.c = ca.c""")
def protected_candidates(spark, d):
    return de.protected(band_candidates(spark, d)).select("train", "start", "end", "k", "label", "action")


@query()
def detector_candidates(spark, d):
    g = settings(spark, d)
    return rounded(de.candidates(stored(de.usable(labelled(trains(spark, d)), g), "trains"), g))


@query()
def candidate_ledger(spark, d):
    return rounded(detected(spark, d)[1])


@query()
def auto_labels(spark, d):
    return detected(spark, d)[0].select("train", "idx", "auto")


@query()
def final_label_table(spark, d):
    return de.final_labels(detected(spark, d)[0]).select("train", "idx", "manual", "auto", "final", "source")


@query()
def event_table(spark, d):
    return rounded(de.extracted(stored(de.final_labels(detected(spark, d)[0]), "final")))


@query()
def near_misses(spark, d):
    _, found, g = judged(spark, d)
    return rounded(de.near_misses(found, g))


@query(""", b AS (SELECT *, CASE WHEN manual <> '' THEN manual ELSE auto END AS l FROM s), x AS (SELECT *, lag(l) OVER w AS p, lead(l) OVER w AS n FROM b WINDOW w AS (PARTITION BY train ORDER BY idx))
SELECT train, idx, CASE WHEN artifact AND l = '' AND p = n AND p IN ('burst', 'long_burst', 'possible_burst', 'tonic') THEN p ELSE l END AS final, CASE WHEN manual <> '' THEN 'manual' WHEN auto <> '' THEN 'auto' ELSE 'none' END AS source FROM x""")
def final_labels_of_bands(spark, d):
    return de.final_labels(labelled(trains(spark, d))).select("train", "idx", "final", "source")


@query(""", u AS (SELECT * FROM s WHERE isi IS NOT NULL AND NOT artifact), f AS (SELECT *, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM u WHERE isi <= 0.02),
g AS (SELECT train, min(idx) AS start, max(idx) AS e, count(*) AS n, count(*) FILTER (isi <= 0.01) AS core FROM f GROUP BY train, run)
SELECT train, start, e AS "end", CASE WHEN n + 1 <= 10 THEN 'burst' ELSE 'long_burst' END AS label, n AS n_isi, round(core / n, 9) AS score FROM g WHERE core >= 2 AND e - start + 2 >= 3""")
def hard_threshold_bursts(spark, d):
    g = Grammar()
    return de.hard_threshold(de.usable(trains(spark, d), g), 0.02, g).select("train", "start", "end", "label", "n_isi", r("score").alias("score"))


@query(""", u AS (SELECT * FROM s WHERE isi IS NOT NULL AND NOT artifact), q AS (SELECT train, count(*) AS n, quantile_cont(isi, 0.1) AS q10, quantile_cont(isi, 0.5) AS q50, quantile_cont(isi, 0.75) AS q75, quantile_cont(isi, 0.9) AS q90 FROM u GROUP BY train),
a AS (SELECT *, greatest(0.1, q90) AS base, CASE WHEN n < 6 THEN 0.02 ELSE greatest(0.0009, least(0.02, q10), greatest(0.01, 0.015) * 1.15) END AS lower FROM q),
b AS (SELECT *, greatest(0.06, q75 * 1.25, CASE WHEN q90 <= 1.5 * q75 THEN q90 * 1.02 END, lower * 1.5) AS high FROM a),
c AS (SELECT *, CASE WHEN base > 1.15 * q90 AND base > lower THEN least(high, base * 0.98) ELSE high END AS capped FROM b),
e AS (SELECT *, CASE WHEN n < 6 THEN 0.06 WHEN capped <= lower THEN greatest(0.06, q75, lower + 0.0009) ELSE capped END AS upper FROM c)
SELECT train, n, round(lower, 9) AS tonic_low, round(upper, 9) AS tonic_high, round(CASE WHEN n >= 10 THEN greatest(base, upper * 1.15) ELSE base END, 9) AS pause_floor FROM e""")
def adaptive_floors(spark, d):
    g = Grammar()
    x = de.references(de.usable(trains(spark, d), g), g)
    return rounded(x.select("train", F.col("_n").alias("n"), F.col("_lower").alias("tonic_low"), F.col("_upper").alias("tonic_high"), F.col("_floor").alias("pause_floor")))


@query(""", v AS (SELECT *, avg(isi) OVER (PARTITION BY train) AS m FROM s WHERE valid), x AS (SELECT train, count(*) AS n, avg(isi) AS mean, avg(isi) FILTER (isi < m) AS ml FROM v GROUP BY train)
SELECT t.train, coalesce(n, 0) AS n, round(mean, 9) AS mean, CASE WHEN n >= 2 THEN round(ml, 9) END AS ml, CASE WHEN n >= 2 AND ml IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status FROM (SELECT DISTINCT train FROM s) t LEFT JOIN x USING (train)""")
def mean_isi_threshold(spark, d):
    return rounded(su.mean_isi(trains(spark, d)))


@query(""", v AS (SELECT *, avg(isi) OVER (PARTITION BY train) AS m FROM s WHERE valid), l AS (SELECT train, avg(isi) FILTER (isi < m) AS ml FROM v GROUP BY train HAVING count(*) >= 2),
c AS (SELECT train, idx, isi, sum(isi) OVER w AS total, sum((NOT valid)::INT) OVER w AS bad FROM s WINDOW w AS (PARTITION BY train ORDER BY idx)),
w AS (SELECT a.train, a.idx AS start, b.idx AS e FROM c a JOIN c b ON a.train = b.train AND b.idx > a.idx JOIN l ON l.train = a.train JOIN s ON s.train = a.train AND s.idx = a.idx AND s.valid
 WHERE b.bad = a.bad AND b.total - a.total + a.isi <= ml * (b.idx - a.idx + 1) + ml * 1e-9),
k AS (SELECT *, max(e) OVER (PARTITION BY train ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM w),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR start > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY train ORDER BY start, e ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT train, min(start) AS start, max(e) AS "end" FROM g GROUP BY train, run""")
def mean_isi_bursts(spark, d):
    return su.mean_isi_bursts(trains(spark, d)).select("train", "start", "end")


@query(""", c AS (SELECT train, floor(log10(isi * 1000) / 0.1)::BIGINT AS bin, count(*) AS n FROM s WHERE valid GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY train), 9) AS p FROM c""")
def log_isi_histogram(spark, d):
    return rounded(su.log_histogram(trains(spark, d)))


@query()
def log_isi_threshold(spark, d):
    return rounded(su.log_threshold(trains(spark, d)))


@query()
def log_isi_bursts(spark, d):
    rows = trains(spark, d)
    return su.core_bursts(rows, stored(su.log_threshold(rows), "log-thresholds"))


@query()
def detector_settings(spark, d):
    g = settings(spark, d)
    return spark.createDataFrame([*g.flat(), ("sha256", g.digest())], "setting string, value string")


@query(""", c AS (SELECT *, idx - row_number() OVER (PARTITION BY train, auto ORDER BY idx) AS run FROM s WHERE auto <> ''), e AS (SELECT train, auto AS label, min(idx) AS start, max(idx) AS e, quantile_cont(isi, 0.9) FILTER (valid) AS q90, count(*) FILTER (valid) AS n FROM c GROUP BY train, auto, run),
x AS (SELECT e.train, e.start, e.e, any_value(label) AS label, any_value(q90) AS q90, quantile_cont(s.isi, 0.5) AS context FROM e LEFT JOIN s ON s.train = e.train AND valid AND (s.idx BETWEEN e.start - 14 AND e.start - 3 OR s.idx BETWEEN e.e + 3 AND e.e + 14) WHERE n > 0 GROUP BY e.train, e.start, e.e)
SELECT train, start, e AS "end", label, round(context, 9) AS context, round(context / q90, 6) AS context_contrast FROM x""")
def eventness_context(spark, d):
    from pulsegrid.operators.runs import segments

    rows = labelled(trains(spark, d))
    ev = segments(rows, F.col("auto")).where("label <> ''")
    x = span_metrics(rows, ev, 0.01, 0.015, context=(2, 12), keep=("label",))
    return x.select("train", "start", "end", "label", r("context").alias("context"), r(F.col("context") / F.col("q90"), 6).alias("context_contrast"))


#: All windows of up to ten intervals with their scores: w.
WINDOWS = """, b AS (SELECT *, list(CASE WHEN valid THEN isi END) OVER (PARTITION BY train ORDER BY idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS nx,
 list(isi) FILTER (valid) OVER (PARTITION BY train ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pv, list(isi) FILTER (valid) OVER (PARTITION BY train ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fv,
 list(isi) FILTER (valid) OVER (PARTITION BY train ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE CURRENT ROW) AS lo FROM s),
c AS (SELECT *, list_aggregate(pv[-5:], 'median') AS before, list_aggregate(fv[1:5], 'median') AS after, coalesce(valid AND isi <= list_aggregate(lo, 'median') / 1.1, false) AS short FROM b),
g AS (SELECT c.train, c.idx AS start, c.idx + k - 1 AS e, k, c.before, z.after, list_filter(c.nx[1:k], lambda x: x IS NOT NULL) AS vs FROM c, (SELECT unnest(range(1, 11)) AS k) JOIN c z ON z.train = c.train AND z.idx = c.idx + k - 1 WHERE c.idx >= 2),
m AS (SELECT *, len(vs) AS n, list_aggregate(vs, 'quantile_cont', 0.9) AS q90, list_max(vs) / list_avg(vs) AS mm, list_avg(list_transform(list_zip(vs[:-2], vs[2:]), lambda p: 3 * (p[1] - p[2]) ** 2 / (p[1] + p[2]) ** 2)) AS lv FROM g WHERE len(vs) >= 1),
r AS (SELECT *, least(before, after) / q90 AS least, CASE WHEN before IS NOT NULL AND after IS NOT NULL THEN sqrt(before * after) ELSE coalesce(before, after) END / q90 AS geo, CASE WHEN before IS NOT NULL AND after IS NOT NULL THEN (before + after) / 2 ELSE coalesce(before, after) END / q90 AS comp FROM m),
w AS (SELECT *, ln(geo) + 0.1 * ln(k + 1) + 0.1 * ln(comp) - 0.1 * greatest(0, mm - 2.5) - 0.05 * greatest(0, coalesce(lv, 0) - 1.5) AS score FROM r WHERE geo IS NOT NULL),
pr AS (SELECT w.train, w.start, w.e, w.k FROM w WHERE k BETWEEN 2 AND 8 AND n = k AND before IS NOT NULL AND after IS NOT NULL AND least >= 1.2 AND geo >= 1.3 AND EXISTS (SELECT 1 FROM c WHERE c.train = w.train AND c.idx BETWEEN w.start AND w.e AND short))"""


@query(f"""{WINDOWS} SELECT train, start, e AS "end" FROM pr""")
def context_windows(spark, d):
    return pp.context_windows(trains(spark, d))


@query(f"""{WINDOWS}, v AS (SELECT pr.train, pr.start, pr.e, w.start AS bs, w.e AS be, w.score, CASE WHEN before IS NULL OR after IS NULL THEN 'reject' WHEN least >= 1.8 AND geo >= 1.8 AND score >= 0.65 THEN 'burst' WHEN least >= 1.25 AND geo >= 1.35 AND score >= 0.35 THEN 'possible_burst' ELSE 'reject' END AS class,
 row_number() OVER (PARTITION BY pr.train, pr.start, pr.e ORDER BY score DESC, w.start, w.e) AS i FROM pr JOIN w ON w.train = pr.train AND abs(w.start - pr.start) <= 1 AND abs(w.e - pr.e) <= 1 AND w.k >= 2 AND w.n >= 2)
SELECT train, start, e AS "end", bs AS best_start, be AS best_end, round(score, 6) AS score, class FROM v WHERE i = 1""")
def optimised_boundaries(spark, d):
    rows = pp.surrounded(trains(spark, d))
    return rounded(pp.optimised(rows, stored(pp.context_windows(rows), "context-windows")), 6)


@query()
def sliding_context_bursts(spark, d):
    return rounded(pp.sliding_context(trains(spark, d)))


@query(""", bu AS (SELECT *, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM s WHERE auto = 'burst'), pa AS (SELECT train, min(idx) AS bs, max(idx) AS be, quantile_cont(isi, 0.5) FILTER (valid) AS bm, quantile_cont(isi, 0.9) FILTER (valid) AS bq FROM bu GROUP BY train, run),
la AS (SELECT train, max(idx) AS last FROM s GROUP BY train),
ch AS (SELECT pa.*, side, k AS width, CASE WHEN side = 'regular_before_burst' THEN bs - k ELSE be + 1 END AS a, last FROM pa JOIN la USING (train), (SELECT unnest(range(4, 17)) AS k), (SELECT unnest(['regular_before_burst', 'regular_after_burst']) AS side)),
i AS (SELECT ch.*, s.isi, s.valid, s.auto, lag(s.isi) OVER (PARTITION BY ch.train, bs, side, width ORDER BY s.idx) AS p FROM ch JOIN s ON s.train = ch.train AND s.idx BETWEEN a AND a + width - 1 WHERE a >= 3 AND a + width - 1 <= last - 1),
m AS (SELECT train, bs, be, bm, bq, side, width, a, quantile_cont(isi, 0.1) AS q10, quantile_cont(isi, 0.5) AS q50, quantile_cont(isi, 0.9) AS q90, stddev_samp(isi) / avg(isi) AS cv, avg(3 * (p - isi) ** 2 / (p + isi) ** 2) AS lv, max(isi) / avg(isi) AS mm
 FROM i GROUP BY ALL HAVING count(*) FILTER (valid) = width AND count(*) FILTER (auto IN ('burst', 'long_burst', 'possible_burst')) = 0),
f AS (SELECT *, 2.2 - cv - 0.7 * lv - 0.25 * greatest(0, mm - 1) + 0.08 * ln(width + 1) + 0.35 * ln(greatest(1.01, q90 / bq)) + 0.2 AS score FROM m WHERE q10 >= 0.012 AND q90 <= 0.06 AND cv <= 0.45 AND lv <= 0.6 AND mm <= 1.65 AND q90 / q10 <= 2.4 AND q90 / bq >= 1.35)
SELECT train, bs AS burst_start, be AS burst_end, 'burst' AS burst_label, side, a AS start, a + width - 1 AS "end", round(q90, 6) AS q90, round(cv, 6) AS cv, round(lv, 6) AS lv, round(q50 / bm, 6) AS ratio_median, round(q90 / bq, 6) AS ratio_q90, round(score, 6) AS score
 FROM f QUALIFY row_number() OVER (PARTITION BY train, bs, side ORDER BY score DESC, a, width) = 1""")
def regular_packets(spark, d):
    """Packets right beside bursts, each with its burst. Without a gap all packets of a burst and side overlap, so one is left of each."""
    x = pp.regular_packets(labelled(trains(spark, d)))
    return rounded(x.select("train", "burst_start", "burst_end", "burst_label", "side", "start", "end", "q90", "cv", "lv", "ratio_median", "ratio_q90", "score"), 6)


#: SQL: seeds (sd) with their scale, what lies between neighbours (br) and what becomes of it (bc).
SEED_BRIDGES = """, sr AS (SELECT *, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM s WHERE valid AND isi <= 0.02), sl AS (SELECT *, lag(isi) OVER (PARTITION BY train, run ORDER BY idx) AS p FROM sr),
s0 AS (SELECT train, min(idx) AS start, max(idx) AS e, quantile_cont(isi, 0.9) AS q, max(isi) / avg(isi) AS mm, avg(3 * (p - isi) ** 2 / (p + isi) ** 2) AS lv FROM sl GROUP BY train, run),
sd AS (SELECT s0.train, start, e, q, mm, lv, 100.0 * count(*) FILTER (s.isi <= q) / count(*) AS pct FROM s0 JOIN s ON s.train = s0.train AND s.valid GROUP BY ALL),
nb AS (SELECT *, lead(start) OVER w AS s2, lead(e) OVER w AS e2, lead(q) OVER w AS q2, lead(mm) OVER w AS mm2, lead(lv) OVER w AS lv2, lead(pct) OVER w AS pct2 FROM sd WINDOW w AS (PARTITION BY train ORDER BY start)),
pc AS (SELECT train, idx, isi, 100 * cume_dist() OVER (PARTITION BY train ORDER BY isi) AS p FROM s WHERE valid),
mg AS (SELECT nb.train, nb.start, quantile_cont(s.isi, 0.9) AS mq FROM nb JOIN s ON s.train = nb.train AND s.valid AND s.idx BETWEEN nb.start AND nb.e2 WHERE s2 - e - 1 = 1 GROUP BY ALL),
br AS (SELECT nb.*, pc.isi AS gap_max, pc.p AS gap_pct, sqrt(x.isi * y.isi) / mq AS geo, greatest(1, least(1.25 * (1 + 0.15 * greatest(0, coalesce((lv + lv2) / 2, lv, lv2, 0) - 0.35) + 0.1 * greatest(0, coalesce((mm + mm2) / 2, 1) - 1.2)), 1.25 * 1.75)) AS inflate
 FROM nb JOIN pc ON pc.train = nb.train AND pc.idx = nb.e + 1 JOIN mg ON mg.train = nb.train AND mg.start = nb.start LEFT JOIN s x ON x.train = nb.train AND x.idx = nb.start - 1 LEFT JOIN s y ON y.train = nb.train AND y.idx = nb.e2 + 1 WHERE s2 - e - 1 = 1),
bc AS (SELECT *, greatest(q, q2) * inflate AS ref, gap_max / (greatest(q, q2) * inflate) AS ratio, gap_pct <= least(100, greatest(greatest(pct, pct2) + 10, 35)) AS low FROM br),
bk AS (SELECT *, CASE WHEN low AND ratio <= 3.5 THEN 'accepted' WHEN low AND ratio <= 5 THEN 'possible' ELSE 'reject' END AS class, -ln(ratio) + coalesce(ln(geo), 0) + 0.05 * ln(ref / gap_max) - 0.005 * greatest(0, gap_pct - 35) AS score FROM bc)"""


def short_seeds(spark, d):
    from pulsegrid.operators.runs import runs

    rows = stored(trains(spark, d), "trains")
    return rows, stored(runs(rows, F.col("valid") & (F.col("isi") <= 0.02)).select("train", "start", "end"), "seeds")


@query(f"""{SEED_BRIDGES} SELECT train, start AS "left", s2 AS "right", 1 AS gap_n, round(gap_max, 9) AS gap_max, round(inflate, 9) AS inflate, round(ratio, 6) AS ratio, round(gap_pct, 6) AS pct, round(score, 6) AS score, class FROM bk""")
def seed_bridges(spark, d):
    x = pp.seed_bridges(*short_seeds(spark, d))
    return rounded(x.withColumns({c: r(c, 6) for c in ("ratio", "pct", "score")}))


@query(f"""{SEED_BRIDGES}, ch AS (SELECT sd.train, sd.start, sd.e, sum(CASE WHEN bk.class = 'accepted' THEN 0 ELSE 1 END) OVER (PARTITION BY sd.train ORDER BY sd.start) AS c FROM sd LEFT JOIN bk ON bk.train = sd.train AND bk.s2 = sd.start)
SELECT train, min(start) AS start, max(e) AS "end", count(*) AS seeds FROM ch GROUP BY train, c""")
def bridged_seeds(spark, d):
    rows, seeds = short_seeds(spark, d)
    return pp.bridged_seeds(seeds, pp.seed_bridges(rows, seeds))
