"""Queries over single detectors whose settings are data: each train's bounds are quantiles of its own intervals."""

from pyspark.sql import functions as F

from pulsegrid.functions.grammar import Grammar
from pulsegrid.operators import detectors as de
from pulsegrid.operators import ranges as ra
from pulsegrid.operators.bounds import Bounds
from pulsegrid.sources.events import trains
from pulsegrid.sources.shared import stored

from .registry import query, rounded

SHARES = {"seed_high": 0.2, "bridge": 0.3, "tonic_min": 0.35, "tonic_max": 0.8, "pause_min": 0.9, "hft_floor": 0.1, "hft_max": 0.45}
#: SQL: usable rows (u), settings (k) and what each train's references are (rf), as adaptive_floors has them.
REFERENCES = f""", u AS (SELECT *, isi IS NOT NULL AND NOT artifact AS ok FROM s), k AS (SELECT train, {", ".join(f"quantile_cont(isi, {p}) AS {c}" for c, p in SHARES.items())} FROM s WHERE valid GROUP BY train),
q AS (SELECT train, count(*) AS n, quantile_cont(isi, 0.1) AS q10, quantile_cont(isi, 0.5) AS q50, quantile_cont(isi, 0.75) AS q75, quantile_cont(isi, 0.9) AS q90 FROM u WHERE ok GROUP BY train),
a AS (SELECT *, greatest(seed_high, bridge) AS burst, greatest(pause_min, q90) AS base, CASE WHEN n < 6 THEN tonic_min ELSE greatest(0.0009, least(tonic_min, q10), greatest(seed_high, bridge) * 1.15) END AS lower FROM q JOIN k USING (train)),
b AS (SELECT *, greatest(tonic_max, q75 * 1.25, CASE WHEN q90 <= 1.5 * q75 THEN q90 * 1.02 END, lower * 1.5) AS high FROM a),
c AS (SELECT *, CASE WHEN base > 1.15 * q90 AND base > lower THEN least(high, base * 0.98) ELSE high END AS capped FROM b),
d AS (SELECT *, CASE WHEN n < 6 THEN tonic_max WHEN capped <= lower THEN greatest(tonic_max, q75, lower + 0.0009) ELSE capped END AS upper FROM c),
rf AS (SELECT *, CASE WHEN n >= 10 THEN greatest(base, upper * 1.15) ELSE base END AS floor, CASE WHEN greatest(lower, CASE WHEN n >= 6 THEN q75 * 0.65 END) > upper THEN lower ELSE greatest(lower, CASE WHEN n >= 6 THEN q75 * 0.65 END) END AS core_low FROM d)"""
#: SQL: measures (m) of the spans sp (train, start, e) over usable intervals, with the train's references.
MEASURES = """, i AS (SELECT sp.*, u.idx, u.isi, lag(u.isi) OVER (PARTITION BY sp.train, sp.start, sp.e ORDER BY u.idx) AS p FROM sp JOIN u ON u.train = sp.train AND u.ok AND u.idx BETWEEN sp.start AND sp.e),
m0 AS (SELECT i.train, start, e, count(*) AS n_isi, avg(isi) AS mean, sum(isi) AS duration, quantile_cont(isi, 0.1) AS s10, quantile_cont(isi, 0.5) AS s50, quantile_cont(isi, 0.9) AS s90, quantile_cont(isi, 0.95) AS s95, stddev_samp(isi) / avg(isi) AS cv, max(isi) / avg(isi) AS mm, avg(3 * (p - isi) ** 2 / (p + isi) ** 2) AS lv,
 count(*) FILTER (isi <= burst) AS within, count(*) FILTER (isi BETWEEN 0.001 AND seed_high) AS seeds, count(*) FILTER (isi < hft_floor) AS low, count(*) FILTER (isi BETWEEN 0.001 AND seed_high AND p BETWEEN 0.001 AND seed_high) AS pairs,
 count(*) FILTER (isi <= seed_high) AS core, count(*) FILTER (isi > seed_high AND isi <= bridge) AS bridges FROM i JOIN rf USING (train) GROUP BY i.train, start, e),
m AS (SELECT m0.*, x.isi AS pre, y.isi AS post, rf.* EXCLUDE (train, n) FROM m0 JOIN rf USING (train) LEFT JOIN u x ON x.train = m0.train AND x.idx = m0.start - 1 LEFT JOIN u y ON y.train = m0.train AND y.idx = m0.e + 1)"""


def prepared(spark, d):
    rows = stored(de.usable(trains(spark, d)), "trains")
    g = Bounds(stored(ra.quantile_settings(trains(spark, d), SHARES), "settings"), Grammar())
    return rows, de.references(rows, g), g


@query(f", k AS (SELECT train, {', '.join(f'round(quantile_cont(isi, {p}), 9) AS {c}' for c, p in SHARES.items())} FROM s WHERE valid GROUP BY train) SELECT * FROM k")
def quantile_settings(spark, d):
    return rounded(ra.quantile_settings(trains(spark, d), SHARES))


@query(f"""{REFERENCES}, fl AS (SELECT u.*, ok AND isi BETWEEN lower AND upper AS f, ok AND isi BETWEEN lower AND upper AND isi >= core_low AS g FROM u JOIN rf USING (train)),
full_ AS (SELECT train, min(idx) AS start, max(idx) AS e FROM (SELECT *, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM fl WHERE f) GROUP BY train, run),
core_ AS (SELECT train, min(idx) AS start, max(idx) AS e FROM (SELECT *, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM fl WHERE g) GROUP BY train, run),
nm AS (SELECT *, 'tonic' AS gate FROM full_ UNION ALL SELECT *, 'tonic_core' FROM (SELECT * FROM core_ EXCEPT SELECT * FROM full_)), sp AS (SELECT train, start, e FROM nm WHERE e - start + 2 >= 5){MEASURES}
SELECT m.train, m.start, m.e AS "end", gate, n_isi, round(s90, 9) AS q90, round(cv, 9) AS cv, round(3 + coalesce(1 / (1 + lv), 0), 9) AS score, CASE WHEN gate = 'tonic' THEN 350.0 ELSE 340.0 END::DOUBLE AS priority FROM m JOIN nm ON nm.train = m.train AND nm.start = m.start AND nm.e = m.e
 WHERE mean > burst * 1.15 AND s50 > burst * 1.15 AND s10 > burst AND within / n_isi <= 0.05 AND (lv IS NULL OR lv <= 0.5) AND mm >= 0.85 AND mm <= CASE WHEN lv <= 0.15 AND cv <= 0.3 THEN 1.4 ELSE 1.25 END AND seeds / n_isi <= 0.2""")
def tonic_candidates(spark, d):
    return rounded(de.tonic(*prepared(spark, d)).select("train", "start", "end", "gate", "n_isi", "q90", "cv", "score", "priority"))


@query(f"""{REFERENCES}, sp AS (SELECT train, min(idx) AS start, max(idx) AS e FROM (SELECT u.*, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM u JOIN rf USING (train) WHERE ok AND isi <= hft_max) GROUP BY train, run HAVING max(idx) - min(idx) + 2 >= 6){MEASURES}
SELECT train, start, e AS "end", n_isi, round(lv, 9) AS lv, round(mm, 9) AS mm, round(5 + (1 - low / n_isi) + coalesce(1 / (1 + cv), 0), 9) AS score FROM m WHERE s90 <= hft_max AND (s10 >= hft_floor OR low / n_isi <= 0.05) AND pairs = 0 AND coalesce(cv, 0) <= 0.6 AND coalesce(lv, 0) <= 0.6 AND mm <= 2""")
def high_frequency_tonic_candidates(spark, d):
    return rounded(de.high_frequency_tonic(*prepared(spark, d)).select("train", "start", "end", "n_isi", "lv", "mm", "score"))


@query(f"""{REFERENCES}, l AS (SELECT u.*, ok AND isi >= floor AS long, floor, q50, n FROM u JOIN rf USING (train)),
o AS (SELECT a.train, a.idx, coalesce(quantile_cont(b.isi, 0.5) FILTER (NOT b.long), quantile_cont(b.isi, 0.5) FILTER (b.idx <> a.idx)) AS med FROM l a JOIN l b ON b.train = a.train AND b.ok AND b.idx BETWEEN a.idx - 11 AND a.idx + 11 WHERE a.long GROUP BY ALL),
f AS (SELECT l.*, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM l JOIN o USING (train, idx) WHERE n < 6 OR ((med IS NULL OR isi >= med * 1.55) AND isi >= q50 * 1.25))
SELECT train, min(idx) AS start, max(idx) AS "end", count(*) AS n_isi, round(max(isi) / any_value(floor), 9) AS score FROM f GROUP BY train, run""")
def pause_candidates(spark, d):
    return rounded(de.pauses(*prepared(spark, d)).select("train", "start", "end", "n_isi", "score"))


@query(f"""{REFERENCES}, br AS (SELECT u.train, idx, isi, (ok AND isi <= bridge)::INT AS b, ok AND isi BETWEEN 0.001 AND seed_high AS seed FROM u JOIN rf USING (train)),
ex AS (SELECT *, {" + ".join("*".join(f"coalesce(lag(b, {j}) OVER w, 0)" for j in range(1, k + 1)) for k in range(1, 5))} AS l, {" + ".join("*".join(f"coalesce(lead(b, {j}) OVER w, 0)" for j in range(1, k + 1)) for k in range(1, 5))} AS r FROM br WINDOW w AS (PARTITION BY train ORDER BY idx)),
se AS (SELECT train, min(idx) AS a, max(idx) AS z FROM (SELECT *, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM br WHERE seed) GROUP BY train, run HAVING count(*) >= 2),
sp AS (SELECT DISTINCT se.train, a - x AS start, z + y AS e FROM se JOIN ex f ON f.train = se.train AND f.idx = a JOIN ex g ON g.train = se.train AND g.idx = z, (SELECT unnest(range(0, 5)) AS x), (SELECT unnest(range(0, 5)) AS y) WHERE x <= f.l AND y <= g.r AND z + y - (a - x) + 2 >= 3){MEASURES},
t AS (SELECT *, pre / s90 AS ra, post / s90 AS rb, least(pre / s90, post / s90) AS contrast, core / n_isi AS purity, bridges / n_isi AS share, s95 / bridge AS excess, e - start + 2 AS spikes, greatest(q75, pre, post) / s90 AS scale FROM m),
h AS (SELECT *, bridges <= 4 AND share <= 0.6 AND s90 <= bridge AND excess <= 1.35 AS passed, coalesce(ra >= 2.5 AND rb >= 2.5, false) AS two, coalesce(ra >= 2 AND rb >= 2, false) AS maybe, (coalesce(ra >= 3, false) OR coalesce(rb >= 3, false)) AND purity >= 0.65 AND share <= 0.35 AS clean,
 purity >= 0.7 AND (cv IS NULL OR cv <= 0.8) AND coalesce(scale >= 3, false) AS rescue, coalesce(scale >= 4, false) AS strong, CASE WHEN spikes <= 10 THEN 'burst' WHEN spikes <= 15 THEN 'long_burst' ELSE 'prolonged' END AS size FROM t),
gt AS (SELECT *, CASE WHEN passed AND two AND size <> 'prolonged' THEN 'two_sided' WHEN passed AND two THEN 'prolonged' WHEN passed AND clean THEN CASE WHEN ra IS NULL OR rb IS NULL THEN 'edge_limited' ELSE 'one_sided' END WHEN passed AND maybe THEN 'possible_two_sided'
 WHEN passed AND rescue AND strong AND size <> 'prolonged' THEN 'rescue' WHEN passed AND rescue THEN 'possible_rescue' ELSE 'reject' END AS gate FROM h),
pp AS (SELECT *, least(greatest(260 + 180 * least(1.5, coalesce(contrast, 0) / 2.5) + 120 * least(1.0, purity) + 20 * least(5, core) + CASE WHEN gate IN ('prolonged', 'possible_two_sided') THEN 80 WHEN gate IN ('edge_limited', 'one_sided') THEN 50 ELSE 0 END
 - CASE WHEN excess > 1 THEN 60 * least(2.0, excess - 1) ELSE 0 END - 120 * greatest(0.0, share - 0.35), 180), 760) AS maybe_priority FROM gt)
SELECT train, start, e AS "end", gate, CASE WHEN gate IN ('two_sided', 'rescue') THEN size WHEN gate = 'reject' THEN 'reject' ELSE 'possible_burst' END AS label, CASE WHEN gate IN ('two_sided', 'rescue') THEN 'accept' WHEN gate = 'reject' THEN 'reject' ELSE 'demote_to_possible' END AS action, n_isi,
 round(CASE WHEN gate = 'two_sided' THEN CASE WHEN size = 'burst' THEN 1250 ELSE 1160 END WHEN gate = 'rescue' THEN CASE WHEN size = 'burst' THEN 1010 ELSE 960 END WHEN gate = 'reject' THEN 0 ELSE maybe_priority END, 6)::DOUBLE AS priority,
 round(coalesce(contrast, 0) + 0.16 * core + 0.35 * purity - 0.2 * bridges - 0.45 * share - CASE WHEN excess > 1 THEN 0.45 * least(2.0, excess - 1) ELSE 0 END, 6) AS score FROM pp""")
def burst_candidates(spark, d):
    found = de.bursts(*prepared(spark, d)).where("layer = 'burst'")
    return rounded(found.select("train", "start", "end", "gate", "label", "action", "n_isi", "priority", "score"), 6)


@query()
def labels_by_train_settings(spark, d):
    """The whole chain with bounds of each train's own."""
    from pulsegrid.sources.events import labelled

    rows = stored(labelled(trains(spark, d)), "labelled")
    return de.detect(rows, stored(ra.quantile_settings(rows, SHARES), "settings"), kept=True)[0].select("train", "idx", "auto")


def near(spark, d, layer):
    rows, _, g = prepared(spark, d)
    return rounded(de.gate_near_misses(rows, g, layers=(layer,)), 6)


#: SQL: of misses (by, gate) the largest, by share and then by name.
MISSED = "list_max(list_filter(ms, lambda s: s.by > 0))"


@query(f"""{REFERENCES}, sp AS (SELECT train, min(idx) AS start, max(idx) AS e FROM (SELECT u.*, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM u JOIN rf USING (train) WHERE ok AND isi BETWEEN lower AND upper) GROUP BY train, run HAVING max(idx) - min(idx) + 2 >= 5){MEASURES},
w AS (SELECT *, [{{'by': CASE WHEN mean > burst * 1.15 THEN 0 ELSE abs(mean - burst * 1.15) / (burst * 1.15) END, 'gate': 'mean'}}, {{'by': CASE WHEN s50 > burst * 1.15 THEN 0 ELSE abs(s50 - burst * 1.15) / (burst * 1.15) END, 'gate': 'median'}},
 {{'by': CASE WHEN s10 > burst THEN 0 ELSE abs(s10 - burst) / burst END, 'gate': 'low_quantile'}}, {{'by': CASE WHEN within / n_isi <= 0.05 THEN 0 ELSE (within / n_isi - 0.05) / 0.05 END, 'gate': 'low_share'}}, {{'by': CASE WHEN lv > 0.5 THEN (lv - 0.5) / 0.5 ELSE 0 END, 'gate': 'lv'}},
 {{'by': CASE WHEN mm > CASE WHEN lv <= 0.15 AND cv <= 0.3 THEN 1.4 ELSE 1.25 END THEN mm / CASE WHEN lv <= 0.15 AND cv <= 0.3 THEN 1.4 ELSE 1.25 END - 1 ELSE 0 END, 'gate': 'mm_high'}}, {{'by': CASE WHEN mm < 0.85 THEN 1 - mm / 0.85 ELSE 0 END, 'gate': 'mm_low'}},
 {{'by': CASE WHEN seeds / n_isi > 0.2 THEN (seeds / n_isi - 0.2) / 0.2 ELSE 0 END, 'gate': 'seed_share'}}] AS ms FROM m)
SELECT train, start, e AS "end", 'tonic' AS layer, {MISSED}.gate AS gate, round({MISSED}.by, 6) AS "by", len(list_filter(ms, lambda s: s.by > 0))::INT AS failed FROM w WHERE {MISSED}.by <= 0.25""")
def tonic_near_misses(spark, d):
    return near(spark, d, "tonic")


@query(f"""{REFERENCES}, l AS (SELECT u.*, ok AND isi >= floor AS long, floor, q50, n FROM u JOIN rf USING (train)),
o AS (SELECT a.train, a.idx, coalesce(quantile_cont(b.isi, 0.5) FILTER (NOT b.long AND b.idx <> a.idx), quantile_cont(b.isi, 0.5) FILTER (b.idx <> a.idx)) AS med FROM l a JOIN l b ON b.train = a.train AND b.ok AND b.idx BETWEEN a.idx - 11 AND a.idx + 11 WHERE a.ok AND a.isi >= a.floor * 0.75 GROUP BY ALL),
w AS (SELECT l.*, [{{'by': CASE WHEN isi >= floor THEN 0 ELSE (floor - isi) / floor END, 'gate': 'floor'}}, {{'by': CASE WHEN n >= 6 AND isi < med * 1.55 THEN 1 - isi / (med * 1.55) ELSE 0 END, 'gate': 'surroundings'}},
 {{'by': CASE WHEN n >= 6 AND isi < q50 * 1.25 THEN 1 - isi / (q50 * 1.25) ELSE 0 END, 'gate': 'median'}}] AS ms FROM l JOIN o USING (train, idx))
SELECT train, idx AS start, idx AS "end", 'pause' AS layer, {MISSED}.gate AS gate, round({MISSED}.by, 6) AS "by", len(list_filter(ms, lambda s: s.by > 0))::INT AS failed FROM w WHERE {MISSED}.by <= 0.25""")
def pause_near_misses(spark, d):
    return near(spark, d, "pause")


@query(f"""{REFERENCES}, sp AS (SELECT train, min(idx) AS start, max(idx) AS e FROM (SELECT u.*, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM u JOIN rf USING (train) WHERE ok AND isi <= hft_max) GROUP BY train, run HAVING max(idx) - min(idx) + 2 >= 6){MEASURES},
w AS (SELECT *, [{{'by': CASE WHEN s90 <= hft_max THEN 0 ELSE s90 / hft_max - 1 END, 'gate': 'q90'}}, {{'by': least(CASE WHEN s10 >= hft_floor THEN 0 ELSE 1 - s10 / hft_floor END, CASE WHEN low / n_isi <= 0.05 THEN 0 ELSE (low / n_isi - 0.05) / 0.05 END), 'gate': 'low_tail'}}, {{'by': CASE WHEN pairs > 0 THEN 1.0 ELSE 0 END, 'gate': 'seed_run'}},
 {{'by': CASE WHEN cv > 0.6 THEN (cv - 0.6) / 0.6 ELSE 0 END, 'gate': 'cv'}}, {{'by': CASE WHEN lv > 0.6 THEN (lv - 0.6) / 0.6 ELSE 0 END, 'gate': 'lv'}}, {{'by': CASE WHEN mm > 2 THEN (mm - 2) / 2 ELSE 0 END, 'gate': 'mm'}}] AS ms FROM m WHERE pairs = 0)
SELECT train, start, e AS "end", 'hf_tonic' AS layer, {MISSED}.gate AS gate, round({MISSED}.by, 6) AS "by", len(list_filter(ms, lambda s: s.by > 0))::INT AS failed FROM w WHERE {MISSED}.by <= 0.25""")
def high_frequency_tonic_near_misses(spark, d):
    """Runs with two seeds in a row are none: that gate's limit of one would have to double."""
    return near(spark, d, "hf_tonic")


@query()
def gate_near_misses(spark, d):
    """Near misses of every layer, with bounds of each train's own."""
    rows, _, g = prepared(spark, d)
    return rounded(de.gate_near_misses(rows, g), 6)
