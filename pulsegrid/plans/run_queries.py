"""Queries over runs, segments and windows."""

from pyspark.sql import functions as F

from pulsegrid.operators import isi, runs
from pulsegrid.sources.events import labelled, trains

from .registry import query, rounded

#: SQL: islands of flagged rows of s (a CTE named f with train, idx and further columns).
ISLANDS = "SELECT *, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM s WHERE"


@query(f""", f AS ({ISLANDS} coalesce(isi <= 0.02, false))
SELECT train, min(idx) AS start, max(idx) AS "end", count(*) AS n FROM f GROUP BY train, run""")
def boolean_runs(spark, d):
    return runs.runs(trains(spark, d), F.col("isi") <= 0.02)


@query(""", c AS (SELECT *, CASE WHEN auto = lag(auto) OVER w THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY train ORDER BY idx)),
g AS (SELECT *, sum(new) OVER (PARTITION BY train ORDER BY idx) AS run FROM c)
SELECT train, auto AS label, min(idx) AS start, max(idx) AS "end", count(*) AS n, round(sum(isi), 9) AS dwell FROM g GROUP BY train, run, auto""")
def label_segments(spark, d):
    return rounded(runs.segments(labelled(trains(spark, d)), F.col("auto"), F.sum("isi").alias("dwell")))


@query(f""", f AS ({ISLANDS} coalesce(isi > 0.03, false)), n AS (SELECT train, count(*) AS n FROM f GROUP BY train, run)
SELECT train, coalesce(max(n), 0) AS longest FROM (SELECT DISTINCT train FROM s) LEFT JOIN n USING (train) GROUP BY train""")
def longest_true_run(spark, d):
    return runs.longest_run(trains(spark, d), F.col("isi") > 0.03)


@query(""", p AS (SELECT *, CASE WHEN valid THEN 100 * cume_dist() OVER (PARTITION BY train, valid ORDER BY isi) END AS pct FROM s),
f AS (SELECT *, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM p WHERE valid AND (isi <= 0.012 OR pct <= 30))
SELECT train, min(idx) AS start, max(idx) AS "end", count(*) AS n, round(avg(isi), 9) AS mean_isi, round(max(isi), 9) AS max_isi FROM f GROUP BY train, run HAVING count(*) >= 2""")
def short_isi_runs(spark, d):
    return rounded(runs.short_runs(isi.percentile_rank(trains(spark, d)), 0.012, 30.0))


@query(f""", f AS ({ISLANDS} valid AND isi < 0.015)
SELECT train, min(idx) AS start, max(idx) AS "end", count(*) AS n FROM f GROUP BY train, run""")
def runs_below_threshold(spark, d):
    return runs.runs(trains(spark, d), F.col("valid") & (F.col("isi") < 0.015))


@query(f""", f AS ({ISLANDS} valid AND isi <= 0.03)
SELECT train, min(idx) AS start, max(idx) AS "end", count(*) AS n, round(quantile_cont(isi, 0.9), 9) AS q90 FROM f GROUP BY train, run HAVING count(*) >= 3""")
def hard_threshold_runs(spark, d):
    from pulsegrid.functions.stats import q

    return rounded(runs.runs(trains(spark, d), F.col("valid") & (F.col("isi") <= 0.03), q("isi", 0.9).alias("q90"), least=3))


@query(""", r AS (SELECT train, idx, 100 * cume_dist() OVER (PARTITION BY train ORDER BY isi) AS pct FROM s WHERE valid),
w AS (SELECT p.train, p.idx + 1 AS start, k AS width, p.isi AS pre, x.isi AS post FROM s p, (SELECT unnest(range(2, 9)) AS k), s x WHERE p.isi IS NOT NULL AND x.train = p.train AND x.idx = p.idx + k + 1),
g AS (SELECT w.train, w.start, w.width, any_value(pre) AS pre, any_value(post) AS post, quantile_cont(b.isi, 0.9) FILTER (b.valid) AS q90, max(pct) AS top FROM w JOIN s b ON b.train = w.train AND b.idx BETWEEN w.start AND w.start + w.width - 1 LEFT JOIN r ON r.train = b.train AND r.idx = b.idx GROUP BY w.train, w.start, w.width)
SELECT train, start, start + width - 1 AS "end", width::INT AS width, round(q90, 9) AS q90, round(top, 6) AS max_pct, round(least(pre, post) / q90, 6) AS least, round(sqrt(pre * post) / q90, 6) AS geometric
FROM g WHERE (q90 <= 0.03 OR top <= 45) AND least(pre, post) / q90 >= 1.2 AND sqrt(pre * post) / q90 >= 1.5""")
def structure_scan(spark, d):
    from pulsegrid.operators.isi import percentile_rank

    from .registry import r

    x = runs.structure_scan(percentile_rank(trains(spark, d)), (2, 8), 0.03, 45.0, 1.2, 1.5)
    return x.select("train", "start", "end", "width", r("q90").alias("q90"), r("max_pct", 6).alias("max_pct"), r("least", 6).alias("least"), r("geometric", 6).alias("geometric"))


@query(f""", f AS ({ISLANDS} valid AND isi <= 0.03), a AS (SELECT train, min(idx) AS start, max(idx) AS e FROM f GROUP BY train, run),
x AS (SELECT train, greatest(start - 1, 1) AS start, e + 1 AS e FROM a),
b AS (SELECT *, max(e) OVER (PARTITION BY train ORDER BY start, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
c AS (SELECT *, sum(CASE WHEN m IS NULL OR start > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY train ORDER BY start, e) AS run FROM b)
SELECT train, min(start) AS start, max(e) AS "end", count(*) AS parts FROM c GROUP BY train, run""")
def interval_union(spark, d):
    some = runs.runs(trains(spark, d), F.col("valid") & (F.col("isi") <= 0.03))
    return runs.unions(some.select("train", F.greatest(F.col("start") - 1, F.lit(1)).alias("start"), (F.col("end") + 1).alias("end")))


@query(f""", f AS ({ISLANDS} valid AND isi <= 0.01), a AS (SELECT train, min(idx) AS start, max(idx) AS e FROM f GROUP BY train, run HAVING count(*) >= 2),
l AS (SELECT a.train, a.start, a.e, i FROM a, (SELECT unnest(range(0, 5)) AS i) WHERE i = (SELECT count(*) FROM s WHERE s.train = a.train AND s.idx BETWEEN a.start - i AND a.start - 1 AND valid AND isi <= 0.025)),
r AS (SELECT a.train, a.start, a.e, j FROM a, (SELECT unnest(range(0, 5)) AS j) WHERE j = (SELECT count(*) FROM s WHERE s.train = a.train AND s.idx BETWEEN a.e + 1 AND a.e + j AND valid AND isi <= 0.025))
SELECT l.train, l.start, l.e AS "end", l.start - i AS s, l.e + j AS e FROM l JOIN r ON l.train = r.train AND l.start = r.start""")
def run_extensions(spark, d):
    rows = trains(spark, d)
    seeds = runs.runs(rows, F.col("valid") & (F.col("isi") <= 0.01), least=2).select("train", "start", "end")
    return runs.extensions(rows, seeds, 0.025)


@query(f""", f AS ({ISLANDS} valid AND isi <= 0.03), a AS (SELECT train, min(idx) AS start, max(idx) AS e FROM f GROUP BY train, run)
SELECT train, start AS block, start + k * 8 AS start, least(start + k * 8 + 7, e) AS "end" FROM (SELECT *, unnest(range(0, (e - start) // 8 + 1)) AS k FROM a)""")
def run_tiles(spark, d):
    return runs.tiles(runs.runs(trains(spark, d), F.col("valid") & (F.col("isi") <= 0.03)).select("train", "start", "end"))


@query(""", x AS (SELECT *, valid AND isi <= 0.02 AS sup, coalesce(valid AND isi <= 0.04, false) AS ok FROM s),
y AS (SELECT *, max(CASE WHEN sup THEN idx END) OVER a AS p, min(CASE WHEN sup THEN idx END) OVER z AS n FROM x
 WINDOW a AS (PARTITION BY train ORDER BY idx ROWS UNBOUNDED PRECEDING), z AS (PARTITION BY train ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT y.*, idx - row_number() OVER (PARTITION BY train ORDER BY idx) AS run FROM y WHERE sup OR (n - p - 1 <= 3 AND
 NOT EXISTS (SELECT 1 FROM x WHERE x.train = y.train AND x.idx > y.p AND x.idx < y.n AND NOT x.ok)))
SELECT train, min(idx) AS start, max(idx) AS "end", count(*) AS n, count(*) FILTER (sup) AS support, round(max(isi), 9) AS max_isi, round(sum(isi), 9) AS duration FROM f GROUP BY train, run HAVING count(*) >= 3""")
def support_run_merge(spark, d):
    return rounded(runs.support_runs(trains(spark, d), F.col("isi") <= 0.02, 0.04, 0.05, most=3, least=3))


@query(f""", f AS ({ISLANDS} valid AND isi <= 0.02), a AS (SELECT train, min(idx) AS start, max(idx) AS e, row_number() OVER (PARTITION BY train ORDER BY min(idx)) AS k FROM f GROUP BY train, run),
m AS (WITH RECURSIVE g AS (SELECT train, k, start AS s0, e AS e0, 1 AS parts, 1 AS block FROM a WHERE k = 1
 UNION ALL SELECT a.train, a.k, CASE WHEN j THEN s0 ELSE a.start END, CASE WHEN j THEN greatest(e0, a.e) ELSE a.e END, CASE WHEN j THEN parts + 1 ELSE 1 END, CASE WHEN j THEN block ELSE block + 1 END
 FROM (SELECT g.*, a.start - g.e0 - 1 <= 2 AND a.e - g.s0 < 12 AS j, a.k AS k2 FROM g JOIN a ON a.train = g.train AND a.k = g.k + 1) q JOIN a ON a.train = q.train AND a.k = q.k2) SELECT * FROM g)
SELECT train, min(s0)::BIGINT AS start, max(e0)::BIGINT AS "end", max(parts)::BIGINT AS parts FROM m GROUP BY train, block""")
def block_merge(spark, d):
    blocks = runs.runs(trains(spark, d), F.col("valid") & (F.col("isi") <= 0.02)).select("train", "start", "end")
    return runs.merged_blocks(blocks, lambda s, e, a, b: a - e - 1 <= 2 and b - s < 12)
