"""Queries over models of states."""

from pyspark.sql import functions as F

from pulsegrid.operators import dynamics as dy
from pulsegrid.operators import guardrails as gr
from pulsegrid.operators import isi
from pulsegrid.operators import manifold as mf
from pulsegrid.operators import models as mo
from pulsegrid.operators import surrogates as su
from pulsegrid.sources.events import labelled, trains
from pulsegrid.sources.shared import stored

from .dynamics_queries import STATES, states
from .registry import query, rounded

FEATURES = ["isi_log", "local_cv", "log_ratio", "cv2"]
#: Trains that the embeddings compare all with all; the others are placed among them.
LANDMARKS = 900


def feature_rows(spark, d):
    return isi.state_features(labelled(trains(spark, d))).withColumn("isi_log", F.log10("isi")).select("train", "idx", "auto", *FEATURES).na.drop()


@query("""SELECT train, idx, CASE WHEN isi <= quantile_cont(isi, 0.25) OVER w THEN 'fast' WHEN isi >= quantile_cont(isi, 0.75) OVER w THEN 'slow' ELSE 'medium' END AS state FROM s WHERE valid WINDOW w AS (PARTITION BY train)""")
def rule_states(spark, d):
    return mo.rule_states(trains(spark, d)).select("train", "idx", "state")


@query()
def mixture_states(spark, d):
    x = trains(spark, d).where("valid").select("train", "idx", F.log10("isi").alias("x"))
    return mo.mixture_states(x, ["x"]).select("train", "idx", "state")


@query()
def semi_markov_states(spark, d):
    return mo.semi_markov(trains(spark, d), [-2.2, -1.5, -1.0], 0.35, [4.0, 8.0, 3.0])


@query(""", p AS (SELECT train, row_number() OVER (PARTITION BY train ORDER BY idx) AS i, log10(isi) AS x FROM s WHERE valid), r AS (SELECT a.train, a.i, b.i AS j FROM p a JOIN p b ON a.train = b.train AND a.i <> b.i AND abs(a.x - b.x) <= 0.1),
d AS (SELECT train, k, i - row_number() OVER (PARTITION BY train, k ORDER BY i) AS run FROM (SELECT *, j - i AS k FROM r)), dl AS (SELECT train, count(*) AS n FROM d GROUP BY train, k, run HAVING count(*) >= 2),
v AS (SELECT train, i, j - row_number() OVER (PARTITION BY train, i ORDER BY j) AS run FROM r), vl AS (SELECT train, count(*) AS n FROM v GROUP BY train, i, run HAVING count(*) >= 2),
n AS (SELECT train, count(*) AS n FROM p GROUP BY train), t AS (SELECT train, count(*) AS points FROM r GROUP BY train)
SELECT n.train, n.n, round(points / (n.n * (n.n - 1)), 9) AS recurrence, round(coalesce((SELECT sum(n) FROM dl WHERE dl.train = n.train), 0) / points, 9) AS determinism,
 round(coalesce((SELECT sum(n) FROM vl WHERE vl.train = n.train), 0) / points, 9) AS laminarity, round((SELECT avg(n) FROM vl WHERE vl.train = n.train), 9) AS trapping FROM n JOIN t USING (train)""")
def recurrence_measures(spark, d):
    x = trains(spark, d).where("valid").select("train", F.row_number().over(isi.in_train()).alias("i"), F.log10("isi").alias("x"))
    return rounded(mo.recurrence_measures(x, "x", 0.1))


@query(""", p AS (SELECT train, row_number() OVER (PARTITION BY train ORDER BY idx) AS i, log10(isi) AS x FROM s WHERE valid), r AS (SELECT a.train, a.i, b.i AS j FROM p a JOIN p b ON a.train = b.train AND a.i <> b.i AND abs(a.x - b.x) <= 0.1),
d AS (SELECT train, k, i - row_number() OVER (PARTITION BY train, k ORDER BY i) AS run FROM (SELECT *, j - i AS k FROM r)), l AS (SELECT train, count(*) AS length FROM d GROUP BY train, k, run HAVING count(*) >= 2),
c AS (SELECT train, length, count(*) AS n FROM l GROUP BY ALL), e AS (SELECT train, sum(n) AS lines, -sum(q * log2(q)) AS h FROM (SELECT *, n / sum(n) OVER (PARTITION BY train) AS q FROM c) GROUP BY train)
SELECT t.train, coalesce(lines, 0)::BIGINT AS lines, round(h, 9) + 0 AS entropy FROM (SELECT DISTINCT train FROM p) t LEFT JOIN e USING (train)""")
def recurrence_line_entropy(spark, d):
    x = trains(spark, d).where("valid").select("train", F.row_number().over(isi.in_train()).alias("i"), F.log10("isi").alias("x"))
    return rounded(mo.line_entropy(x, "x", 0.1)).withColumn("entropy", F.col("entropy") + 0.0)


@query(f"{STATES} SELECT g::INT AS surrogate, train, state, count(*) AS n FROM st, (SELECT unnest(range(1, 4)) AS g) GROUP BY ALL")
def label_surrogates(spark, d):
    return mo.label_surrogates(states(spark, d), 3).groupBy("surrogate", "train", "state").agg(F.count(F.lit(1)).alias("n"))


@query()
def surrogate_entropy_rate(spark, d):
    s = mo.label_surrogates(states(spark, d).select("train", "idx", "state"), 20).withColumn("train", F.col("train") * 1000 + F.col("surrogate"))
    return rounded(dy.entropy_rate(dy.transitions(s)).select(F.floor(F.col("train") / 1000).alias("train"), (F.col("train") % 1000).alias("surrogate"), "entropy_rate"))


@query(f"""{STATES}, p AS (SELECT state, ln(isi) AS x, ln(1 + value) AS y FROM st JOIN s USING (train, idx) WHERE s.isi IS NOT NULL), c AS (SELECT state, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY state)
SELECT c.state, any_value(n) AS n, round(any_value(cx), 9) AS centre_x, round(any_value(cy), 9) AS centre_y, round(avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)), 9) AS dispersion, round(quantile_cont(sqrt((x - cx) ** 2 + (y - cy) ** 2), 0.95), 9) AS radius95
FROM p JOIN c USING (state) GROUP BY c.state""".replace(", isi FROM s)", " FROM s)"))
def event_geometry(spark, d):
    rows = labelled(trains(spark, d)).where("isi is not null")
    p = rows.select(F.when(F.col("auto") == "", "none").otherwise(F.col("auto")).alias("state"), F.ln("isi").alias("x"), F.log1p("value").alias("y"))
    return rounded(mo.event_geometry(p, ["x", "y"]))


@query(""", c AS (SELECT us // 500000000000 AS bin, train % 2 AS side, count(*) FILTER (isi < 0.02) / count(*) AS p FROM s GROUP BY ALL), k AS (SELECT bin, side, CASE WHEN p > 0.4 THEN 'fast' ELSE 'slow' END AS st FROM c),
j AS (SELECT a.st AS a, b.st AS b FROM k a JOIN k b ON a.bin = b.bin AND a.side = 0 AND b.side = 1), n AS (SELECT a, b, count(*) AS seen FROM j GROUP BY ALL),
e AS (SELECT *, sum(seen) OVER (PARTITION BY a) * sum(seen) OVER (PARTITION BY b) / sum(seen) OVER () AS expected FROM n)
SELECT a, b, seen, round(expected, 9) AS expected, round(log2(seen / expected), 9) AS log2_enrichment, round((seen - expected) / sqrt(expected), 9) AS residual FROM e""")
def joint_state_enrichment(spark, d):
    x = trains(spark, d).groupBy(F.floor(F.col("us") / 500000000000).alias("bin"), (F.col("train") % 2).alias("side")).agg((F.count_if(F.col("isi") < 0.02) / F.count(F.lit(1))).alias("p"))
    x = x.withColumn("st", F.when(F.col("p") > 0.4, "fast").otherwise("slow"))
    return rounded(mo.joint_enrichment(x.where("side = 0").select("bin", F.col("st").alias("a")).join(x.where("side = 1").select("bin", F.col("st").alias("b")), "bin")))


@query()
def state_space_components(spark, d):
    return rounded(mo.principal_components(feature_rows(spark, d), FEATURES)[0].select("train", "idx", "auto", "pc1", "pc2", "pc3"))


@query()
def factor_loadings(spark, d):
    load, psi = mo.factor_analysis(feature_rows(spark, d), FEATURES)
    return spark.createDataFrame([(c, float(abs(a[0])), float(u)) for c, a, u in zip(FEATURES, load, psi, strict=True)], "feature string, loading double, uniqueness double")


def shares(spark, d):
    """Shares of each train's intervals by length."""
    bands = [(0, 0.01), (0.01, 0.02), (0.02, 0.04), (0.04, 0.08)]
    return stored(trains(spark, d).where("valid").groupBy("train").agg(*[F.avg((F.col("isi").between(a, b)).cast("double")).alias(f"f{i}") for i, (a, b) in enumerate(bands)]), "population")


def embedded(spark, d, model):
    """A row for each train: shares of its intervals by length, placed by a model of at most 900 trains."""
    x = shares(spark, d)
    p = mo.subsample(x, LANDMARKS, key="train").filter(like="f").to_numpy()
    return mo.placed(x, [f"f{i}" for i in range(4)], model(p) if len(p) else lambda y: y)


@query()
def isomap_embedding(spark, d):
    return embedded(spark, d, mo.landmark_isomap)


@query()
def diffusion_embedding(spark, d):
    return embedded(spark, d, mo.landmark_diffusion)


@query()
def potential_embedding(spark, d):
    return embedded(spark, d, mo.landmark_potential)


@query()
def embedding_quality(spark, d):
    """How well the diffusion potential keeps each train's neighbours."""
    x = shares(spark, d)
    y = embedded(spark, d, mo.landmark_potential)
    names = [f"f{i}" for i in range(4)]
    return rounded(mf.neighbour_ranks(x.withColumn("train", F.col("train").cast("long")).join(y, "train"), names, ["x", "y"]), 6)


@query()
def state_distance_tests(spark, d):
    """Are the labels' intervals apart, in their length and in that of the one before?"""
    rows = labelled(trains(spark, d))
    p = rows.withColumn("_b", F.lag("isi").over(isi.in_train())).where("valid and _b > 0")
    p = p.select(F.struct("train", "idx").alias("at"), F.col("auto").alias("state"), F.log10("isi").alias("x"), F.log10("_b").alias("y"))
    return rounded(mf.state_distances(p, ["x", "y"], 49))


@query()
def held_out_columns(spark, d):
    """What bins of the other kinds of spikes say about one kind."""
    from .event_queries import KINDS

    c = trains(spark, d).groupBy(F.floor(F.col("us") / (5 * 10**10)).alias("at")).pivot("kind", KINDS).agg(F.count(F.lit(1))).fillna(0)
    return rounded(mf.held_out_prediction(c, KINDS), 6)


@query()
def transition_model(spark, d):
    c = dy.transitions(states(spark, d)).groupBy("source", "target").agg(F.sum("n").alias("n"))
    return rounded(mo.transition_model(c), 4)


@query()
def neural_labels(spark, d):
    x = feature_rows(spark, d).withColumn("label", F.when(F.col("auto") == "", "none").otherwise(F.col("auto")))
    return mo.label_classifier(x.where("train % 2 = 0"), x, FEATURES).select("train", "idx", "label", "predicted", F.round("confidence", 6).alias("confidence"))


@query(""", p AS (SELECT train, idx, CASE WHEN kind = 'click' AND isi < 0.02 THEN 'burst' WHEN isi < 0.05 THEN 'tonic' WHEN isi > 0.07 THEN 'pause' ELSE '' END AS l, least(value / 200, 1) AS c FROM s WHERE isi IS NOT NULL),
n AS (SELECT *, lag(l) OVER w AS a, lead(l) OVER w AS b FROM p WINDOW w AS (PARTITION BY train ORDER BY idx)), k AS (SELECT *, CASE WHEN l = 'pause' OR l = a OR l = b THEN l ELSE '' END AS m FROM n),
r AS (SELECT train, m AS label, min(idx) AS start, max(idx) AS e, avg(c) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY train ORDER BY idx) - row_number() OVER (PARTITION BY train, m ORDER BY idx) AS run FROM k) WHERE m <> '' GROUP BY train, m, run),
u AS (SELECT *, isi IS NOT NULL AND NOT artifact AS ok FROM s), lm AS (SELECT a.train, a.idx, quantile_cont(b.isi, 0.5) AS med FROM u a JOIN u b ON b.train = a.train AND b.ok AND b.idx BETWEEN a.idx - 5 AND a.idx + 5 AND b.idx <> a.idx GROUP BY ALL),
i AS (SELECT r.*, u.idx, u.isi, u.isi / med AS beside, lag(u.isi) OVER (PARTITION BY r.train, r.start ORDER BY u.idx) AS p FROM r JOIN u ON u.train = r.train AND u.ok AND u.idx BETWEEN r.start AND r.e LEFT JOIN lm ON lm.train = u.train AND lm.idx = u.idx),
m AS (SELECT train, label, start, e, conf, avg(isi) AS mean, max(isi) AS mx, max(beside) AS bs, quantile_cont(isi, 0.9) AS q90, stddev_samp(isi) / avg(isi) AS cv, max(isi) / avg(isi) AS mm, avg(3 * (p - isi) ** 2 / (p + isi) ** 2) AS lv FROM i GROUP BY ALL),
g AS (SELECT m.*, x.isi / q90 AS pre, y.isi / q90 AS post FROM m LEFT JOIN s x ON x.train = m.train AND x.idx = m.start - 1 LEFT JOIN s y ON y.train = m.train AND y.idx = m.e + 1)
SELECT train, start, e AS "end", label, label AS predicted, round(conf, 9) AS confidence, e - start + 1 AS n_isi FROM g WHERE CASE label WHEN 'burst' THEN e - start + 2 >= 3 AND least(pre, post) >= 1.08 AND CASE WHEN pre IS NOT NULL AND post IS NOT NULL THEN sqrt(pre * post) ELSE coalesce(pre, post) END >= 1.17
 WHEN 'tonic' THEN e - start + 2 >= 5 AND mean BETWEEN 0.02 AND 0.06 AND lv <= 0.625 AND cv <= 0.45 AND mm <= 1.4375 ELSE mx >= 0.09 OR bs >= 1.76 END""")
def guarded_predictions(spark, d):
    """Predictions by a rule, so that SQL can make them too: which runs of them are events."""
    rows = trains(spark, d)
    isi_ = F.col("isi")
    label = F.when((F.col("kind") == "click") & (isi_ < 0.02), "burst").when(isi_ < 0.05, "tonic").when(isi_ > 0.07, "pause").otherwise("")
    p = rows.where("isi is not null").select("train", "idx", label.alias("label"), F.least(F.col("value") / 200, F.lit(1.0)).alias("confidence"), F.lit(True).alias("accepted"))
    return rounded(gr.guarded(rows, p))


@query()
def guarded_neural_labels(spark, d):
    """Events of the network's predictions; runs that can't be what they are called take the next label that they can be."""
    x = feature_rows(spark, d).withColumn("label", F.when(F.col("auto") == "", "none").otherwise(F.col("auto")))
    p = mo.label_classifier(x.where("train % 2 = 0"), x, FEATURES, probabilities=True)
    p = p.select("train", "idx", F.col("predicted").alias("label"), "confidence", (F.col("predicted") != "").alias("accepted"), "probabilities")
    return rounded(gr.guarded(trains(spark, d), p, fallback=True), 6)


@query()
def platt_calibration(spark, d):
    from .validation_queries import scores

    return rounded(mo.platt(scores(spark, d)), 6)


@query()
def isotonic_calibration(spark, d):
    from .validation_queries import scores

    return rounded(mo.isotonic(scores(spark, d)), 6)


@query(f"""{STATES} SELECT kind, g::INT AS surrogate, train, state, count(*) AS n FROM st, (SELECT unnest(range(1, 4)) AS g), (SELECT unnest(['label_permutation', 'block_shuffle', 'run_shuffle']) AS kind) GROUP BY ALL""")
def shuffled_label_counts(spark, d):
    """Labels shuffled one by one, in blocks and in runs: how often each stands in a surrogate."""
    return su.shuffled(states(spark, d).select("train", "idx", "state"), 3).groupBy("kind", "surrogate", "train", "state").agg(F.count(F.lit(1)).alias("n"))


@query()
def surrogate_controls(spark, d):
    """Each train's labels against 20 surrogates of every kind."""
    return rounded(su.controls(states(spark, d).select("train", "idx", "state"), 20))
