"""Models of states: mixtures, semi-Markov decoding, recurrence, embeddings, transition and label classifiers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from pulsegrid.sources.shared import stored

from .runs import recurrence_lines


def in_train() -> WindowSpec:
    return Window.partitionBy("train").orderBy("idx")


def rule_states(rows: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """fast, medium or slow: by the train's own quantiles of its intervals."""
    w = Window.partitionBy("train")
    a, b = F.percentile("isi", F.lit(low)).over(w), F.percentile("isi", F.lit(high)).over(w)
    return rows.where("valid").withColumn("state", F.when(F.col("isi") <= a, "fast").when(F.col("isi") >= b, "slow").otherwise("medium"))


def gaussian_mixture(rows: DataFrame, columns: list[str], k: int, rounds: int = 15) -> tuple[list[dict], float]:
    """Diagonal mixture by expectation and maximisation: (components with weight, mean and variance by column, BIC). A round is one aggregate over all rows; only k
    components' sums reach the driver."""
    start = rows.agg(F.count(F.lit(1)).alias("n"), *[F.percentile(c, F.array(*[F.lit((i + 0.5) / k) for i in range(k)])).alias(f"q_{c}") for c in columns], *[F.var_pop(c).alias(f"v_{c}") for c in columns]).first()
    parts = [{"weight": 1 / k, "mean": [start[f"q_{c}"][i] for c in columns], "var": [max(start[f"v_{c}"], 1e-9) for c in columns]} for i in range(k)]
    total = -math.inf
    for _ in range(rounds):
        r, log_total = _responsibilities(parts, columns)
        sums = [F.sum(log_total).alias("_ll")]
        for i in range(k):
            sums += [F.sum(r[i]).alias(f"_{i}")] + [F.sum(r[i] * F.col(c)).alias(f"_{i}_{c}") for c in columns] + [F.sum(r[i] * F.col(c) * F.col(c)).alias(f"_{i}_{c}_2") for c in columns]
        s = rows.agg(*sums).first()
        for i, p in enumerate(parts):
            n = max(s[f"_{i}"], 1e-9)
            p["weight"] = n / start["n"]
            p["mean"] = [s[f"_{i}_{c}"] / n for c in columns]
            p["var"] = [max(s[f"_{i}_{c}_2"] / n - m * m, 1e-6) for c, m in zip(columns, p["mean"], strict=True)]
        if s["_ll"] - total < 1e-6 * abs(s["_ll"]):
            total = s["_ll"]
            break
        total = s["_ll"]
    free = k * 2 * len(columns) + k - 1
    return sorted(parts, key=lambda p: p["mean"]), free * math.log(start["n"]) - 2 * total


def _responsibilities(parts: list[dict], columns: list[str]) -> tuple[list[Column], Column]:
    logs = []
    for p in parts:
        x = F.lit(math.log(max(p["weight"], 1e-300)))
        for c, m, v in zip(columns, p["mean"], p["var"], strict=True):
            x = x - 0.5 * (F.lit(math.log(2 * math.pi * v)) + (F.col(c) - m) * (F.col(c) - m) / v)
        logs.append(x)
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    total = top + F.ln(sum((F.exp(x - top) for x in logs), F.lit(0.0)))
    return [F.exp(x - total) for x in logs], total


def mixture_states(rows: DataFrame, columns: list[str], most: int = 4) -> DataFrame:
    """rows plus state (0: the component of the smallest mean) of the mixture of 2 to `most` components with the least BIC."""
    rows = stored(rows, "mixture")
    parts, _ = min((gaussian_mixture(rows, columns, k) for k in range(2, most + 1)), key=lambda x: x[1])
    r, _ = _responsibilities(parts, columns)
    best = F.greatest(*r)
    return rows.withColumn("state", F.coalesce(*[F.when(x == best, F.lit(i)) for i, x in enumerate(r)]))


def semi_markov(rows: DataFrame, means: list[float], sd: float, stay: list[float]) -> DataFrame:
    """Duration decoding of each train: the states (by means of log10 intervals), geometric in length with the given expected stays and of any length, that are likeliest
    together. Since lengths are geometric, a stay goes on or ends at each interval alike: O(n * states^2) numbers a train; a train is decoded by one task."""
    k = len(means)
    on = np.array([math.log(1 - 1 / s) if s > 1 else -math.inf for s in stay])
    end = np.array([math.log(1 / s) for s in stay])
    move = math.log(1 / max(1, k - 1))

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        x = np.log10(pdf["isi"].to_numpy())
        n = len(x)
        fit = -0.5 * ((x[:, None] - np.array(means)) / sd) ** 2
        best, back = fit[0], np.zeros((n, k), int)
        for t in range(1, n):
            step = np.repeat((best + end + move)[:, None], k, 1)
            np.fill_diagonal(step, best + on)
            back[t] = step.argmax(0)
            best = step.max(0) + fit[t]
        out, s = np.zeros(n, int), int((best + end).argmax())
        for t in range(n - 1, -1, -1):
            out[t] = s
            s = back[t, s]
        return pd.DataFrame({"train": pdf["train"], "idx": pdf["idx"], "state": out})

    return rows.where("valid").select("train", "idx", "isi").groupBy("train").applyInPandas(decode, f"train {rows.schema['train'].dataType.simpleString()}, idx long, state long")


def recurrence_points(points: DataFrame, value: str, radius: float) -> DataFrame:
    """(train, i, j) with values within the radius of each other. Points (train, i, value) meet in value buckets as wide as the radius and the next ones."""
    b = points.select("train", F.col("i").alias("j"), F.col(value).alias("_w"), F.floor(F.col(value) / radius).alias("_b"))
    a = points.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.floor(F.col(value) / radius) + o)))
    return a.join(b, ["train", "_b"]).where(F.abs(F.col(value) - F.col("_w")) <= radius).select("train", "i", "j")


def recurrence_measures(points: DataFrame, value: str, radius: float) -> DataFrame:
    """Per train: recurrence rate, determinism (share of recurrent points in diagonal lines), laminarity (in columns) and trapping time."""
    p = stored(recurrence_points(points, value, radius).where("i <> j"), "recurrence")
    n = points.groupBy("train").agg(F.count(F.lit(1)).alias("n"))
    total = p.groupBy("train").agg(F.count(F.lit(1)).alias("points"))
    d = recurrence_lines(p).groupBy("train").agg(F.sum("length").alias("_d"))
    v = recurrence_lines(p, diagonal=False).groupBy("train").agg(F.sum("length").alias("_v"), F.avg("length").alias("trapping"))
    x = n.join(total, "train").join(d, "train", "left").join(v, "train", "left")
    return x.select("train", "n", (F.col("points") / (F.col("n") * (F.col("n") - 1))).alias("recurrence"), (F.coalesce("_d", F.lit(0)) / F.col("points")).alias("determinism"), (F.coalesce("_v", F.lit(0)) / F.col("points")).alias("laminarity"), "trapping")


def line_entropy(points: DataFrame, value: str, radius: float, least: int = 2) -> DataFrame:
    """(train, lines, entropy): how many diagonal lines a train's recurrence plot has, and the entropy of their lengths, in bits; null without lines."""
    p = stored(recurrence_points(points, value, radius).where("i <> j"), "recurrence")
    n = recurrence_lines(p, least=least).groupBy("train", "length").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("train"))
    x = n.withColumn("_p", share).groupBy("train").agg(F.sum("n").alias("lines"), F.sum(-F.col("_p") * F.log2("_p")).alias("entropy"))
    return points.select("train").distinct().join(x, "train", "left").select("train", F.coalesce("lines", F.lit(0)).alias("lines"), "entropy")


def label_surrogates(states: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n permutations of each train's states: places stay, states go in the order of a seeded hash."""
    # a train's places and labels as lists, ordered once for each permutation: nothing is paired, and no table of permutations is sorted or sent
    own = states.groupBy("train").agg(F.sort_array(F.collect_list(F.struct("idx", "state"))).alias("_s"))
    own = own.withColumn("surrogate", F.explode(F.sequence(F.lit(1), F.lit(n))))
    mixed = F.sort_array(F.transform("_s", lambda s: F.struct(F.xxhash64(F.lit(seed), "surrogate", s["idx"]).alias("h"), s["idx"].alias("o"), s["state"].alias("state"))))
    pairs = F.arrays_zip(F.col("_s.idx").alias("idx"), F.transform(mixed, lambda m: m["state"]).alias("state"))
    return own.select("train", "surrogate", F.inline(pairs)).select("train", "idx", "surrogate", "state")


def event_geometry(points: DataFrame, axes: list[str]) -> DataFrame:
    """Per state: the centre of its points, their mean distance from it and the radius that holds 95% of them."""
    c = points.groupBy("state").agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"centre_{a}") for a in axes])
    d = F.sqrt(sum(((F.col(a) - F.col(f"centre_{a}")) * (F.col(a) - F.col(f"centre_{a}")) for a in axes), F.lit(0.0)))
    x = points.join(c, "state").groupBy("state").agg(F.avg(d).alias("dispersion"), F.percentile(d, F.lit(0.95)).alias("radius95"))
    return c.join(x, "state")


def joint_enrichment(bins: DataFrame) -> DataFrame:
    """Of the dominant states (bin, a, b) of two trains: counts seen together and expected by chance, log2 of their ratio, the residual."""
    n = bins.groupBy("a", "b").agg(F.count(F.lit(1)).alias("seen"))
    everything = Window.partitionBy()  # a row for each pair of states
    e = F.sum("seen").over(Window.partitionBy("a")) * F.sum("seen").over(Window.partitionBy("b")) / F.sum("seen").over(everything)
    return n.withColumn("expected", e).withColumns({"log2_enrichment": F.log2(F.col("seen") / F.col("expected")), "residual": (F.col("seen") - F.col("expected")) / F.sqrt("expected")})


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    x = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip").transform(df)
    return StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True).fit(x).transform(x)


def principal_components(df: DataFrame, columns: list[str], k: int = 3) -> tuple[DataFrame, list[float]]:
    """(df plus pc1.., the shares of variance); columns are standardised, rows with nulls are left out."""
    x = _vectors(df, columns)
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(x)
    x = model.transform(x).withColumn("_a", vector_to_array("_pc"))
    return x.withColumns({f"pc{i + 1}": F.col("_a")[i] for i in range(k)}).drop("_raw", "_x", "_pc", "_a"), [float(v) for v in model.explainedVariance]


def factor_analysis(df: DataFrame, columns: list[str], k: int = 1, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(loadings, unique variances) of standardised columns, by expectation and maximisation on their correlation matrix, which is all that reaches the driver."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = df.agg(*[F.corr(a, b).alias(f"{a}:{b}") for a, b in pairs]).first()
    s = np.eye(len(columns))
    for a, b in pairs:
        i, j = columns.index(a), columns.index(b)
        s[i, j] = s[j, i] = r[f"{a}:{b}"] or 0.0
    w, v = np.linalg.eigh(s)
    load, psi = v[:, -k:] * np.sqrt(np.maximum(w[-k:], 1e-9)), np.full(len(columns), 0.5)
    for _ in range(rounds):
        beta = load.T @ np.linalg.inv(load @ load.T + np.diag(psi))
        m = np.eye(k) - beta @ load + beta @ s @ beta.T
        load = s @ beta.T @ np.linalg.inv(m)
        psi = np.clip(np.diag(s - load @ beta @ s), 5e-3, None)
    return load, psi


def subsample(df: DataFrame, most: int, seed: int = 1, key: str = "id") -> pd.DataFrame:
    """At most `most` rows, by a seeded hash of their key: the bound of methods that compare all points with all."""
    return df.orderBy(F.xxhash64(F.lit(seed), key)).limit(most).toPandas()


def classical_scaling(d2: np.ndarray, k: int) -> np.ndarray:
    n = len(d2)
    j = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(-0.5 * j @ d2 @ j)
    return v[:, ::-1][:, :k] * np.sqrt(np.maximum(w[::-1][:k], 0))


def geodesics(x: np.ndarray, neighbours: int = 8) -> np.ndarray:
    """Lengths of the shortest ways over nearest neighbours, infinite where there is none."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = np.argsort(d, 1)[:, 1 : neighbours + 1]
    g = np.full_like(d, np.inf)
    np.fill_diagonal(g, 0)
    for i, js in enumerate(near):
        g[i, js] = g[js, i] = d[i, js]
    for m in range(len(x)):
        g = np.minimum(g, g[:, m : m + 1] + g[m : m + 1])
    return g


def isomap(x: np.ndarray, neighbours: int = 8, k: int = 2) -> np.ndarray:
    """Coordinates that keep the shortest ways over nearest neighbours, for a bounded sample of points."""
    g = geodesics(x, neighbours)
    far = g[np.isfinite(g)].max() if len(x) else 0.0
    return classical_scaling(np.where(np.isfinite(g), g, 2 * far) ** 2, k)


def landmark_isomap(x: np.ndarray, neighbours: int = 8, k: int = 2) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives any points their coordinates among the landmarks x: ways go over the nearest landmarks, distances to all landmarks set the place. A landmark
    comes to where isomap puts it."""
    g = geodesics(x, neighbours)
    far = g[np.isfinite(g)].max()
    full = np.where(np.isfinite(g), g, 2 * far) ** 2
    n = len(x)
    j = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(-0.5 * j @ full @ j)
    w, v = w[::-1][:k], v[:, ::-1][:, :k]
    axes = np.where(w > 1e-12, v / np.sqrt(np.maximum(w, 1e-12)), 0.0)

    def place(points: np.ndarray) -> np.ndarray:
        d = np.sqrt(((points[:, None] - x[None]) ** 2).sum(2))
        near = np.argsort(d, 1)[:, : neighbours + 1]  # a landmark's nearest is itself
        ways = (np.take_along_axis(d, near, 1)[:, :, None] + g[near]).min(1)
        return -0.5 * (np.where(np.isfinite(ways), ways, 2 * far) ** 2 - full.mean(0)) @ axes

    return place


def diffusion_map(x: np.ndarray, k: int = 2, t: int = 1) -> np.ndarray:
    """Coordinates of a random walk with a Gaussian kernel (the width is the median distance), density taken out, for a bounded sample of points."""
    return _diffusion(x, k, t)[0]


def _diffusion(x: np.ndarray, k: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    width = max(np.median(d2[d2 > 0]) if (d2 > 0).any() else 1.0, 1e-12)
    a = np.exp(-d2 / width)
    q = a.sum(1)
    a = a / np.outer(q, q)
    r = np.sqrt(a.sum(1))
    w, v = np.linalg.eigh(a / np.outer(r, r))
    v, w = v[:, ::-1] / r[:, None], w[::-1][1 : k + 1]
    return v[:, 1 : k + 1] * w**t, w, q, width


def landmark_diffusion(x: np.ndarray, k: int = 2, t: int = 1) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives any points their coordinates in the landmarks' diffusion map: the mean of the landmarks' under the point's own step (Nystroem). A landmark
    comes to where diffusion_map puts it."""
    y, w, q, width = _diffusion(x, k, t)
    y = np.where(np.abs(w) > 1e-12, y / np.where(np.abs(w) > 1e-12, w, 1.0), 0.0)

    def place(points: np.ndarray) -> np.ndarray:
        d2 = ((points[:, None] - x[None]) ** 2).sum(2)
        a = np.exp(-(d2 - d2.min(1, keepdims=True)) / width) / q  # what all of a row share goes out below
        return a / a.sum(1, keepdims=True) @ y

    return place


def _local_kernel(d2: np.ndarray, own: np.ndarray | None, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """(kernel of points against landmarks, the points' scales): each point's scale is its distance to a near landmark; own are the landmarks' scales (None: the points are the landmarks)."""
    d = np.sort(d2, 1)
    k = min(neighbours, d.shape[1] - 1)
    scale = np.maximum(np.sqrt(d[:, k]), 1e-12)  # a landmark's nearest is itself
    return np.exp(-d2 / (scale[:, None] * (scale if own is None else own)[None])), scale


def landmark_potential(x: np.ndarray, k: int = 2, t: int = 3, neighbours: int = 15) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives any points their coordinates by diffusion potential: a random walk of t steps among the landmarks x (kernel of local scales, density taken out), minus the logarithm of where it may be, and
    scaling of the distances between those. A point's first step goes to the landmarks; a landmark comes to where scaling all landmarks' potentials puts it."""
    kernel, scale = _local_kernel(((x[:, None] - x[None]) ** 2).sum(2), None, neighbours)
    q = kernel.sum(1)
    p = kernel / q
    p = p / p.sum(1, keepdims=True)
    later = np.linalg.matrix_power(p, t - 1)
    least = np.finfo(float).eps
    mine = -np.log(np.maximum(p @ later, least))
    full = np.empty((len(x), len(x)))
    for i, row in enumerate(mine):  # a row at a time: all differences at once would be landmarks cubed
        full[i] = ((row - mine) ** 2).sum(1)
    j = np.eye(len(x)) - 1 / len(x)
    w, v = np.linalg.eigh(-0.5 * j @ full @ j)
    w, v = w[::-1][:k], v[:, ::-1][:, :k]
    axes = np.where(w > 1e-12, v / np.sqrt(np.maximum(w, 1e-12)), 0.0)

    def place(points: np.ndarray) -> np.ndarray:
        step, _ = _local_kernel(((points[:, None] - x[None]) ** 2).sum(2), scale, neighbours)
        step = step / q
        total = step.sum(1, keepdims=True)
        step = np.where(total > 0, step / np.where(total > 0, total, 1.0), 1 / len(x))
        theirs = -np.log(np.maximum(step @ later, least))
        d2 = (theirs * theirs).sum(1)[:, None] - 2 * theirs @ mine.T + (mine * mine).sum(1)[None]
        return -0.5 * (d2 - full.mean(0)) @ axes

    return place


def placed(points: DataFrame, columns: list[str], place: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(train, x, y) of every row of points (train and columns); place is a model of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                b = batch.slice(i, 256)
                y = place(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], 1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(y[:, 0]), pa.array(y[:, 1])], ["train", "x", "y"])

    return points.select(F.col("train").cast("long"), *columns).mapInArrow(run, "train long, x double, y double")


def transition_model(counts: DataFrame) -> DataFrame:
    """Multinomial model of the next state given this one, weighted by counts (source, target, n): the probability of each target by source."""
    s, t = StringIndexer(inputCol="source", outputCol="_s", stringOrderType="alphabetAsc").fit(counts), StringIndexer(inputCol="target", outputCol="label", stringOrderType="alphabetAsc").fit(counts)
    x = t.transform(s.transform(counts))
    n = len(s.labels)
    x = x.withColumns({f"_is{i}": (F.col("_s") == i).cast("double") for i in range(1, n)})
    x = VectorAssembler(inputCols=[f"_is{i}" for i in range(1, n)], outputCol="features").transform(x)
    model = LogisticRegression(family="multinomial", weightCol="n", regParam=0.0, maxIter=100, standardization=False).fit(x)
    out = model.transform(x.select("source", "features").distinct()).withColumn("_p", vector_to_array("probability"))
    return out.select("source", F.posexplode("_p").alias("_i", "p")).withColumn("target", F.element_at(F.array(*[F.lit(v) for v in t.labels]), F.col("_i") + 1)).select("source", "target", "p")


def label_classifier(train: DataFrame, rows: DataFrame, columns: list[str], hidden: int = 12, cutoff: float = 0.7, seed: int = 1, probabilities: bool = False) -> DataFrame:
    """rows plus predicted (blank under the cutoff) and confidence, of a network with one hidden layer learnt from train's label; with probabilities, a map of all labels' too."""
    index = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(train)
    assemble = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip")
    scale = StandardScaler(inputCol="_raw", outputCol="_f", withMean=True).fit(assemble.transform(train))
    model = MultilayerPerceptronClassifier(featuresCol="_f", labelCol="_y", layers=[len(columns), hidden, len(index.labels)], seed=seed, maxIter=60).fit(scale.transform(assemble.transform(index.transform(train))))
    out = model.transform(scale.transform(assemble.transform(rows))).withColumn("_p", vector_to_array("probability"))
    names = F.array(*[F.lit(v) for v in index.labels])
    out = out.withColumn("confidence", F.array_max("_p")).withColumn("predicted", F.when(F.col("confidence") >= cutoff, F.element_at(names, F.col("prediction").cast("int") + 1)).otherwise(""))
    out = out.withColumn("probabilities", F.map_from_arrays(names, "_p")) if probabilities else out
    return out.drop("_raw", "_f", "_p", "rawPrediction", "probability", "prediction")


def platt(scores: DataFrame) -> DataFrame:
    """scores (score, outcome) plus calibrated, by logistic regression."""
    x = VectorAssembler(inputCols=["score"], outputCol="features").transform(scores.withColumn("label", F.col("outcome").cast("double")))
    return LogisticRegression(regParam=0.0).fit(x).transform(x).withColumn("calibrated", vector_to_array("probability")[1]).drop("features", "label", "rawPrediction", "probability", "prediction")


def isotonic(scores: DataFrame) -> DataFrame:
    """scores (score, outcome) plus calibrated, by the best non-decreasing steps."""
    x = scores.withColumn("label", F.col("outcome").cast("double")).withColumn("features", F.col("score"))
    return IsotonicRegression().fit(x).transform(x).withColumnRenamed("prediction", "calibrated").drop("label", "features")
