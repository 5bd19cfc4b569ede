"""Sequences of labels and binned activity: transitions, motifs, dwell times, rates around events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from pulsegrid.functions.stats import cv, entropy


def in_train() -> WindowSpec:
    return Window.partitionBy("train").orderBy("idx")


def transitions(states: DataFrame, keep_same: bool = True, smooth: float = 0.0) -> DataFrame:
    """Counts of (train, source, target) of neighbouring states (train, idx, state), and their share of the source's (row) and of all (joint)."""
    x = states.withColumn("target", F.lead("state").over(in_train())).where("target is not null").withColumnRenamed("state", "source")
    x = x if keep_same else x.where("source <> target")
    c = x.groupBy("train", "source", "target").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n") + smooth
    return c.withColumns({"row": n / F.sum(n).over(Window.partitionBy("train", "source")), "joint": n / F.sum(n).over(Window.partitionBy("train"))})


def entropy_rate(t: DataFrame) -> DataFrame:
    """Per train: entropy of the next state given this one, weighted by how often each state is left."""
    per = t.groupBy("train", "source").agg(entropy(F.col("row")).alias("h"), F.sum("n").alias("n"))
    return per.groupBy("train").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("entropy_rate"), F.count(F.lit(1)).alias("states"))


def motifs(states: DataFrame, k: int = 3, collapse: bool = True) -> DataFrame:
    """Counts of runs of k states in a row, of each train; with collapse, repeats of a state count as one."""
    if collapse:
        states = states.withColumn("_b", F.lag("state").over(in_train())).where("_b is null or _b <> state").drop("_b")
    x = states.withColumn("_m", F.collect_list("state").over(in_train().rowsBetween(0, k - 1))).where(F.size("_m") == k)
    return x.groupBy("train", F.concat_ws(">", "_m").alias("motif")).agg(F.count(F.lit(1)).alias("n"))


def label_metrics(states: DataFrame) -> DataFrame:
    """Per train, of states (train, idx, state): how many there are, the largest share, their entropy, the entropy rate of the next one, and how often it changes."""
    per = states.groupBy("train", "state").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("train"))
    e = per.withColumn("p", p).groupBy("train").agg(F.count(F.lit(1)).cast("double").alias("states"), F.max("p").alias("largest"), entropy(F.col("p")).alias("entropy"))
    t = transitions(states)
    change = t.groupBy("train").agg((F.sum(F.when(F.col("source") != F.col("target"), F.col("n")).otherwise(0)) / F.sum("n")).alias("change_rate"))
    return e.join(entropy_rate(t).select("train", "entropy_rate"), "train", "left").join(change, "train", "left")


def block_bootstrap(labels: DataFrame, replicates: int = 200, block: int = 10, seed: int = 1) -> DataFrame:
    """(train, metric, observed, mean, low, high): label_metrics() of each train's labels (train, idx, label; two at least), and their 95% intervals over sequences made of as many of its blocks,
    drawn with replacement by a seeded hash, cut to its length; what a short last block leaves open is filled with single labels drawn alike."""
    order = Window.partitionBy("train").orderBy("idx")
    x = labels.select("train", (F.row_number().over(order) - 1).alias("k"), F.col("label").alias("state"))
    x = x.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("train")), "block": F.floor(F.col("k") / block)}).where("n >= 2")
    drawn = lambda most, *c: F.pmod(F.xxhash64(F.lit(seed), "train", "replicate", *c), most)
    trains = x.groupBy("train").agg(F.max("n").alias("n"), (F.max("block") + 1).alias("blocks")).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    slots = trains.withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).withColumn("block", drawn(F.col("blocks"), F.lit("block"), "slot"))
    made = slots.drop("n").join(x, ["train", "block"]).select("train", "replicate", "slot", "k", "state", "n")
    made = made.withColumn("at", F.row_number().over(Window.partitionBy("train", "replicate").orderBy("slot", "k"))).where("at <= n")
    have = made.groupBy("train", "replicate").agg(F.count(F.lit(1)).alias("have"))
    open_ = trains.join(have, ["train", "replicate"]).where("have < n").withColumn("at", F.explode(F.sequence((F.col("have") + 1).cast("int"), F.col("n").cast("int"))))
    filled = open_.withColumn("k", drawn(F.col("n"), F.lit("fill"), "at")).join(x.select("train", "k", "state"), ["train", "k"])
    both = made.select("train", "replicate", "at", "state").unionByName(filled.select("train", "replicate", "at", "state"))
    one = both.select(F.struct("train", "replicate").alias("train"), F.col("at").alias("idx"), "state")
    names = ["states", "largest", "entropy", "entropy_rate", "change_rate"]
    long = lambda df: df.select("train", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])).alias("m")).select("train", "m.*")
    boot = long(label_metrics(one)).groupBy("train.train", "metric").agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))
    seen = long(label_metrics(x.select("train", F.col("k").alias("idx"), "state"))).withColumnRenamed("value", "observed")
    return seen.join(boot, ["train", "metric"])


def sequence_metrics(segments: DataFrame) -> DataFrame:
    """Per train, of segments (train, label, n, dwell): states, the largest share and entropy of their time, dwell mean and variation."""
    per = segments.groupBy("train", "label").agg(F.sum("dwell").alias("time"))
    p = F.col("time") / F.sum("time").over(Window.partitionBy("train"))
    e = per.withColumn("p", p).groupBy("train").agg(F.count(F.lit(1)).alias("states"), F.max("p").alias("largest"), entropy(F.col("p")).alias("entropy"), F.max_by("label", F.struct("p", "label")).alias("dominant"))
    d = segments.groupBy("train").agg(F.avg("dwell").alias("dwell_mean"), cv("dwell").alias("dwell_cv"), F.count(F.lit(1)).alias("segments"))
    return e.join(d, "train")


def binned(rows: DataFrame, width_us: int) -> DataFrame:
    """(train, bin, n) of spikes, empty bins between a train's first and last included."""
    c = rows.groupBy("train", F.floor(F.col("us") / width_us).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = c.groupBy("train").agg(F.min("bin").alias("a"), F.max("bin").alias("b")).select("train", F.explode(F.sequence("a", "b")).alias("bin"))
    return every.join(c, ["train", "bin"], "left").select("train", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def count_distribution(bins: DataFrame) -> DataFrame:
    """Per train, of bin counts: mean, variance, Fano factor, shares of 0, 1, 2 or more and 3 or more spikes, and the distance to a Poisson distribution of the same mean."""
    s = bins.groupBy("train").agg(F.count("n").alias("bins"), F.avg("n").alias("mean"), F.var_samp("n").alias("variance"), F.max("n").alias("most"), *[F.avg(c.cast("double")).alias(a) for a, c in (("p0", F.col("n") == 0), ("p1", F.col("n") == 1), ("p2", F.col("n") >= 2), ("p3", F.col("n") >= 3))])
    k = s.select("train", "mean", "bins", F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("n"))
    pmf = F.exp(F.col("n") * F.ln("mean") - F.col("mean") - F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest("n", F.lit(1))), F.lit(0.0), lambda a, i: a + F.ln(i)))
    seen = bins.groupBy("train", "n").agg(F.count(F.lit(1)).alias("c"))
    gap = k.join(seen, ["train", "n"], "left").groupBy("train").agg(F.sum(F.abs(F.coalesce("c", F.lit(0)) / F.col("bins") - pmf)).alias("poisson_l1"))
    return s.join(gap, "train").withColumn("fano", F.col("variance") / F.col("mean")).drop("most")


def psth(spikes_near: DataFrame, events: DataFrame, before_us: int, after_us: int, width_us: int) -> DataFrame:
    """Rates around events: (bin, mean, sem, z) over trials, from (trial, lag_us). Trials without spikes in a bin count as 0; z is against the bins before the event."""
    grid = events.select("trial").distinct().withColumn("bin", F.explode(F.sequence(F.lit(-(before_us // width_us)).cast("long"), F.lit(after_us // width_us - 1).cast("long"))))
    n = spikes_near.groupBy("trial", F.floor(F.col("lag_us") / width_us).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    per = grid.join(n, ["trial", "bin"], "left").withColumn("rate", F.coalesce("n", F.lit(0)) / F.lit(width_us / 1e12))
    m = per.groupBy("bin").agg(F.avg("rate").alias("mean"), (F.stddev_samp("rate") / F.sqrt(F.count("rate"))).alias("sem"))
    base = m.agg(F.avg(F.when(F.col("bin") < 0, F.col("mean"))).alias("_m"), F.stddev_samp(F.when(F.col("bin") < 0, F.col("mean"))).alias("_s"))
    return m.join(F.broadcast(base)).withColumn("z", F.when(F.col("_s") > 0, (F.col("mean") - F.col("_m")) / F.col("_s"))).drop("_m", "_s")  # base: one row


def occupancy(ranges: DataFrame, order: list[str]) -> DataFrame:
    """Shares of each bin's time by label, from (train, bin, label, overlap), and the dominant label (the first of order on ties)."""
    x = ranges.groupBy("train", "bin", "label").agg(F.sum("overlap").alias("overlap"))
    share = F.col("overlap") / F.sum("overlap").over(Window.partitionBy("train", "bin"))
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col("label"))
    x = x.withColumns({"share": share, "_r": rank})
    return x.withColumn("dominant", F.max_by("label", F.struct("share", -F.col("_r"))).over(Window.partitionBy("train", "bin"))).drop("_r")


def smoothed(bins: DataFrame, value: str = "n", sigma: float = 1.0) -> DataFrame:
    """Gaussian smoothing over bins within three deviations; weights add up to 1 at the ends too, nulls are passed over."""
    import math

    k = math.ceil(3 * sigma)
    w = Window.partitionBy("train").orderBy("bin").rowsBetween(-k, k)
    near = F.filter(F.collect_list(F.struct(F.col("bin").alias("b"), F.col(value).cast("double").alias("v"))).over(w), lambda s: s["v"].isNotNull())
    weigh = lambda s: F.exp(-F.pow((s["b"] - F.col("bin")) / F.lit(sigma), F.lit(2.0)) / 2)
    x = bins.withColumn("_near", near)
    total = F.aggregate("_near", F.lit(0.0), lambda a, s: a + weigh(s))
    return x.withColumn("smooth", F.aggregate("_near", F.lit(0.0), lambda a, s: a + weigh(s) * s["v"]) / total).drop("_near")


def onsets(states: DataFrame, into: list[str]) -> DataFrame:
    """Rows at which a state of `into` begins."""
    return states.withColumn("_b", F.lag("state").over(in_train())).where(F.col("state").isin(into) & ((F.col("_b") != F.col("state")) | F.col("_b").isNull())).drop("_b")


def pair_correlation(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pearson correlation of the counts (train, bin, n) of pairs of trains (a, b) over the bins that both have."""
    a, b = counts.select(F.col("train").alias("a"), "bin", F.col("n").alias("x")), counts.select(F.col("train").alias("b"), "bin", F.col("n").alias("y"))
    return pairs.join(a, "a").join(b, ["b", "bin"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("bins"), F.corr("x", "y").alias("r"))


def latent_speed(path: DataFrame, axes: list[str]) -> DataFrame:
    """Speed and turning angle along a path (train, idx, axes)."""
    d = {a: F.col(a) - F.lag(a).over(in_train()) for a in axes}
    x = path.withColumns({f"_{a}": c for a, c in d.items()})
    x = x.withColumn("speed", F.sqrt(sum((F.col(f"_{a}") * F.col(f"_{a}") for a in axes), F.lit(0.0))))
    dot = sum((F.col(f"_{a}") * F.lag(f"_{a}").over(in_train()) for a in axes), F.lit(0.0))
    size = F.col("speed") * F.lag("speed").over(in_train())
    return x.withColumn("turn", F.when(size > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / size))))).drop(*[f"_{a}" for a in axes])


def states(rows: DataFrame, label: Column) -> DataFrame:
    return rows.select("train", "idx", F.when(label == "", "none").otherwise(label).alias("state"), "isi")
