"""Labels predicted for single intervals, made into events that are possible: what a run of equal predictions claims to be has to look like it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.shared import stored

from .isi import in_train, local_median
from .joins import range_join
from .runs import segments, support_runs
from .statistics import span_metrics

#: Labels that runs are checked for, likeliest first where two are equally likely.
CHECKED = ["burst", "long_burst", "possible_burst", "high_frequency_tonic", "tonic", "pause"]


@dataclass(frozen=True)
class Rails:
    """What runs of predicted labels have to show."""

    prob_spiking: float = 0.55
    spiking_spikes: int = 30
    short: float = 0.020
    q80: float = 0.025
    q90: float = 0.025
    bridge: float = 0.035
    gap: float = 0.075
    large_run: int = 3
    large_share: float = 0.30
    edge: tuple[float, float] = (1.08, 1.17)
    fast_spikes: int = 6
    fast_floor: float = 0.0085
    fast_low: float = 0.010
    fast_low_share: float = 0.10
    fast_q90: float = 0.025
    fast_cv: float = 0.45
    fast_lv: float = 0.525
    fast_mm: float = 1.50
    tonic_spikes: int = 5
    tonic_band: tuple[float, float] = (0.020, 0.060)
    tonic_lv: float = 0.625
    tonic_cv: float = 0.45
    tonic_mm: float = 1.4375
    pause: float = 0.090
    pause_ratio: float = 1.76


def spiking_epochs(rows: DataFrame, predictions: DataFrame, r: Rails | None = None) -> DataFrame:
    """(train, start, end, confidence): long states around predicted spiking, across a few longer intervals, that are compact as a whole. Support is an accepted prediction or a probability (prob_spiking, if there is
    such a column), on valid intervals up to the tolerated gap."""
    r = r or Rails()
    prob = F.coalesce(F.col("prob_spiking") >= r.prob_spiking, F.lit(False)) if "prob_spiking" in predictions.columns else F.lit(False)
    said = predictions.select("train", "idx", "confidence", ((F.col("label") == "high_frequency_spiking") & F.col("accepted") | prob).alias("_said")).where("_said")
    x = rows.withColumn("valid", F.col("isi").isNotNull() & ~F.col("artifact")).join(said, ["train", "idx"], "left")
    support = F.coalesce(F.col("_said"), F.lit(False)) & (F.col("isi") <= r.gap)
    found = support_runs(x, support, r.gap, float("inf"), r.large_run).where(F.col("end") - F.col("start") + 2 >= max(3, r.spiking_spikes)).select("train", "start", "end")
    nth = F.count_if("valid").over(in_train())
    above = F.coalesce(F.col("valid") & (F.col("isi") > r.bridge), F.lit(False))
    x = x.withColumns({"_nth": nth, "_above": above}).withColumn("_row", F.when(F.col("_above"), F.col("_nth") - F.coalesce(F.max(F.when(F.col("valid") & ~F.col("_above"), F.col("_nth"))).over(in_train()), F.lit(0))).otherwise(0))
    x = x.withColumns({"suspect": F.col("isi") <= r.q90, "_c": F.when(F.col("_said"), F.col("confidence")), "_far": F.col("isi") > r.gap})
    m = span_metrics(x, found, r.short, r.bridge, quantiles=(0.8, 0.9), longest=("max", "_row"), confidence=("avg", "_c"), far=("count", "_far"))
    n = F.col("n_isi")
    bridged = (F.col("core") + F.col("bridges")) / n
    majority = (F.col("core") / n >= 0.55) | (F.col("suspects") / n >= 0.60) | (bridged >= 0.75)
    compact = (F.col("q90") <= r.q90) | ((F.col("q80") <= r.q80) & majority)
    return m.where(compact & (1 - F.col("far") / n >= 0.95) & (1 - bridged <= r.large_share) & (F.col("longest") <= max(2, r.large_run))).select("train", "start", "end", "confidence")


def _possible(r: Rails) -> dict[str, Column]:
    """Whether a run with these measures can be an event of a label."""
    n, yes = F.col("end") - F.col("start") + 2, lambda c: F.coalesce(c, F.lit(False))
    a, b = F.col("pre_ratio"), F.col("post_ratio")
    least = F.least(a, b)
    geometric = F.exp(F.when(a.isNotNull() & b.isNotNull(), (F.ln(a) + F.ln(b)) / 2).otherwise(F.ln(F.coalesce(a, b))))
    burst = yes((n >= 3) & (least >= r.edge[0]) & (geometric >= r.edge[1]))
    fast = yes((n >= r.fast_spikes) & (F.col("q10") >= r.fast_floor) & (F.col("suspects") / F.col("n_isi") <= r.fast_low_share) & (F.col("q90") <= r.fast_q90) & (F.col("cv") <= r.fast_cv) & (F.col("lv") <= r.fast_lv) & (F.col("mm") <= r.fast_mm))
    tonic = yes((n >= r.tonic_spikes) & F.col("mean_isi").between(*r.tonic_band) & (F.col("lv") <= r.tonic_lv) & (F.col("cv") <= r.tonic_cv) & (F.col("mm") <= r.tonic_mm))
    pause = yes((F.col("max_isi") >= r.pause) | (F.col("beside") >= r.pause_ratio))
    return {"burst": burst, "long_burst": burst, "possible_burst": burst, "high_frequency_tonic": fast, "tonic": tonic, "pause": pause}


def guarded(rows: DataFrame, predictions: DataFrame, r: Rails | None = None, fallback: bool = False) -> DataFrame:
    """(train, start, end, label, predicted, confidence, n_isi): events of predictions (train, idx, label, confidence, accepted; prob_spiking and probabilities, a map of label to probability, if there are any).

    Spiking comes only from long compact states (spiking_epochs). Outside them, and where there is no label by hand, accepted labels count: one alone among others is dropped unless it is a pause, and a run of
    equal ones must look like what it is called. With fallback a run that doesn't takes the label that its intervals' mean probability puts next and that it can be; without, or if there is none, it is
    dropped. burst_family is a possible burst; labels that aren't checked are dropped."""
    r = r or Rails()
    rows = stored(rows.withColumn("valid", F.col("isi").isNotNull() & ~F.col("artifact")), "trains")
    predictions = stored(predictions, "predictions")
    states = stored(spiking_epochs(rows, predictions, r), "spiking-epochs")
    at = predictions.where("accepted").select("train", F.col("idx").alias("start"), F.col("idx").alias("end"))
    inside = range_join(states.select("train", "start", "end"), at, ["train"]).select("train", F.col("r_start").alias("idx")).distinct()
    label = F.when(F.col("label") == "burst_family", "possible_burst").otherwise(F.col("label"))
    said = predictions.where("accepted").withColumn("label", label).where(F.col("label").isin(CHECKED)).join(inside, ["train", "idx"], "left_anti").select("train", "idx", F.col("label").alias("_l"), F.col("confidence").alias("_c"))
    x = rows.join(said, ["train", "idx"], "left")
    manual = F.coalesce("manual", F.lit("")) != "" if "manual" in rows.columns else F.lit(False)
    x = x.withColumn("_l", F.when(~manual & (F.col("idx") >= 2), F.coalesce("_l", F.lit(""))).otherwise(""))
    alone = (F.col("_l") != "pause") & (F.coalesce(F.lag("_l").over(in_train()), F.lit("")) != F.col("_l")) & (F.coalesce(F.lead("_l").over(in_train()), F.lit("")) != F.col("_l"))
    x = stored(local_median(x.withColumn("_l", F.when(alone, "").otherwise(F.col("_l")))), "point-labels")
    runs_ = segments(x, F.col("_l"), F.avg("_c").alias("confidence")).where("label <> ''").select("train", "start", "end", F.col("label").alias("predicted"), "confidence")
    if fallback and "probabilities" in predictions.columns:
        each = predictions.select("train", F.col("idx").alias("start"), F.col("idx").alias("end"), F.explode("probabilities").alias("_k", "_p"))
        mean = range_join(runs_.select("train", "start", "end"), each, ["train"]).groupBy("train", F.col("l_start").alias("start"), F.col("r__k").alias("_k")).agg(F.avg("r__p").alias("_p"))
        runs_ = runs_.join(mean.groupBy("train", "start").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_p"))).alias("_probs")), ["train", "start"], "left")
    measured = x.withColumns({"suspect": F.col("isi") < r.fast_low, "_beside": F.col("isi") / F.col("local_median")})
    m = span_metrics(measured, runs_.select("train", "start", "end"), 0.0, 0.0, beside=("max", "_beside")).join(runs_, ["train", "start", "end"])
    can = F.array(*[F.when(v, F.lit(k)) for k, v in _possible(r).items()])
    m = m.withColumn("_can", F.filter(can, lambda v: v.isNotNull()))
    own = F.array_contains("_can", F.col("predicted"))
    other = F.lit(None).cast("string")
    if "_probs" in m.columns:
        ranked = F.transform("_can", lambda v: F.struct(F.coalesce(F.try_element_at("_probs", v), F.lit(0.0)).alias("p"), (-F.array_position(F.array(*[F.lit(k) for k in CHECKED]), v)).alias("o"), v.alias("v")))
        best = F.array_max(F.filter(ranked, lambda s: s["p"] > 0))
        other = best["v"]
    m = m.withColumn("label", F.when(own, F.col("predicted")).otherwise(other)).where("label is not null")
    points = m.select("train", "start", "end", "label", "predicted", "confidence", (F.col("end") - F.col("start") + 1).cast("long").alias("n_isi"))
    spiking = F.lit("high_frequency_spiking")
    return points.unionByName(states.select("train", "start", "end", spiking.alias("label"), spiking.alias("predicted"), "confidence", (F.col("end") - F.col("start") + 1).cast("long").alias("n_isi")))
