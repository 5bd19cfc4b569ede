"""Interval features of trains (columns train, idx, us, t, isi, valid, artifact, suspect)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from pulsegrid.functions.stats import array_median, cv, cv2_pair, lv_pair, lvr_pair, mm, q, sample_kurtosis, sample_skewness, sorted_quantile


def by_train() -> WindowSpec:
    return Window.partitionBy("train")


def in_train() -> WindowSpec:
    return by_train().orderBy("idx")


def percentile_rank(rows: DataFrame) -> DataFrame:
    """rows plus pct: the share, in percent, of the train's valid intervals that are as short or shorter; null for others."""
    rank = 100 * F.cume_dist().over(Window.partitionBy("train", "valid").orderBy("isi"))
    return rows.withColumn("pct", F.when(F.col("valid"), rank))


def valid_pairs(rows: DataFrame, refractory: float = 0.005) -> DataFrame:
    """Valid intervals with the valid one before (a) and the terms of LV, CV2 and LvR; an interval left out joins its neighbours."""
    a, b = F.col("a"), F.col("isi")
    rows = rows.where("valid").withColumn("a", F.lag("isi").over(in_train()))
    return rows.withColumns({"lv": lv_pair(a, b), "cv2": cv2_pair(a, b), "lvr": lvr_pair(a, b, refractory)})


def train_summary(rows: DataFrame) -> DataFrame:
    """One row a train: counts, duration, rate, quantiles and variability of the valid intervals."""
    some = valid_pairs(rows).groupBy("train").agg(
        F.count("isi").alias("n_valid"), F.avg("isi").alias("mean_isi"), q("isi", 0.5).alias("median_isi"), q("isi", 0.1).alias("q10"), q("isi", 0.9).alias("q90"),
        cv("isi").alias("cv"), F.avg("lv").alias("lv"), F.avg("cv2").alias("cv2"), F.avg("lvr").alias("lvr"), mm("isi").alias("mm"),
    )
    every = rows.groupBy("train").agg(F.count(F.lit(1)).alias("n_spikes"), F.count_if("artifact").alias("n_artifact"), F.count_if("suspect").alias("n_suspect"), (F.max("t") - F.min("t")).alias("duration"))
    return every.join(some, "train", "left").withColumn("rate", F.when(F.col("duration") > 0, F.col("n_spikes") / F.col("duration")))


def moments(rows: DataFrame) -> DataFrame:
    """Moments and quantiles of log10 of the valid intervals, by train."""
    x = F.log10("isi")
    aggs = [F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), sample_skewness("x").alias("skew"), sample_kurtosis("x").alias("kurtosis"), *[q("x", p).alias(f"q{int(p * 100)}") for p in (0.1, 0.5, 0.9, 0.95)]]
    out = rows.where("valid").withColumn("x", x).groupBy("train").agg(*aggs)
    return out.withColumns({"robust_skew": (F.col("q90") + F.col("q10") - 2 * F.col("q50")) / (F.col("q90") - F.col("q10")), "tail_ratio": (F.col("q95") - F.col("q50")) / (F.col("q50") - F.col("q10"))})


def range_metrics(rows: DataFrame) -> DataFrame:
    """Where each valid interval stands in its train's range, in percent: linear, logarithmic, and logarithmic between the 1% and 99% quantiles."""
    x = F.col("isi")
    w = lambda f: f.over(by_train())
    some = rows.where("valid").withColumns({"_lo": w(F.min("isi")), "_hi": w(F.max("isi")), "_q01": w(q("isi", 0.01)), "_q99": w(q("isi", 0.99))})
    part = lambda v, a, b: F.when(b > a, F.least(F.greatest(100 * (v - a) / (b - a), F.lit(0.0)), F.lit(100.0)))
    return some.withColumns({"linear": part(x, F.col("_lo"), F.col("_hi")), "logarithmic": part(F.ln(x), F.ln("_lo"), F.ln("_hi")), "robust": part(F.ln(x), F.ln("_q01"), F.ln("_q99"))}).drop("_lo", "_hi", "_q01", "_q99")


def _around(c: Column, before: int, after: int) -> Column:
    return F.collect_list(c).over(in_train().rowsBetween(-before, after))


def local_median(rows: DataFrame, half: int = 5) -> DataFrame:
    """Median of the valid intervals of up to `half` rows on each side, without the row itself."""
    x = F.when(F.col("valid"), F.col("isi"))
    both = F.concat(F.collect_list(x).over(in_train().rowsBetween(-half, -1)), F.collect_list(x).over(in_train().rowsBetween(1, half)))
    return rows.withColumn("local_median", array_median(both))


def detector_median(rows: DataFrame, half: int = 11, left_out: Column | None = None) -> DataFrame:
    """Median of the valid intervals of up to `half` rows on each side and the row's own, without those left out."""
    use = F.col("valid") if left_out is None else F.col("valid") & ~left_out
    return rows.withColumn("detector_median", array_median(_around(F.when(use, F.col("isi")), half, half)))


def k_context(rows: DataFrame, k: int = 3) -> DataFrame:
    """Medians of the k nearest valid intervals before and after each valid one; invalid ones are passed over."""
    before, after = (F.collect_list("isi").over(in_train().rowsBetween(a, b)) for a, b in ((-k, -1), (1, k)))
    return rows.where("valid").withColumns({"pre": array_median(before), "post": array_median(after)})


def state_profile(rows: DataFrame, seed: float = 0.01, slow: float = 0.07) -> DataFrame:
    """Per train: quantiles, shares of short and long intervals, and what kind of train these suggest."""
    p = rows.where("valid").groupBy("train").agg(F.count("isi").alias("n"), *[q("isi", x).alias(f"q{int(100 * x)}") for x in (0.1, 0.25, 0.5, 0.75, 0.9)], F.avg((F.col("isi") <= seed).cast("double")).alias("short_share"), F.avg((F.col("isi") > slow).cast("double")).alias("long_share"), cv("isi").alias("cv"))
    kind = F.when(F.col("short_share") >= 0.3, "bursty").when(F.col("long_share") >= 0.3, "pausing").when(F.col("cv") <= 0.5, "regular").otherwise("irregular")
    return p.withColumn("phenotype", kind)


def histogram(rows: DataFrame, width: float = 0.005) -> DataFrame:
    """Counts of valid intervals by train and bin (left-closed), empty bins up to the train's last one included."""
    bins = rows.where("valid").groupBy("train", F.floor(F.col("isi") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = bins.groupBy("train").agg(F.max("bin").alias("last")).select("train", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("bin"))
    return every.join(bins, ["train", "bin"], "left").select("train", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def phase_portrait(rows: DataFrame) -> DataFrame:
    """(log10 interval, log10 of the next valid one)."""
    return rows.where("valid").withColumns({"x": F.log10("isi"), "y": F.log10(F.lead("isi").over(in_train()))}).where("y is not null")


def winsorised(rows: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Valid intervals clipped to their train's quantiles, if it has four or more."""
    w = lambda f: f.over(by_train())
    x = F.col("isi")
    clipped = F.least(F.greatest(x, w(q("isi", low))), w(q("isi", high)))
    return rows.where("valid").withColumn("clipped", F.when(w(F.count("isi")) >= 4, clipped).otherwise(x))


def state_features(rows: DataFrame, lags: int = 3, half: int = 5) -> DataFrame:
    """Features of each valid interval: its neighbours, statistics of the rows around it, and changes."""
    some = rows.where("valid")
    x, near = F.col("isi"), F.col("_near")
    some = some.withColumn("_near", _around(x, half, half))
    some = some.withColumn("_near", F.array_sort("_near"))  # once, for all quantiles
    before, after, around = (in_train().rowsBetween(a, b) for a, b in ((-half, -1), (1, half), (-half, half)))
    lagged = {f"lag{k}": F.lag("isi", k).over(in_train()) for k in range(1, lags + 1)} | {f"lead{k}": F.lead("isi", k).over(in_train()) for k in range(1, lags + 1)}
    quantile = lambda p: sorted_quantile(near, p)
    local = {"local_mean": F.avg(x).over(around), "local_median": quantile(0.5), "local_sd": F.stddev_samp(x).over(around), "local_q10": quantile(0.1), "local_q90": quantile(0.9), "local_iqr": quantile(0.75) - quantile(0.25)}
    some = some.withColumns(lagged | local | {"_pre": F.avg(x).over(before), "_post": F.avg(x).over(after)})
    a = F.col("lag1")
    return some.withColumns({"local_cv": F.col("local_sd") / F.col("local_mean"), "cv2": cv2_pair(a, x), "delta": x - a, "log_ratio": F.ln(x / a), "rate": 1 / x, "pre_post": F.col("_pre") / F.col("_post")}).drop("_near", "_pre", "_post")


def stationarity(rows: DataFrame, bins: int = 8, warn: float = 3.0, high: float = 6.0, least: int = 60) -> DataFrame:
    """One row a train, of how far the median interval of equal, right-closed time bins drifts: status, ratio of the highest to the lowest median, its log10, and the bins that have intervals.

    Trains of under three spikes, or with intervals in under three bins, are unavailable; those of under `least` valid intervals low_n."""
    some = rows.where("valid").withColumns({"_a": F.min("t").over(by_train()), "_b": F.max("t").over(by_train()), "_n": F.count("t").over(by_train())})
    at = F.least(F.greatest(F.ceil((F.col("t") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(1)), F.lit(bins))
    medians = some.where((F.col("_n") >= least) & (F.col("_b") > F.col("_a"))).groupBy("train", at.alias("bin")).agg(q("isi", 0.5).alias("m"))
    drift = medians.groupBy("train").agg(F.count(F.lit(1)).alias("bins"), (F.max("m") / F.min("m")).alias("_ratio"))
    x = rows.groupBy("train").agg(F.count(F.lit(1)).alias("_spikes"), F.count_if("valid").alias("_valid")).join(drift, "train", "left")
    known, ratio = (F.col("bins") >= 3) & (F.col("_spikes") >= 3), F.col("_ratio")
    status = F.when(F.col("_spikes") < 3, "unavailable").when(F.col("_valid") < least, "low_n").when(~F.coalesce(known, F.lit(False)), "unavailable")
    status = status.when(ratio >= high, "warning_high_drift").when(ratio >= warn, "warning").otherwise("ok")
    return x.select("train", status.alias("status"), F.when(known, ratio).alias("ratio"), F.when(known, F.log10(ratio)).alias("log_range"), F.coalesce("bins", F.lit(0)).alias("bins"))


def quality(rows: DataFrame, min_spikes: int = 10) -> DataFrame:
    """Quality report: a level and messages for each train."""
    s = train_summary(rows)
    share = F.col("n_artifact") / F.greatest(F.col("n_spikes") - 1, F.lit(1))
    messages = F.concat_ws(";", F.when(F.col("duration") <= 0, "invalid duration"), F.when(F.col("n_spikes") < min_spikes, "few spikes"), F.when(F.col("n_artifact") > 0, "artifact intervals"), F.when(F.col("n_suspect") > 0, "refractory suspects"))
    level = F.when(F.col("duration") <= 0, "error").when((messages != ""), "warn").otherwise("ok")
    return s.select("train", "n_spikes", "n_valid", "n_artifact", "n_suspect", "duration", "rate", share.alias("artifact_share"), level.alias("level"), messages.alias("messages"))
