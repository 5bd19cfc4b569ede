"""Other burst detectors that support the main one: mean interval, log-interval histogram."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import range_join
from .runs import runs


def mean_isi(rows: DataFrame) -> DataFrame:
    """Per train: the mean of the valid intervals, and the mean of those under it (ml); unresolved under two intervals."""
    v = rows.where("valid").withColumn("_m", F.avg("isi").over(Window.partitionBy("train")))
    x = v.groupBy("train").agg(F.count("isi").alias("n"), F.avg("isi").alias("mean"), F.avg(F.when(F.col("isi") < F.col("_m"), F.col("isi"))).alias("ml"))
    return rows.select("train").distinct().join(x, "train", "left").select("train", F.coalesce("n", F.lit(0)).alias("n"), "mean", F.when(F.col("n") >= 2, F.col("ml")).alias("ml"), F.when((F.col("n") >= 2) & F.col("ml").isNotNull(), "resolved").otherwise("unresolved").alias("status"))


def mean_isi_bursts(rows: DataFrame) -> DataFrame:
    """Unions of all windows of two or more valid intervals in a row whose mean is at most the train's ml, however long.

    With s, the running sum of (interval - ml), such a window goes from any place to a later one where s is no higher. So an interval is in one if the highest s before it
    is at least the lowest s at or after it; to leave out windows of one interval, one of the two is taken a step further."""
    x = rows.join(mean_isi(rows).where("status = 'resolved'").select("train", "ml"), "train").withColumn("_run", F.col("idx") - F.row_number().over(Window.partitionBy("train", "valid").orderBy("idx")))
    run = Window.partitionBy("train", "_run")
    up, down = run.orderBy("idx"), run.orderBy(F.desc("idx"))
    x = x.where("valid").withColumn("_s", F.sum(F.col("isi") - F.col("ml")).over(up)).withColumn("_before", F.col("_s") - (F.col("isi") - F.col("ml")))
    x = x.withColumns({"_high": F.max("_before").over(up), "_high1": F.max("_before").over(up.rowsBetween(Window.unboundedPreceding, -1))})
    x = x.withColumns({"_low": F.min("_s").over(down), "_low1": F.min("_s").over(down.rowsBetween(Window.unboundedPreceding, -1))})
    near = F.col("ml") * 1e-9  # of sums that are equal but for rounding
    return runs(x, (F.col("_high1") + near >= F.col("_low")) | (F.col("_high") + near >= F.col("_low1"))).select("train", "start", "end")


def log_histogram(rows: DataFrame, width: float = 0.1) -> DataFrame:
    """Probability of log10 intervals (milliseconds) by train and bin."""
    x = rows.where("valid").groupBy("train", F.floor(F.log10(F.col("isi") * 1000) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return x.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("train")))


def lowess(y: np.ndarray, share: float) -> np.ndarray:
    """Locally weighted lines over equally spaced points, one pass."""
    n = len(y)
    k = min(n, max(2, int(share * n + 1e-10)))
    x, out = np.arange(n, dtype=float), np.empty(n)
    for i in range(n):
        d = np.abs(x - i)
        h = max(np.partition(d, k - 1)[k - 1], 1e-9)
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        w = np.where(d <= 0.001 * h, 1.0, w)
        m = (w * x).sum() / w.sum()
        s = (w * (x - m) ** 2).sum()
        out[i] = (w * y).sum() / w.sum() + ((i - m) * (w * (x - m) * y).sum() / s if s > 1e-9 else 0.0)
    return out


def log_threshold(rows: DataFrame, width: float = 0.1, share: float = 0.12, void: float = 0.7) -> DataFrame:
    """Per train: the valley of the smoothed log histogram between the highest peak up to 100 ms and a later peak, where the void (how deep it lies under both) is
    largest and at least `void`; seconds. A train is one row of at most a hundred bins."""
    bins = log_histogram(rows, width).groupBy("train").agg(F.collect_list(F.struct("bin", "p")).alias("h"))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for train, h in pdf[["train", "h"]].itertuples(index=False):
            b = np.array([x["bin"] for x in h])
            y = np.zeros(b.max() - b.min() + 1)
            y[b - b.min()] = [x["p"] for x in h]
            y = np.clip(lowess(y, share), 0, None)
            at = (np.arange(len(y)) + b.min() + 0.5) * width
            peaks = []
            for i in sorted((i for i in range(len(y)) if y[i] > 0 and (i == 0 or y[i] >= y[i - 1]) and (i == len(y) - 1 or y[i] > y[i + 1])), key=lambda i: -y[i]):
                if all(abs(i - j) >= 2 for j in peaks):
                    peaks.append(i)
            first = next((i for i in peaks if at[i] <= 2.0), None)
            best = (None, None)
            for j in sorted(peaks):
                if first is not None and j > first:
                    k = first + int(np.argmin(y[first : j + 1]))
                    v = 1 - y[k] / np.sqrt(y[first] * y[j])
                    if v >= void and (best[1] is None or v > best[1]):
                        best = (10 ** at[k] / 1000, v)
            out.append((train, len(peaks), *best))
        return pd.DataFrame(out, columns=["train", "peaks", "threshold", "void"])

    def each(batches):
        for pdf in batches:
            yield find(pdf)

    return bins.mapInPandas(each, f"train {bins.schema['train'].dataType.simpleString()}, peaks long, threshold double, void double")


def core_bursts(rows: DataFrame, thresholds: DataFrame, least: int = 5, fallback: float = 0.1) -> DataFrame:
    """Cores of intervals under the train's bound (at most fallback) with enough spikes, extended over the run of intervals up to twice the bound around them."""
    x = rows.join(thresholds.select("train", F.least(F.coalesce("threshold", F.lit(fallback)), F.lit(fallback)).alias("_a")), "train")
    cores = runs(x, F.col("valid") & (F.col("isi") < F.col("_a"))).where(F.col("n") + 1 >= least)
    wide = runs(x, F.col("valid") & (F.col("isi") <= 2 * F.col("_a")))
    inside = range_join(cores.select("train", "start", "end"), wide.select("train", "start", "end"), ["train"])
    return inside.groupBy("train", F.col("r_start").alias("start"), F.col("r_end").alias("end")).agg(F.count(F.lit(1)).alias("cores"), F.min("l_start").alias("core_start"), F.max("l_end").alias("core_end"))

