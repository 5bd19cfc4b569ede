"""Bands of single trains: learned from their labels by hand, given by hand, and frozen from a choice of trains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.stats import array_quantiles, q

from .isi import percentile_rank

#: Quantiles that the learned band of a pattern goes from and to.
LEARNED = {"burst": (0.01, 0.95), "tonic": (0.05, 0.95), "pause": (0.05, 0.99), "high_frequency_spiking": (0.01, 0.95)}


def learned_ranges(rows: DataFrame, expand: float = 1.25, expand_percent: float = 5.0) -> DataFrame:
    """(train, pattern, n, low, high, low_percent, high_percent) from each train's valid intervals with a label by hand. A burst band is widened by a share of its spread, up to the train's
    longest interval, and its percentile by some points at least."""
    own = rows.where(F.col("valid") & F.col("manual").isin(list(LEARNED)))
    at = lambda i: F.coalesce(*[F.when(F.col("manual") == p, q("isi", e[i])) for p, e in LEARNED.items()])
    x = own.groupBy("train", F.col("manual").alias("pattern"), "manual").agg(F.count("isi").alias("n"), at(0).alias("low"), at(1).alias("raw"), (q("isi", 0.75) - q("isi", 0.25)).alias("spread"), q("isi", 0.5).alias("_m")).drop("manual")
    apart = own.join(x.select("train", F.col("pattern").alias("manual"), "_m"), ["train", "manual"]).groupBy("train", F.col("manual").alias("pattern")).agg(q(F.abs(F.col("isi") - F.col("_m")), 0.5).alias("_mad"))
    most = rows.where("valid").groupBy("train").agg(F.max("isi").alias("_most"), F.count("isi").alias("_all"))
    x = x.join(apart, ["train", "pattern"]).join(most, "train")
    spread = F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.col("_mad"))
    burst = F.col("pattern") == "burst"
    x = x.withColumn("high", F.when(burst, F.least(F.col("raw") + max(0.0, expand - 1) * spread, "_most")).otherwise(F.col("raw")))
    each = percentile_rank(rows).where("valid").select("train", F.col("isi").alias("_isi"), "pct").distinct()
    share = lambda c: F.coalesce(F.max(F.when(F.col("_isi") <= F.col(c), F.col("pct"))), F.lit(0.0))
    kept = ["train", "pattern", "n", "low", "raw", "high"]
    y = x.join(each, "train").groupBy(*kept).agg(share("low").alias("low_percent"), share("raw").alias("_raw"), share("high").alias("_high"))
    high = F.when(F.col("pattern") == "burst", F.greatest("_high", F.least(F.lit(100.0), F.col("_raw") + max(0.0, expand_percent)))).otherwise(F.col("_high"))
    return y.select("train", "pattern", "n", "low", "high", "low_percent", high.alias("high_percent"))


def train_settings(trains: DataFrame, overrides: DataFrame, seed_high: float, bridge: float, tonic: tuple[float, float], pause: float, guard: float = 1.15, min_isi: float = 0.001) -> DataFrame:
    """(train, seed_high, bridge, tonic_min, tonic_max, pause_min): the detectors' bands of each train, with what overrides (train, hard, burst_max, tonic_min, tonic_max, pause_min; null or 0: nothing) say.

    A hard burst bound replaces the end of the seed band, a soft one only raises it; the bridge and the guard of tonic firing follow it. A tonic band that the guard leaves
    empty begins anew over it."""
    given = lambda c: F.when(F.col(c) > 0, F.col(c))
    x = trains.select("train").distinct().join(overrides.select("train", "hard", *[given(c).alias(f"_{c}") for c in ("burst_max", "tonic_min", "tonic_max", "pause_min")]), "train", "left")
    most = F.col("_burst_max")
    x = x.withColumns({
        "seed_high": F.when(most.isNull(), seed_high).when(F.col("hard"), most).otherwise(F.greatest(F.lit(seed_high), most)),
        "bridge": F.when(most.isNull(), bridge).otherwise(F.greatest(F.lit(bridge), most * 1.25)),
        "_asked": F.col("_tonic_min").isNotNull() | F.col("_tonic_max").isNotNull(),
    })
    reference = F.greatest("seed_high", "bridge", most)
    low = F.coalesce("_tonic_min", F.lit(tonic[0]))
    x = x.withColumn("tonic_min", F.when(F.col("_asked"), F.greatest(low, reference * guard)).otherwise(F.lit(tonic[0])))
    high = F.coalesce("_tonic_max", F.lit(tonic[1]))
    anew = F.greatest(F.col("tonic_min") + min_isi, F.col("tonic_min") * 1.25)
    x = x.withColumn("tonic_max", F.when(F.col("_asked") & (high <= F.col("tonic_min")), anew).otherwise(high))
    return x.select("train", "seed_high", "bridge", "tonic_min", "tonic_max", F.coalesce("_pause_min", F.lit(pause)).alias("pause_min"))


def frozen_bands(rows: DataFrame, calibration: DataFrame) -> dict:
    """Bands that the calibration trains (train) alone suggest, for use on all."""
    from .thresholds import histogram_bands

    return histogram_bands(rows.join(calibration.select("train").distinct(), "train", "left_semi"))


def quantile_settings(rows: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(train, and a column for each setting): settings that are quantiles of each train's own valid intervals, as detectors.detect() takes them."""
    found = rows.where("valid").groupBy("train").agg(F.sort_array(F.collect_list("isi")).alias("_s")).withColumn("_q", array_quantiles(F.col("_s"), list(shares.values())))
    return found.select("train", *[F.get("_q", i).alias(c) for i, c in enumerate(shares)])
