"""Spike trains from the events table: a user is a train, an event's time is a spike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Microseconds since 1970 at which trains begin to count, and steps of a train's whole-number times in a second of train time (of this table, where a second of train time is a million seconds, they are microseconds).
EPOCH_US, SCALE = 1_704_067_200_000_000, 1e12
#: Seconds: the shortest interval that can be real, and the upper bound of the refractory period.
MIN_ISI, REFRACTORY = 0.0009, 0.002


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(train, event_id, us, t, kind, value): the spikes, in microseconds and in seconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US
    rows = events(spark, sf_dir).select(F.col("user_id").alias("train"), "event_id", us.alias("us"), F.col("event_type").alias("kind"), "value")
    return rows.withColumn("t", F.col("us") / F.lit(SCALE))


def in_order() -> WindowSpec:
    return Window.partitionBy("train").orderBy("us", "event_id")


def intervals(spikes: DataFrame, min_isi: float = MIN_ISI, refractory: float = REFRACTORY) -> DataFrame:
    """spikes plus idx (from 1), isi (seconds since the spike before; null at the first) and its flags.

    valid has no tolerance (isi >= min_isi); artifact has one (isi < min_isi - tolerance); suspect is an interval from min_isi to
    the refractory period, both less the tolerance.
    """
    rows = spikes.withColumn("idx", F.row_number().over(in_order()))
    rows = rows.withColumn("isi", (F.col("us") - F.lag("us").over(in_order())) / F.lit(SCALE))
    return _flagged(rows, min_isi, refractory)


def _flagged(rows: DataFrame, min_isi: float, refractory: float) -> DataFrame:
    tolerance = max(1e-12, abs(min_isi) * 1e-6)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns({
        "valid": flag(F.col("isi") >= min_isi),
        "artifact": flag(F.col("isi") < min_isi - tolerance),
        "suspect": flag((F.col("isi") >= min_isi - tolerance) & (F.col("isi") < refractory - tolerance)) if refractory > min_isi else F.lit(False),
    })


def intervals_in_ranges(spikes: DataFrame, min_isi: float = MIN_ISI, refractory: float = REFRACTORY) -> DataFrame:
    """What intervals() gives, for tables in which one train may hold a large share of all spikes: such a train is dealt out over ranges of its times. Each range
    is numbered by itself; what came before it (a count and a last time for each range and train) is added by a join."""
    from .shared import stored

    n = int(spikes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = stored(spikes.repartitionByRange(n, "train", "us", "event_id").withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part", "train").orderBy("us", "event_id")
    earlier = Window.partitionBy("train").orderBy("_part")
    edges = parts.groupBy("_part", "train").agg(F.count(F.lit(1)).alias("_n"), F.max("us").alias("_last"))
    edges = edges.select("_part", "train", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"), F.lag("_last").over(earlier).alias("_last"))
    x = parts.withColumns({"_k": F.row_number().over(inside), "_b": F.lag("us").over(inside)}).join(edges, ["_part", "train"])
    x = x.withColumns({"idx": (F.col("_before") + F.col("_k")).cast("int"), "isi": (F.col("us") - F.coalesce("_b", "_last")) / F.lit(SCALE)})
    return _flagged(x.drop("_part", "_k", "_b", "_before", "_last"), min_isi, refractory)


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals(spikes(spark, sf_dir))


def labelled(rows: DataFrame) -> DataFrame:
    """rows plus manual (labels by hand, here a rule on clicks and purchases) and auto (labels by interval bands): what tables of labelled trains hold."""
    kind, isi = F.col("kind"), F.col("isi")
    manual = F.when((isi < 0.008) & kind.isin("click", "view"), "burst").when((isi > 0.08) & (kind == "click"), "pause").when(isi.between(0.02, 0.05) & (kind == "purchase"), "tonic").otherwise("")
    auto = F.when(isi < 0.01, "burst").when(isi < 0.02, "possible_burst").when(isi.between(0.02, 0.05), "tonic").when(isi > 0.07, "pause").otherwise("")
    return rows.withColumns({"manual": F.when(isi.isNull(), "").otherwise(manual), "auto": F.when(isi.isNull(), "").otherwise(auto)})


def task_events(rows: DataFrame) -> DataFrame:
    """(train, event_t): times of a train's error events, to which activity is aligned."""
    return rows.where(F.col("kind") == "error").select("train", F.col("event_id").alias("trial"), F.col("us").alias("event_us"), F.col("t").alias("event_t"))
