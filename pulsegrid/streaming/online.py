"""Trains as streams: intervals as spikes come in, packets of spikes, counts in windows. An extension: batch results need whole trains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def online_intervals(spikes: DataFrame, late: str = "1 hour") -> DataFrame:
    """(train, us, isi, late) of a stream of spikes (train, ts, us): the interval since the last spike of the train seen so far. The state is one number a train. A spike before that
    is late: it is passed on without an interval and leaves the state alone."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in batches:
            rows = []
            for us in sorted(pdf["us"]):
                if last is not None and us < last:
                    rows.append((key[0], us, None, True))
                else:
                    rows.append((key[0], us, None if last is None else (us - last) / 1e12, False))
                    last = us
            yield pd.DataFrame(rows, columns=["train", "us", "isi", "late"])
        if last is not None:
            state.update((int(last),))

    return spikes.withWatermark("ts", late).groupBy("train").applyInPandasWithState(step, "train long, us long, isi double, late boolean", "last long", "append", "NoTimeout")


def packets(spikes: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Spikes of a train with no more than a gap between them: (train, start, end, n). Works on tables and streams."""
    return spikes.withWatermark("ts", late).groupBy("train", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("train", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_counts(spikes: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling windows; empty windows don't show."""
    return spikes.withWatermark("ts", late).groupBy("train", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("train", F.col("w.start").alias("start"), "n")
