"""Files of spike times to one folder of result tables: read, detect, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.grammar import Grammar
from pulsegrid.sources import csv
from pulsegrid.sources.shared import stored

from . import detectors, events, gates, isi, thresholds


def run(spark: SparkSession, paths: list[str], out: str | None = None, form: str = "parquet", grammar: Grammar | None = None, run_id: str = "run", **options) -> dict[str, DataFrame]:
    """All result tables of the files' trains by name, written under out if it is given: labels, candidates, events and their layers, thresholds, settings, summaries and quality of the trains.

    The trains of all files are one table from the first step on; without a grammar its bands come from all of them together."""
    rows = stored(csv.read_files(spark, paths, **options).withColumn("manual", F.lit("")), "files")
    bands = stored(thresholds.resolved(spark, thresholds.histogram_bands(rows)), "bands")
    g = grammar or thresholds.settings(bands)
    labelled, ledger = detectors.detect(rows, g)
    final = stored(detectors.final_labels(labelled), "final")
    found = stored(gates.event_ledger(detectors.extracted(final), run_id, g.digest()), "events")
    tables = {
        "interval_labels": events.interval_table(final, found),
        "candidates": ledger,
        "events": found,
        "thresholds": bands,
        "settings": spark.createDataFrame([*g.flat(), ("sha256", g.digest())], "setting string, value string"),
        "train_summary": isi.train_summary(rows),
        "train_quality": isi.quality(rows),
        "train_stationarity": isi.stationarity(rows),
        **{f"events_{k}": v for k, v in gates.result_layers(found).items()},
    }
    if out:
        csv.write(tables, out, form)
    return tables
