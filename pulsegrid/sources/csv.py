"""Wide CSV files of spike times (a column for each train), with labels or without, to long tables; and tables back to CSV."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pulsegrid.functions.grammar import Grammar

from .events import MIN_ISI, SCALE, intervals
from .shared import small, stored

# Column names that mean something.
EVENT_COLUMN = r"(?i)^event($|[_ .:-])"
LABEL_SUFFIXES = {"manual": ["_pattern_manual", "_manual", "_pattern", "_pattern_final", "_final"], "negative": ["_pattern_manual_negative", "_manual_negative", "_not_burst"], "auto": ["_pattern_auto", "_auto"]}
#: Columns that tables of results have and raw files don't.
RESULT_COLUMNS = {"train", "pattern", "start_isi", "end_isi", "start_time_sec", "end_time_sec", "n_isi", "n_spikes", "duration_sec", "event_id", "mean_isi", "cv", "lv", "score", "source", "isi_sec", "final_label", "candidate_id"}
TIMES = "train string, input_order long, us long"


@dataclass
class Dataset:
    """spikes with intervals, trains (name and what it says), task events."""

    spikes: DataFrame
    trains: DataFrame
    task_events: DataFrame


def is_result_table(columns: list[str], path: str = "") -> bool:
    """Whether a file looks like results and not like spike times: by its name, or by three columns of results or a third of all."""
    hits = sum(c.lower() in RESULT_COLUMNS for c in columns)
    return bool(re.search(r"(events|ledger|audit|summary|metrics|labels)(\.csv)?$", path.rsplit("/", 1)[-1], re.I)) or hits >= 3 or (len(columns) > 0 and hits / len(columns) >= 0.35)


#: Seconds that times may be away from zero before a file's times are counted from its first one: 64 bits hold 106 days in steps of 1 / SCALE.
FAR = 8e6
ADDED = ("_order", "_file")


def _wide(spark: SparkSession, path: str | list[str]) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    if is_result_table(df.columns, path if isinstance(path, str) else path[0]):
        raise ValueError("this file holds results, not spike times")
    return df.withColumns({"_order": F.monotonically_increasing_id(), "_file": F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.csv)?$", 1)})


def _numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    x = df.select(F.explode(F.array(*[F.col(f"`{c}`").try_cast("double") for c in columns])).alias("t"))
    return x.where(F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < float("inf")))


def origin(df: DataFrame, columns: list[str], unit: str) -> float:
    """Seconds at which the times of the columns begin to count: 0, or the first of them if they are far from that (as seconds since 1970 are)."""
    if not columns:
        return 0.0
    first, last = _numbers(df, columns).agg(F.min("t"), F.max("t")).first()
    scale = 1000 if unit == "ms" else 1
    if first is None or max(abs(first), abs(last)) / scale < FAR:
        return 0.0
    if (last - first) / scale >= FAR:
        raise ValueError("times span more than 90 days")
    return float(math.floor(first / scale))


def _long(df: DataFrame, columns: list[str], unit: str, start: float = 0.0, by_file: bool = False) -> DataFrame:
    """Finite numbers of the columns, one a row, as whole steps of 1 / SCALE seconds since start."""
    if not columns:
        return df.sparkSession.createDataFrame([], TIMES)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("train"), F.col(f"`{c}`").try_cast("double").alias("t")) for c in columns]))
    scale = 1000 if unit == "ms" else 1
    name = F.concat_ws("/", "_file", "p.train") if by_file else F.col("p.train")
    x = df.select("_order", "_file", pairs.alias("p")).select(name.alias("train"), F.col("_order").alias("input_order"), F.col("p.t").alias("t"))
    x = x.where(F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < float("inf")))
    return x.select("train", "input_order", F.round((F.col("t") - start * scale) * (SCALE / scale)).cast("long").alias("us"))


def name_metadata(name: Column) -> dict[str, Column]:
    """What a train's name says: structure, side, depth, channel, unit."""
    part = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    side = part(r"(?i)(?:^|[_ .-])(left|right|L|R)(?:[_ .-]|$)")
    return {
        "structure": part(r"(?i)(STN|GPe|GPi|GP)"),
        "side": F.when(F.lower(side).isin("l", "left"), "left").when(F.lower(side).isin("r", "right"), "right"),
        "depth": part(r"(?i)(?:depth|D)[_ ]?(-?\d+(?:\.\d+)?)").try_cast("double"),
        "channel": part(r"(?i)(?:ch|channel)[_ ]?(\d+)").try_cast("int"),
        "unit": part(r"(?i)(?:unit|u)[_ ]?(\d+)").try_cast("int"),
    }


def collapse_duplicates(spikes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spikes with the first row of each equal time of a train, counts of dropped rows and of groups by train)."""
    k = F.row_number().over(Window.partitionBy("train", "us").orderBy("input_order"))
    n = F.count(F.lit(1)).over(Window.partitionBy("train", "us"))
    x = spikes.withColumns({"_k": k, "_n": n})
    counts = x.groupBy("train").agg(F.count_if(F.col("_k") > 1).alias("dropped"), F.count_if((F.col("_k") == 1) & (F.col("_n") > 1)).alias("groups"))
    return x.where("_k = 1").drop("_k", "_n"), counts


def input_anomalies(spikes: DataFrame) -> DataFrame:
    """Per train, in the order of the input: steps back and steps of nothing."""
    step = F.col("us") - F.lag("us").over(Window.partitionBy("train").orderBy("input_order"))
    return spikes.withColumn("_s", step).groupBy("train").agg(F.count_if(F.col("_s") < 0).alias("unsorted"), F.count_if(F.col("_s") == 0).alias("repeated"))


def _trains(spikes: DataFrame) -> DataFrame:
    return spikes.select("train").distinct().withColumns(name_metadata(F.col("train")))


def _events(df: DataFrame, columns: list[str], unit: str, start: float = 0.0) -> DataFrame:
    x = _long(df, columns, unit, start).select(F.col("train").alias("event_name"), F.col("us").alias("event_us"))
    x = x.withColumn("event_name", F.coalesce(F.nullif(F.regexp_replace("event_name", EVENT_COLUMN, ""), F.lit("")), F.lit("Event")))
    k = F.row_number().over(Window.partitionBy("event_name").orderBy("event_us"))
    return x.withColumn("event_id", F.concat_ws("_", "event_name", k.cast("string")))


def read_raw(spark: SparkSession, path: str | list[str], unit: str = "s", duplicates: str = "warn_keep", min_isi: float = MIN_ISI, by_file: bool = False) -> Dataset:
    """Files with a column of times for each train; columns called event... hold task events. Empty cells, text and non-finite numbers are passed over, times are sorted.
    duplicates: warn_keep, collapse_exact or error_keep (raises if a train repeats a time). by_file: trains are named file/column. Times far from zero count from the first one (us), t is as in the file."""
    df = _wide(spark, path)
    names = [c for c in df.columns if c not in ADDED]
    events = [c for c in names if re.search(EVENT_COLUMN, c)]
    start = origin(df, names, unit)
    times = _long(df, [c for c in names if c not in events], unit, start, by_file)
    kept, counts = collapse_duplicates(times)
    if duplicates == "error_keep" and not counts.where("dropped > 0").isEmpty():
        raise ValueError("a train repeats a time")
    times = kept if duplicates == "collapse_exact" else times
    x = times.withColumns({"event_id": F.col("input_order"), "t": F.col("us") / F.lit(SCALE) + start})
    return Dataset(intervals(x, min_isi), _trains(x).join(counts, "train").join(input_anomalies(times), "train"), _events(df, events, unit, start))


#: Commas that aren't within quotes.
COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_files(spark: SparkSession, paths: list[str], unit: str = "s", duplicates: str = "warn_keep", min_isi: float = MIN_ISI) -> DataFrame:
    """Spikes of many files of columns of times, with their intervals; trains are named file/column. One scan of all files as text, whatever their headers: a file's first line names its columns, and each cell finds its
    train by file and position. Event columns, empty cells, text and non-finite numbers are passed over; a file of results raises an error. Times far from zero count from the first one of their file, t is as
    in the file. duplicates as for read_raw()."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), at.alias("at"))
    heads = stored(lines.groupBy("path").agg(F.min("at").alias("first"), F.min_by("value", "at").alias("header")), "headers")  # a row a file
    cell = lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', ""))
    names = heads.select("path", "first", F.posexplode(F.split("header", COMMA, -1)).alias("pos", "name")).withColumn("name", cell(F.col("name")))
    result = F.lower("name").isin(sorted(RESULT_COLUMNS))
    bad = names.groupBy("path").agg(F.count_if(result).alias("hits"), F.count(F.lit(1)).alias("n"))
    file = F.regexp_extract("path", r"([^/]+?)(?:\.csv)?$", 1)
    named = F.lower(file).rlike(r"(events|ledger|audit|summary|metrics|labels)$")
    if not bad.where(named | (F.col("hits") >= 3) | (F.col("hits") / F.col("n") >= 0.35)).isEmpty():
        raise ValueError("a file holds results, not spike times")
    columns = stored(names.where(~F.col("name").rlike(EVENT_COLUMN) & (F.col("name") != "")).select("path", "first", "pos", F.concat_ws("/", file, "name").alias("train")), "columns")
    cells = lines.select("path", "at", F.posexplode(F.split("value", COMMA, -1)).alias("pos", "v")).withColumn("t", cell(F.col("v")).try_cast("double"))
    cells = cells.where(F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < float("inf")))
    x = stored(cells.join(small(columns), ["path", "pos"]).where(F.col("at") > F.col("first")).select("path", "train", F.col("at.row").alias("input_order"), "t"), "cells")
    scale = 1000 if unit == "ms" else 1
    ends = x.groupBy("path").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    near = F.greatest(F.abs("a"), F.abs("b")) / scale < FAR
    starts = stored(ends.select("path", F.when(near, 0.0).otherwise(F.floor(F.col("a") / scale).cast("double")).alias("start"), (~near & ((F.col("b") - F.col("a")) / scale >= FAR)).alias("wide")), "origins")
    if not starts.where("wide").isEmpty():
        raise ValueError("times span more than 90 days")
    x = x.join(small(starts.select("path", "start")), "path").withColumn("us", F.round((F.col("t") - F.col("start") * scale) * (SCALE / scale)).cast("long"))
    x = x.select("train", F.col("input_order").alias("event_id"), "input_order", "us", (F.col("us") / F.lit(SCALE) + F.col("start")).alias("t"))
    kept, counts = collapse_duplicates(x)
    if duplicates == "error_keep" and not counts.where("dropped > 0").isEmpty():
        raise ValueError("a train repeats a time")
    return intervals(kept if duplicates == "collapse_exact" else x, min_isi)


def read_labelled(spark: SparkSession, path: str | list[str], unit: str = "s", min_isi: float = MIN_ISI) -> Dataset:
    """Files with X_timestamp and X_ISI for each train X, and columns of labels; a file's own interval is kept as isi_file with its difference from the times (mismatch)."""
    df = _wide(spark, path)
    names = [c for c in df.columns if c not in ADDED]
    trains = [c.removesuffix("_timestamp") for c in names if c.endswith("_timestamp") and f"{c.removesuffix('_timestamp')}_ISI" in names]
    if not trains:
        raise ValueError("no train has both X_timestamp and X_ISI")
    scale = 1000 if unit == "ms" else 1
    start = origin(df, [f"{t}_timestamp" for t in trains], unit)

    def cell(train: str) -> Column:
        labels = {k: F.coalesce(*[F.nullif(F.trim(F.col(f"`{train}{s}`")), F.lit("")) for s in ends if f"{train}{s}" in names], F.lit("")) for k, ends in LABEL_SUFFIXES.items()}
        return F.struct(F.lit(train).alias("train"), F.col(f"`{train}_timestamp`").try_cast("double").alias("t"), F.col(f"`{train}_ISI`").try_cast("double").alias("isi_file"), *[c.alias(k) for k, c in labels.items()])

    x = df.select(F.col("_order").alias("event_id"), F.explode(F.array(*[cell(t) for t in trains])).alias("p")).select("event_id", "p.*").where(F.col("t").isNotNull() & ~F.isnan("t") & (F.abs("t") < float("inf")))
    x = x.withColumn("us", F.round((F.col("t") - start * scale) * (SCALE / scale)).cast("long")).withColumn("t", F.col("us") / F.lit(SCALE) + start)
    x = intervals(x, min_isi).withColumn("mismatch", F.abs(F.col("isi") - F.col("isi_file") / (1000 if unit == "ms" else 1)))
    return Dataset(x, _trains(x), _events(df, [c for c in names if re.search(EVENT_COLUMN, c)], unit, start))


def read(spark: SparkSession, path: str, mode: str = "raw", **options) -> Dataset:
    return {"raw": read_raw, "labelled": read_labelled}[mode](spark, path, **options)


def clean_names(names: list[str]) -> list[str]:
    """Names that any table can have: letters, digits and underscores, not empty, each once."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[^A-Za-z0-9]+", "_", name).strip("_") or "train"
        k, new = 1, base
        while new.lower() in {x.lower() for x in out}:
            k, new = k + 1, f"{base}_{k + 1}"
        out.append(new)
    return out


def read_settings(spark: SparkSession, path: str, strict: bool = True) -> Grammar:
    """Detector settings from a JSON file."""
    return Grammar.from_text(spark.read.text(path, wholetext=True).first()[0], strict)


def write_settings(spark: SparkSession, settings: Grammar, path: str) -> None:
    spark.createDataFrame([(settings.text(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def flat(df: DataFrame) -> DataFrame:
    """df with columns that CSV can hold: lists joined by semicolons, and text that a spreadsheet would take for a formula behind a quote."""
    def column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            return F.concat_ws(";", F.transform(c, lambda x: x.cast("string"))).alias(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.when(c.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c).alias(f.name)
        return c.alias(f.name)

    return df.select(*[column(f) for f in df.schema])


def write(tables: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each table under its name; Parquet, or CSV with header."""
    for name, df in tables.items():
        if form == "csv":
            flat(df).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


#: Four small trains (seconds).
GOLDEN = {
    "middle_burst": [0, 0.10, 0.20, 0.205, 0.210, 0.215, 0.40, 0.55],
    "boundary_start": [0, 0.005, 0.010, 0.015, 0.20, 0.35, 0.50],
    "refractory_doublet": [0, 0.10, 0.1012, 0.1025, 0.30, 0.50],
    "stable_high_frequency": [*[round(0.010 * i, 3) for i in range(13)], 0.32, 0.57, 0.87],
}


def golden(spark: SparkSession, trains: dict[str, list[float]] | None = None) -> DataFrame:
    rows = [(k, i, round(t * SCALE)) for k, v in (trains or GOLDEN).items() for i, t in enumerate(v)]
    x = spark.createDataFrame(rows, "train string, event_id long, us long")
    return intervals(x.withColumn("t", F.col("us") / F.lit(SCALE)))
