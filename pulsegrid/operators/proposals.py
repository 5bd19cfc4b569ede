"""Bursts proposed by contrast with their surroundings, their best boundaries, and regular packets beside bursts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from pulsegrid.sources.shared import stored

from .gates import BURSTS
from .joins import range_join
from .medians import whole_trains, with_medians
from .runs import in_train, runs
from .statistics import span_metrics


@dataclass(frozen=True)
class Context:
    """What a burst must show against the medians of the five valid intervals on each side."""

    spikes: int = 3
    near: int = 5
    widths: tuple[int, int] = (2, 8)
    propose: tuple[float, float] = (1.20, 1.30)
    compression: float = 1.40
    burst: tuple[float, float, float] = (1.80, 1.80, 0.65)
    possible: tuple[float, float, float] = (1.25, 1.35, 0.35)
    mm: float = 2.5
    lv: float = 1.5
    radius: int = 1


def _ratios(pre: Column, post: Column, core: Column) -> tuple[Column, Column]:
    """Least and geometric mean of the ratios of both sides to the core; of one if there is only one."""
    a, b = (F.when((c > 0) & (core > 0), c / core) for c in (pre, post))
    return F.least(a, b), F.exp(F.when(a.isNotNull() & b.isNotNull(), (F.ln(a) + F.ln(b)) / 2).otherwise(F.ln(F.coalesce(a, b))))


def surrounded(rows: DataFrame, g: Context | None = None) -> DataFrame:
    """(train, idx, isi, valid, artifact, suspect) with before and after, the medians of the nearest valid intervals on each side, and local_median, that of the valid ones in up to five rows on each side: what
    proposals and their scores ask of each row, found once. rows that have these columns are left as they are."""
    if {"before", "after", "local_median"} <= set(rows.columns):
        return rows
    x = rows.select("train", "idx", "isi", "valid", "artifact", "suspect", F.when(F.col("valid"), F.col("isi")).alias("_x"))
    return stored(with_medians(x, {"local_median": ("_x", 5)}, (g or Context()).near, "_x").drop("_x"), "surroundings")


def scored(rows: DataFrame, spans: DataFrame, g: Context | None = None) -> DataFrame:
    """Spans (train, start, end) with their contrast to the medians of the nearest valid intervals on both sides (least, geometric), a score, and a class: burst, possible_burst or reject. Spans with too few
    spikes, or without any side, aren't scored."""
    g = g or Context()
    # a span that is given twice is measured once
    m = span_metrics(surrounded(rows, g), spans.select("train", "start", "end"), 0.0, 0.0, before=("start", "before"), after=("end", "after"))
    n = F.col("end") - F.col("start") + 2
    least, geometric = _ratios(F.col("before"), F.col("after"), F.col("q90"))
    m = m.where((n >= g.spikes) & (F.col("n_isi") >= max(1, g.spikes - 1)) & (F.col("start") >= 2)).withColumns({"least": least, "geometric": geometric, "sides": F.col("before").isNotNull().cast("int") + F.col("after").isNotNull().cast("int")})
    middle = F.when(F.col("sides") == 2, (F.col("before") + F.col("after")) / 2).otherwise(F.coalesce("before", "after"))
    score = F.ln(F.greatest("geometric", F.lit(1e-9))) + 0.10 * F.ln(n) + 0.10 * F.coalesce(F.ln(F.greatest(middle / F.col("q90"), F.lit(1e-9))), F.lit(0.0))
    score = score - 0.10 * F.greatest(F.lit(0.0), F.coalesce("mm", F.lit(0.0)) - g.mm) - 0.05 * F.greatest(F.lit(0.0), F.coalesce("lv", F.lit(0.0)) - g.lv)
    m = m.where("geometric is not null").withColumn("score", score)
    reach = lambda t: (F.col("least") >= t[0]) & (F.col("geometric") >= t[1]) & (F.col("score") >= t[2])
    kind = F.when((F.col("sides") >= 2) & reach(g.burst), "burst").when((F.col("sides") >= 2) & reach(g.possible), "possible_burst").otherwise("reject")
    return m.select("train", "start", "end", "least", "geometric", "score", kind.alias("class"))


def _windows(t: pa.RecordBatch, code: np.ndarray, width: int, kind: pa.Schema) -> pa.RecordBatch:
    """Windows of a width, of rows of whole trains, that have valid intervals only, one short one, and something on both sides: with the medians of the sides and their 90% quantile."""
    x, before, after = (t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("isi", "before", "after"))
    sums = {c: np.r_[0, np.cumsum(t.column(c).to_numpy(zero_copy_only=False).astype(np.int64))] for c in ("valid", "_c")}
    idx = t.column("idx").to_numpy()
    at = np.arange(max(0, len(x) - width + 1))
    inside = {c: v[at + width] - v[at] for c, v in sums.items()}
    last = at + width - 1
    at = at[(code[at] == code[last]) & (inside["valid"] == width) & (inside["_c"] > 0) & (idx[at] >= 2) & ~np.isnan(before[at]) & ~np.isnan(after[last])]
    v = np.sort(x[at[:, None] + np.arange(width)], axis=1)
    h = (width - 1) * 0.9
    q90 = v[:, math.floor(h)] + (h - math.floor(h)) * (v[:, math.ceil(h)] - v[:, math.floor(h)])
    out = [t.column("train").take(pa.array(at)), idx[at], idx[at] + width - 1, before[at], after[at + width - 1], q90]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(out, kind, strict=True)], schema=kind)


def context_windows(rows: DataFrame, g: Context | None = None) -> DataFrame:
    """Windows (train, start, end) of the given widths, of valid intervals only, that stand out from the nearest valid intervals on both sides and hold one that is short for its surroundings. Each row looks
    at the few that follow it, so this is one scan of a train."""
    g = g or Context()
    low, high = g.widths
    ratio = max(1.10, g.compression * 0.75)
    x = surrounded(rows, g).withColumn("_c", F.coalesce(F.col("valid") & (F.col("local_median") > 0) & (F.col("isi") <= F.col("local_median") / ratio), F.lit(False)))
    dtype = dict(x.dtypes)
    schema = f"train {dtype['train']}, start {dtype['idx']}, end {dtype['idx']}, before double, after double, q90 double"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, code in whole_trains(batches):
            for width in range(low, high + 1):
                yield _windows(t, code, width, kind)

    x = x.select("train", "idx", "isi", "valid", "_c", "before", "after").repartition("train").sortWithinPartitions("train", "idx").mapInArrow(run, schema)
    least, geometric = _ratios(F.col("before"), F.col("after"), F.col("q90"))
    return x.where((least >= g.propose[0]) & (geometric >= g.propose[1])).select("train", "start", "end")


def seed_blocks(rows: DataFrame, seed: float = 0.02, bridge: float = 0.03, connectors: int = 1, g: Context | None = None) -> DataFrame:
    """Blocks (train, start, end) of short intervals: at most seed, or short for their surroundings. Artifacts after one belong to it, and blocks are one across artifacts and a few intervals that are at most
    bridge or nearly short for their surroundings."""
    g = g or Context()
    up = in_train().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("train").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    no = lambda c: F.coalesce(c, F.lit(False))
    x = surrounded(rows, g)
    real = F.col("isi").isNotNull() & ~F.col("artifact")
    short = lambda r: no(F.col("local_median") > 0) & no(F.col("isi") <= F.col("local_median") / r)
    x = x.withColumns({"_s": real & (no(F.col("isi") <= seed) | short(g.compression)), "_a": no(F.col("artifact")) & (F.col("idx") > 1)})
    x = x.withColumn("_ok", real & (no(F.col("isi") <= bridge) | short(max(1.10, g.compression * 0.85))))
    stop = ~F.col("_s") & ~F.col("_a")
    x = x.withColumns({"_prev": F.max(F.when(F.col("_s"), F.col("idx"))).over(up), "_stop": F.max(F.when(stop, F.col("idx"))).over(up), "_n": F.sum(stop.cast("int")).over(up), "_bad": F.sum((stop & ~F.col("_ok")).cast("int")).over(up)})
    counts = F.when(F.col("_s"), F.struct(F.col("_n").alias("n"), F.col("_bad").alias("bad")))  # as they stand at the last and at the next short interval
    x = x.withColumn("_at", F.last(counts, True).over(up)).withColumn("_to", F.last(counts, True).over(down))
    tail = F.col("_a") & no(F.col("_prev") > F.coalesce("_stop", F.lit(0)))
    gap = no((F.col("_to.n") - F.col("_at.n") <= connectors) & (F.col("_to.bad") == F.col("_at.bad")))
    return runs(x, F.col("_s") | tail | gap).select("train", "start", "end")


def optimised(rows: DataFrame, spans: DataFrame, g: Context | None = None) -> DataFrame:
    """spans (train, start, end) with best_start, best_end, score and class: of all spans whose ends lie within the radius of theirs the one with the best score, the first start and then the first end on ties. Each
    different span is scored once, whatever number of candidates it is a variant of. Spans without a variant to score are left out."""
    g = g or Context()
    last = rows.groupBy("train").agg(F.max("idx").alias("_last"))
    shifts = F.array(*[F.lit(k) for k in range(-g.radius, g.radius + 1)])
    v = spans.select("train", "start", "end").distinct().join(last, "train").withColumn("_a", F.explode(shifts)).withColumn("_b", F.explode(shifts))
    v = v.withColumns({"best_start": F.col("start") + F.col("_a"), "best_end": F.col("end") + F.col("_b")}).where("best_start between 2 and _last and best_end between best_start and _last")
    v = stored(v.select("train", "start", "end", "best_start", "best_end"), "span-variants")
    s = scored(rows, v.select("train", F.col("best_start").alias("start"), F.col("best_end").alias("end")), g)
    s = s.select("train", F.col("start").alias("best_start"), F.col("end").alias("best_end"), "score", "class")
    first = F.row_number().over(Window.partitionBy("train", "start", "end").orderBy(F.desc("score"), "best_start", "best_end"))
    return v.join(s, ["train", "best_start", "best_end"]).withColumn("_k", first).where("_k = 1").select("train", "start", "end", "best_start", "best_end", "score", "class")


def sliding_context(rows: DataFrame, seed: float = 0.02, bridge: float = 0.03, g: Context | None = None) -> DataFrame:
    """Bursts (train, start, end, score, class) of seed blocks and context windows with their best boundaries, each span once."""
    rows = surrounded(rows, g)
    props = stored(seed_blocks(rows, seed, bridge, g=g).unionByName(context_windows(rows, g)).distinct(), "proposals")
    x = optimised(rows, props, g).where("class <> 'reject'")
    return x.groupBy("train", F.col("best_start").alias("start"), F.col("best_end").alias("end")).agg(F.first("score").alias("score"), F.first("class").alias("class"))


@dataclass(frozen=True)
class Packet:
    """What makes a run of intervals beside a burst a regular packet."""

    labels: tuple[str, ...] = ("burst", "long_burst")
    widths: tuple[int, int] = (4, 16)
    gap: int = 0
    gap_seconds: float = 0.0
    low: float = 0.012
    high: float = 0.060
    cv: float = 0.45
    lv: float = 0.60
    mm: float = 1.65
    spread: float = 2.40
    ratio: float = 1.35
    overlap: float = 0.5


def regular_packets(rows: DataFrame, label: str = "auto", p: Packet | None = None) -> DataFrame:
    """(train, burst_start, burst_end, burst_label, side, gap, start, end, measures, score): regular packets right before or after bursts (runs of the labels), each with the burst that it belongs to.

    A packet has valid intervals only, none of them in a burst, keeps to its own gates of regularity, and is slower than its burst. Of packets of one burst and side those overlap a better one by half of the
    shorter are left out; a burst has some tens at most, so that is decided in the row of its burst."""
    p = p or Packet()
    parents = stored(runs(rows, F.col(label).isin(*p.labels), F.mode(label, True).alias("burst_label")).select("train", "start", "end", "burst_label"), "bursts")
    q = span_metrics(rows, parents, 0.0, 0.0).select("train", F.col("start").alias("burst_start"), F.col("end").alias("burst_end"), F.col("q50").alias("burst_median"), F.col("q90").alias("burst_q90"))
    last = rows.groupBy("train").agg(F.max("idx").alias("_last"))
    c = parents.select("train", F.col("start").alias("burst_start"), F.col("end").alias("burst_end"), "burst_label").join(last, "train")
    c = c.withColumn("side", F.explode(F.array(F.lit("regular_before_burst"), F.lit("regular_after_burst")))).withColumn("gap", F.explode(F.sequence(F.lit(0), F.lit(p.gap)))).withColumn("width", F.explode(F.sequence(*[F.lit(w) for w in p.widths])))
    c = c.withColumn("start", F.when(F.col("side") == "regular_before_burst", F.col("burst_start") - F.col("gap") - F.col("width")).otherwise(F.col("burst_end") + 1 + F.col("gap")))
    c = c.withColumn("end", F.col("start") + F.col("width") - 1).where("start >= 3 and end <= _last - 1")
    c = stored(c.drop("_last"), "packet-spans").hint("merge")  # tens of spans for each burst in a small file: not to be broadcast
    inside = rows.withColumn("suspect", F.coalesce(F.col(label).isin(*BURSTS), F.lit(False)))
    m = span_metrics(inside, c.select("train", "start", "end").distinct(), 0.0, 0.0)
    labelled = inside.where("suspect").select("train", F.col("idx").alias("start"), F.col("idx").alias("end"))  # invalid intervals can be labelled as well
    taken = range_join(c.select("train", "start", "end").distinct(), labelled, ["train"]).select("train", F.col("l_start").alias("start"), F.col("l_end").alias("end")).distinct()
    x = c.join(m, ["train", "start", "end"]).where("n_isi = width").join(taken, ["train", "start", "end"], "left_anti").join(q, ["train", "burst_start", "burst_end"])
    if p.gap:
        a, b = (F.when(F.col("side") == "regular_before_burst", v).otherwise(w) for v, w in ((F.col("end") + 1, F.col("burst_end") + 1), (F.col("burst_start") - 1, F.col("start") - 1)))
        gaps = x.where("gap > 0").select("train", a.alias("start"), b.alias("end")).distinct()
        sums = span_metrics(rows, gaps, 0.0, 0.0).select("train", F.col("start").alias("_ga"), F.col("end").alias("_gb"), F.col("duration").alias("_sum"), F.col("n_isi").alias("_gn"))
        x = x.withColumns({"_ga": a, "_gb": b}).join(sums, ["train", "_ga", "_gb"], "left").where((F.col("gap") == 0) | ((F.col("_gn") == F.col("gap")) & (F.col("_sum") <= p.gap_seconds)))
    x = x.withColumns({"gap_seconds": F.coalesce("_sum", F.lit(0.0)) if p.gap else F.lit(0.0), "ratio_median": F.col("q50") / F.col("burst_median"), "ratio_q90": F.col("q90") / F.col("burst_q90")})
    fine = (F.col("q10") >= p.low) & (F.col("q90") <= p.high) & (F.col("cv") <= p.cv) & (F.col("lv") <= p.lv) & (F.col("mm") <= p.mm) & (F.col("q90") / F.col("q10") <= p.spread) & (F.col("ratio_q90") >= p.ratio)
    score = 2.2 - F.col("cv") - 0.7 * F.col("lv") - 0.25 * F.greatest(F.lit(0.0), F.col("mm") - 1) + 0.08 * F.ln(F.col("width") + 1) + 0.35 * F.ln(F.greatest(F.lit(1.01), F.col("ratio_q90"))) + F.when(F.col("gap") == 0, 0.2).otherwise(0.0)
    x = x.where(fine).withColumn("score", score)
    fields = ["gap", "start", "end", "gap_seconds", "q50", "q90", "cv", "lv", "mm", "ratio_median", "ratio_q90", "score"]
    key = ["train", "burst_start", "burst_end", "burst_label", "side"]
    each = x.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_o"), *fields))).alias("_all"))  # widths x gaps at most
    share = lambda a, b: (F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]) + 1) / F.least(a["end"] - a["start"] + 1, b["end"] - b["start"] + 1)
    none = F.slice("_all", 1, 0)
    kept = F.aggregate("_all", none, lambda done, c: F.when(F.exists(done, lambda d: share(c, d) >= p.overlap), done).otherwise(F.concat(done, F.array(c))))
    return each.select(*key, F.inline(kept)).drop("_o")


@dataclass(frozen=True)
class Bridge:
    """What may lie between two seeds of one burst, against the seeds' own scale."""

    most: int = 1
    inflate: float = 1.25
    inflate_most: float = 1.75
    lv: tuple[float, float] = (0.15, 0.35)
    mm: tuple[float, float] = (0.10, 1.20)
    ratio: float = 3.50
    possible: float = 5.00
    raw: float | None = None
    percent: float = 35.0
    margin: float = 10.0


def _percents(rows: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """values plus pct: the share, in percent, of the train's valid intervals that are at most the value. Both go through one sorted scan of the train."""
    both = values.select("*", F.lit(0).alias("_one")).unionByName(rows.where("valid").select("train", F.col("isi").alias(value), F.lit(1).alias("_one")), allowMissingColumns=True)
    train = Window.partitionBy("train")
    share = 100 * F.sum("_one").over(train.orderBy(value)) / F.sum("_one").over(train)
    return both.withColumn("pct", share).where("_one = 0").drop("_one")


def seed_bridges(rows: DataFrame, seeds: DataFrame, b: Bridge | None = None) -> DataFrame:
    """(train, left, right, gap_n, gap_max, inflate, ratio, pct, score, class) of every two neighbouring seeds (train, start, end) with few valid intervals between them: accepted, possible or reject.

    The longest interval between them is measured against the longer of the seeds' 90% quantiles, inflated the more the seeds vary; and it must not stand too high among the train's intervals. Neighbours are found
    by a window over the seeds."""
    b = b or Bridge()
    m = span_metrics(rows, seeds, 0.0, 0.0).select("train", "start", "end", F.col("q90").alias("q"), "lv", "mm")
    m = _percents(rows, m, "q")
    order = Window.partitionBy("train").orderBy("start")
    x = m.select("*", *[F.lead(c).over(order).alias(f"_{c}") for c in ("start", "end", "q", "lv", "mm", "pct")]).withColumn("gap_n", F.col("_start") - F.col("end") - 1).where(F.col("gap_n").between(0, b.most))
    x = stored(x.withColumns({"ga": F.col("end") + 1, "gb": F.col("_start") - 1}), "seed-pairs")
    pct = F.when(F.col("valid"), 100 * F.cume_dist().over(Window.partitionBy("train", "valid").orderBy("isi")))
    ranked_rows = rows.withColumn("_pct", pct)
    gaps = span_metrics(ranked_rows, x.where("gap_n > 0").select("train", F.col("ga").alias("start"), F.col("gb").alias("end")), 0.0, 0.0, pct=("max", "_pct"))
    gaps = gaps.select("train", F.col("start").alias("ga"), F.col("n_isi").alias("_gn"), F.col("max_isi").alias("gap_max"), F.col("pct").alias("gap_pct"))
    whole = span_metrics(rows, x.select("train", "start", F.col("_end").alias("end")), 0.0, 0.0).select("train", "start", F.col("end").alias("_end"), "geometric")
    x = x.join(gaps, ["train", "ga"], "left").where((F.col("gap_n") == 0) | (F.col("_gn") == F.col("gap_n"))).join(whole, ["train", "start", "_end"])
    middle = lambda c: F.coalesce((F.col(c) + F.col(f"_{c}")) / 2, F.col(c), F.col(f"_{c}"))
    grown = 1 + b.lv[0] * F.greatest(F.lit(0.0), F.coalesce(middle("lv"), F.lit(0.0)) - b.lv[1]) + b.mm[0] * F.greatest(F.lit(0.0), F.coalesce(middle("mm"), F.lit(1.0)) - b.mm[1])
    x = x.withColumn("inflate", F.greatest(F.lit(1.0), F.least(b.inflate * grown, F.lit(b.inflate * b.inflate_most))))
    x = x.withColumn("ref", F.greatest("q", "_q") * F.col("inflate")).withColumn("ratio", F.coalesce("gap_max", F.lit(0.0)) / F.col("ref"))
    allowed = F.least(F.lit(100.0), F.greatest(F.greatest("pct", "_pct") + b.margin, F.lit(b.percent)))
    low, raw = F.col("gap_pct") <= allowed, F.lit(True) if b.raw is None else F.col("gap_max") <= b.raw
    kind = F.when(F.col("gap_n") == 0, "accepted").when(raw & low & (F.col("ratio") <= b.ratio), "accepted").when(raw & low & (F.col("ratio") <= b.possible), "possible").otherwise("reject")
    part = lambda c: F.coalesce(F.when(c > 0, F.ln(c)), F.lit(0.0))
    score = -part(F.col("ratio")) + part(F.col("geometric")) + 0.05 * part(F.col("ref") / F.col("gap_max")) - 0.005 * F.greatest(F.lit(0.0), F.coalesce("gap_pct", F.lit(0.0)) - b.percent)
    return x.select("train", F.col("start").alias("left"), F.col("_start").alias("right"), F.col("gap_n").cast("int").alias("gap_n"), "gap_max", "inflate", "ratio", F.col("gap_pct").alias("pct"), score.alias("score"), kind.alias("class"))


def bridged_seeds(seeds: DataFrame, bridges: DataFrame) -> DataFrame:
    """(train, start, end, seeds): chains of seeds whose bridges are accepted."""
    order = Window.partitionBy("train").orderBy("start")
    joined = bridges.where("class = 'accepted'").select("train", F.col("right").alias("start"), F.lit(0).alias("_new"))
    x = seeds.join(joined, ["train", "start"], "left").withColumn("_chain", F.sum(F.coalesce("_new", F.lit(1))).over(order))
    return x.groupBy("train", "_chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("seeds")).drop("_chain")
