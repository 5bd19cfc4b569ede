"""Distributions and their comparison, spans, agreement, scaling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window, WindowSpec

from pulsegrid.functions.stats import between, clamp, q, wilson
from pulsegrid.sources.shared import ranked, stored

from .joins import range_join


def by_train() -> WindowSpec:
    return Window.partitionBy("train")


def in_train() -> WindowSpec:
    return by_train().orderBy("idx")


def ecdf_mass(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Per train and threshold: the shares of valid intervals that are at most, and at least, so long."""
    x = rows.where("valid").withColumn("threshold", F.explode(F.array(*[F.lit(v) for v in thresholds])))
    return x.groupBy("train", "threshold").agg(F.avg((F.col("isi") <= F.col("threshold")).cast("double")).alias("at_most"), F.avg((F.col("isi") >= F.col("threshold")).cast("double")).alias("at_least"))


def ks_distance(rows: DataFrame, value: str, side: Column) -> DataFrame:
    """Per train: the largest gap between the distribution functions of the values where side is true and where it's false. Equal values are one step."""
    steps = rows.withColumn("_side", side).groupBy("train", value).agg(F.count_if("_side").alias("_a"), F.count_if(~F.col("_side")).alias("_b"))
    up = Window.partitionBy("train").orderBy(value)
    steps = steps.withColumns({"_fa": F.sum("_a").over(up), "_fb": F.sum("_b").over(up), "_na": F.sum("_a").over(by_train()), "_nb": F.sum("_b").over(by_train())})
    gap = F.abs(F.col("_fa") / F.col("_na") - F.col("_fb") / F.col("_nb"))
    return steps.where("_na > 0 and _nb > 0").groupBy("train").agg(F.max(gap).alias("ks"))


def quantile8(c: str, p: Column) -> Column:
    """Approximately median-unbiased quantile of a sorted array column."""
    n = F.size(c)
    h = (n + F.lit(1 / 3)) * p + F.lit(1 / 3)
    j = F.floor(h)
    at = lambda i: F.get(F.col(c), (F.least(F.greatest(i, F.lit(1)), n) - 1).cast("int"))
    return at(j) + (h - j) * (at(j + 1) - at(j))


def wasserstein(rows: DataFrame, value: str, side: Column, points: int = 101) -> DataFrame:
    """Per train: the mean distance of the two sides' quantiles."""
    two = rows.groupBy("train").agg(F.sort_array(F.collect_list(F.when(side, F.col(value)))).alias("_x"), F.sort_array(F.collect_list(F.when(~side, F.col(value)))).alias("_y")).where((F.size("_x") > 0) & (F.size("_y") > 0))
    two = two.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / F.lit(float(points - 1)))))
    return two.groupBy("train").agg(F.avg(F.abs(quantile8("_x", F.col("_p")) - quantile8("_y", F.col("_p")))).alias("w1"))


QUANTILES = (0.1, 0.5, 0.9, 0.95)


@dataclass(frozen=True)
class _Scan:
    """One pass over rows and spans in the order of train and place: a span is measured once the row behind it is known. What is held is a batch and the rows of open spans, however long a train is.

    Sums and quantiles of spans are taken over runs of their intervals, laid out one after another for at most PAIRS intervals at a time (one span, if it's longer)."""

    quantiles: tuple[float, ...]
    more: tuple[tuple[str, str], ...]
    intervals: bool
    schema: pa.Schema
    context: tuple[int, int] | None = None
    keep: tuple[str, ...] = ()

    @property
    def reach(self) -> int:
        """How many places beside a span belong to its context."""
        return sum(self.context) if self.context else 0

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, spans, last, nth = None, None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            train = batch.column("train")
            new = np.r_[last is not None and train[0] != last, pc.not_equal(train.slice(1), train.slice(0, len(train) - 1)).to_numpy(zero_copy_only=False)].astype(bool)
            code = nth + np.cumsum(new)  # of trains, in the order of this task
            nth, last = int(code[-1]), train[len(train) - 1]
            key = (code << SHIFT) + batch.column("at").to_numpy()
            span = batch.column("side").to_numpy() == 0
            if span.any():
                some = batch.filter(pa.array(span))
                spans = _joined(spans, (key[span] + 1, (code[span] << SHIFT) + some.column("end").to_numpy(), some))
                if not self.keep:
                    spans = _kept(spans, np.r_[True, (np.diff(spans[0]) != 0) | (np.diff(spans[1]) != 0)])  # a span that is given twice is one
            if not span.all():
                rows = _joined(rows, (key[~span], batch.filter(pa.array(~span))))
                yield from self._closed(rows, spans, spans is not None and spans[1] + self.reach < rows[0][-1])
                if spans is not None:
                    spans = _kept(spans, spans[1] + self.reach >= rows[0][-1])
                first = rows[0][-1] if spans is None or not len(spans[0]) else min(int(spans[0].min()) - 1, rows[0][-1])
                rows = _kept(rows, rows[0] >= first - self.reach)
        if rows is not None and spans is not None:
            yield from self._closed(rows, spans, np.ones(len(spans[0]), bool))

    def _closed(self, rows: tuple, spans: tuple | None, done: np.ndarray | bool) -> Iterator[pa.RecordBatch]:
        if spans is None or not np.any(done):
            return
        start, end, table = _kept(spans, done)
        key, frame = rows
        valid = frame.column("valid").to_numpy(zero_copy_only=False)
        isi = _floats(frame.column("isi"))
        beside = lambda k: np.where(key[np.minimum(at := key.searchsorted(k), len(key) - 1)] == k, isi[np.minimum(at, len(key) - 1)], np.nan)
        pre, post = beside(start - 1), beside(end + 1)
        ends = {}
        for i, (how, _) in enumerate(self.more):
            if how in ENDS:
                at = key.searchsorted(k := start if how == "start" else end)
                at = np.minimum(at, len(key) - 1)
                ends[i] = np.where(key[at] == k, _floats(frame.column(f"more{i}"))[at], np.nan)
        used = frame.filter(pa.array(valid))
        key, x = key[valid], isi[valid]
        a, b = key.searchsorted(start), key.searchsorted(end, side="right")
        some = np.flatnonzero(b > a)
        suspect = used.column("suspect").fill_null(False).to_numpy(zero_copy_only=False)
        others = [_floats(used.column(f"more{i}")) for i in range(len(self.more))]
        low, bridge = _floats(table.column("_low")), _floats(table.column("_bridge"))
        order = x.argsort(kind="stable")
        rank = np.empty(len(x), np.int64)
        rank[order] = np.arange(len(x))
        at = 0
        while at < len(some):
            total = np.cumsum((b - a)[some[at:]])
            part = some[at : at + max(1, int(total.searchsorted(PAIRS, side="right")))]
            at += len(part)
            around = self._around(key, x, start[part], end[part]) if self.context else None
            yield self._measured(table.take(pa.array(part)), x, x[order], rank, a[part], b[part], low[part], bridge[part], pre[part], post[part], suspect, others, {i: c[part] for i, c in ends.items()}, around)

    def _around(self, key: np.ndarray, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Medians of the valid intervals at most width places beyond a gap on each side of spans; NaN where there are none."""
        gap, width = self.context
        sides = []
        for first, last in ((start - gap - width, start - gap), (end + gap + 1, end + gap + width + 1)):
            place = key.searchsorted(first)[:, None] + np.arange(width)
            sides.append(np.where(place < key.searchsorted(last)[:, None], x[np.minimum(place, len(x) - 1)], np.nan))
        v = np.sort(np.concatenate(sides, axis=1), axis=1)  # NaN comes last
        n, row = (~np.isnan(v)).sum(1), np.arange(len(v))
        lo, hi = v[row, np.maximum(n - 1, 0) // 2], v[row, np.minimum(n // 2, v.shape[1] - 1)]
        return np.where(n > 0, np.where(lo == hi, lo, between(lo, hi, 0.5)), np.nan)

    def _measured(self, table: pa.RecordBatch, x: np.ndarray, in_order: np.ndarray, rank: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, bridge: np.ndarray, pre: np.ndarray, post: np.ndarray, suspect: np.ndarray, others: list[np.ndarray], ends: dict[int, np.ndarray], around: np.ndarray | None) -> pa.RecordBatch:
        n = b - a
        first = np.r_[0, np.cumsum(n)[:-1]]
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(which)) + np.repeat(a - first, n)
        v = x[place]
        add = lambda c: np.add.reduceat(c, first)
        total, most = add(v), np.maximum.reduceat(v, first)
        mean = total / n
        with np.errstate(all="ignore"):
            cv_ = np.sqrt(add((v - mean[which]) ** 2) / (n - 1)) / mean
            mm_ = most / mean
            pair = 3 * (v[:-1] - v[1:]) ** 2 / (v[:-1] + v[1:]) ** 2
        pair = np.r_[np.nan, pair]
        pair[first] = np.nan  # the first of a span has none before it
        known = ~np.isnan(pair)
        lv = _mean(add(np.where(known, pair, 0.0)), add(known.astype(np.int64)))
        # one sort of whole numbers, span and rank of the interval: several times as fast as one by two keys
        ranks = (which << SHIFT) | rank[place]
        ranks.sort()
        sorted_ = in_order[ranks & ((1 << SHIFT) - 1)]
        out = [table.column("train"), table.column("at"), table.column("end"), n, mean, most, total, np.where(n > 1, cv_, np.nan), mm_, add((v <= low[which]).astype(np.int64)), add(((v > low[which]) & (v <= bridge[which])).astype(np.int64)), add(suspect[place].astype(np.int64)), lv]
        out[1] = table.column("at").to_numpy() + 1
        for p in self.quantiles:
            h = (n - 1) * p
            i, j = np.floor(h).astype(np.int64), np.ceil(h).astype(np.int64)
            lo, hi = sorted_[first + i], sorted_[first + j]
            out.append(np.where((i == j) | (lo == hi), lo, between(lo, hi, h - i)))
        out += [pre, post]
        for i, ((how, _), c) in enumerate(zip(self.more, others, strict=True)):
            if i in ends:
                out.append(ends[i])
                continue
            c = c[place]
            known = ~np.isnan(c)
            if how == "count":
                out.append(add((known & (c != 0)).astype(np.int64)))
            elif how == "max":
                out.append(np.where(add(known.astype(np.int64)) > 0, np.maximum.reduceat(np.where(known, c, -np.inf), first), np.nan))
            else:
                out.append(_mean(add(np.where(known, c, 0.0)), add(known.astype(np.int64))))
        out += [table.column(f"keep{i}") for i in range(len(self.keep))]
        if around is not None:
            out.append(around)
        if self.intervals:
            out.append(pa.ListArray.from_arrays(pa.array(np.r_[first, len(v)], pa.int32()), pa.array(v)))
        return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type, mask=np.isnan(c)) if c.dtype.kind == "f" else pa.array(c, f.type) for c, f in zip(out, self.schema, strict=True)], schema=self.schema)


#: Further measures that are the value of a column in the first or last row of a span, valid or not.
ENDS = ("start", "end")
#: Bits of a place within its train, and intervals of spans that are laid out at once.
SHIFT, PAIRS = 32, 2_000_000


def _floats(c: pa.Array) -> np.ndarray:
    return c.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _mean(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, total / np.maximum(n, 1), np.nan)


def _joined(held: tuple | None, new: tuple) -> tuple:
    if held is None or not len(held[0]):
        return new
    return tuple(np.r_[h, n] if isinstance(n, np.ndarray) else pa.concat_batches([h, n]) for h, n in zip(held, new, strict=True))


def _kept(held: tuple, keep: np.ndarray) -> tuple:
    return held if keep.all() else tuple(h[keep] if isinstance(h, np.ndarray) else h.filter(pa.array(keep)) for h in held)


def span_metrics(
    rows: DataFrame, spans: DataFrame, low: float | Column, bridge: float | Column, quantiles: tuple[float, ...] = QUANTILES, intervals: bool = False, context: tuple[int, int] | None = None, keep: tuple[str, ...] = (), **more: tuple[str, str]
) -> DataFrame:
    """Per span (train, start, end) that holds valid intervals: quantiles, variability, flanks, contrast, and how many of its intervals are core (<= low) or bridge (columns of spans, or the same for all).
    Rows and spans are one timeline of each train, shuffled and sorted once, and scanned; pairs of spans and intervals are never rows.

    more: further measures by name, each max, avg or count (of true ones), start or end (the value in the first or last row), and the column of rows that it is taken of. With intervals, they are given as a list (isi_values), in order.
    With context (gap, width), context is the median of the valid intervals at up to width places beyond a gap on each side.
    keep: columns of spans that go through; a span that is given twice is then two."""
    types, listed = dict(rows.dtypes), list(more.items())
    ends = {"_low": low if isinstance(low, Column) else F.lit(low), "_bridge": bridge if isinstance(bridge, Column) else F.lit(bridge)}
    none = F.lit(None)
    at = rows.select("train", F.col("idx").cast("long").alias("at"), F.lit(1).alias("side"), none.cast("long").alias("end"), F.col("valid").alias("valid"), F.col("isi").cast("double").alias("isi"), F.col("suspect").cast("boolean").alias("suspect"),
                     *[none.cast("double").alias(k) for k in ends], *[F.col(c).cast("double").alias(f"more{i}") for i, (_, (_, c)) in enumerate(listed)], *[none.cast(spans.schema[c].dataType).alias(f"keep{i}") for i, c in enumerate(keep)])
    wanted = spans.select("train", (F.col("start").cast("long") - 1).alias("at"), F.lit(0).alias("side"), F.col("end").cast("long").alias("end"), F.lit(False).alias("valid"), none.cast("double").alias("isi"), F.lit(False).alias("suspect"),
                          *[v.cast("double").alias(k) for k, v in ends.items()], *[none.cast("double").alias(f"more{i}") for i in range(len(listed))], *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)])
    train = types["train"]
    schema = ", ".join([f"train {train}, start long, end long, n_isi long, mean_isi double, max_isi double, duration double, cv double, mm double, core long, bridges long, suspects long, lv double", *[f"q{round(p * 100)} double" for p in quantiles], "pre double, post double",
                        *[f"{k} {'long' if how == 'count' else 'double'}" for k, (how, _) in listed], *[f"`{c}` {spans.schema[c].dataType.simpleString()}" for c in keep], *(["context double"] if context else []), *(["isi_values array<double>"] if intervals else [])])
    scan = _Scan(tuple(quantiles), tuple(v for _, v in listed), intervals, to_arrow_schema(StructType.fromDDL(schema)), context, keep)
    # by a hash of its own: Spark 4.1 takes a union of two sides that are each shuffled by train for shuffled, though they can be coalesced differently, and would leave a train's rows and spans apart
    timeline = at.where("train is not null").unionByName(wanted.where("train is not null")).repartition(F.xxhash64("train")).sortWithinPartitions("train", "at", "side", "end")
    out = timeline.mapInArrow(lambda batches: scan(batches), schema)
    kinds = dict(spans.dtypes)
    out = out.withColumns({"start": F.col("start").cast(kinds["start"]), "end": F.col("end").cast(kinds["end"])} | {k: F.col(k).cast(types[c]) for k, (how, c) in listed if how == "max"})
    a, b = F.col("pre") / F.col("q90"), F.col("post") / F.col("q90")
    return out.withColumns({"pre_ratio": a, "post_ratio": b, "contrast": F.when(a.isNotNull() & b.isNotNull(), F.least(a, b)), "geometric": F.exp((F.ln(a) + F.ln(b)) / 2), "percent": 100 * (F.least(F.col("pre"), F.col("post")) / F.col("q90") - 1)})


def regularity(cv_: Column, lv: Column, q90: Column, q10: Column) -> Column:
    return (clamp(1 - clamp(cv_ / 0.5)) + clamp(1 - clamp(lv / 0.5)) + clamp(1 - clamp(q90 / q10 - 1))) / 3


def first_mode(c: Column) -> Column:
    """The most frequent non-blank value, the smallest on ties."""
    return F.mode(F.when(F.trim(c) != "", c), True)


def anchors(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median centre, spread of the logarithms (median absolute deviation, with floors by count) and confidence of labels by hand."""
    x = values.groupBy(*keys).agg(q(value, 0.5).alias("centre"), F.count(value).alias("n"))
    ln = F.abs(F.ln(value) - F.ln("centre"))
    spread = values.join(x, keys).groupBy(*keys).agg((q(ln, 0.5) * 1.4826).alias("_mad"))
    floor = F.when(F.col("n") < 3, 0.8).when(F.col("n") < 8, 0.55).otherwise(0.3)
    return x.join(spread, keys).select(*keys, "centre", "n", F.greatest("_mad", floor).alias("spread"), (F.col("n") / (F.col("n") + 6)).alias("confidence"))


def confusion(rows: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts of (truth, pred); blank and null labels are none."""
    name = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", "none").otherwise(F.trim(c))
    return rows.groupBy(name(truth).alias("truth"), name(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(table: DataFrame) -> DataFrame:
    """Precision, recall and F1 (null when both are 0 or undefined) of every class in a confusion table, with score intervals of recall."""
    t = table.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("truth_n"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = table.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("pred_n"))
    x = t.join(p, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("truth_n", "pred_n", "tp")])
    precision, recall = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")), F.when(F.col("truth_n") > 0, F.col("tp") / F.col("truth_n"))
    low, high = wilson(F.col("tp"), F.col("truth_n"))
    x = x.withColumns({"precision": precision, "recall": recall, "recall_low": low, "recall_high": high})
    return x.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def agreement(table: DataFrame) -> DataFrame:
    """Accuracy, balanced accuracy and Cohen's kappa of a confusion table."""
    m = class_metrics(table).agg(F.sum("truth_n").alias("n"), F.sum("tp").alias("hit"), F.sum(F.col("truth_n") * F.col("pred_n")).alias("chance"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))
    po, pe = F.col("hit") / F.col("n"), F.col("chance") / F.col("n") / F.col("n")
    return m.select("n", po.alias("accuracy"), "balanced_accuracy", "macro_f1", F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def scaled(rows: DataFrame, columns: list[str], robust: bool = True) -> DataFrame:
    """Columns with nulls set to the train's median, then centred and scaled: median and MAD (deviation where the MAD is 0), or mean and deviation."""
    w = lambda f: f.over(by_train())
    for c in columns:
        rows = rows.withColumn(c, F.coalesce(F.col(c), w(q(c, 0.5))))
        rows = rows.withColumn("_c", w(q(c, 0.5)) if robust else w(F.avg(c)))
        rows = rows.withColumn("_d", F.abs(F.col(c) - F.col("_c"))).withColumn("_s", w(q("_d", 0.5)) * 1.4826 if robust else w(F.stddev_samp(c)))
        sd = F.when(F.col("_s") > 0, F.col("_s")).otherwise(w(F.stddev_samp(c)))
        rows = rows.withColumn(f"{c}_scaled", F.when(sd > 0, (F.col(c) - F.col("_c")) / sd).otherwise(0.0)).drop("_c", "_d", "_s")
    return rows


def distributional_support(rows: DataFrame, spans: DataFrame, flank: int = 10, short: float = 0.02) -> DataFrame:
    """Spans against their train: the share of short intervals inside, in the flanks of up to `flank` valid intervals a side, and in the whole train; and a verdict."""
    at = rows.where("valid").select("train", F.col("idx").alias("start"), F.col("idx").alias("end"), "isi")
    wide = spans.select("train", (F.col("start") - flank).alias("start"), (F.col("end") + flank).alias("end"), F.col("start").alias("a"), F.col("end").alias("b"))
    x = range_join(wide, at, ["train"]).withColumn("_in", F.col("r_start").between(F.col("l_a"), F.col("l_b")))
    is_short = (F.col("r_isi") <= short).cast("double")
    o = x.groupBy("train", F.col("l_a").alias("start"), F.col("l_b").alias("end")).agg(F.avg(F.when(F.col("_in"), is_short)).alias("inside"), F.avg(F.when(~F.col("_in"), is_short)).alias("flanks"))
    g = rows.where("valid").groupBy("train").agg(F.avg((F.col("isi") <= short).cast("double")).alias("whole"))
    o = o.join(g, "train")
    verdict = F.when(F.col("inside").isNull(), "unresolved").when((F.col("inside") - F.coalesce("flanks", "whole") >= 0.5) & (F.col("inside") > F.col("whole")), "supported").when(F.col("inside") <= F.col("whole"), "not_supported").otherwise("weak")
    return o.withColumn("verdict", verdict)


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, span: int = 10_000) -> DataFrame:
    """df plus q: adjusted p-values within keys; null where p is. Without keys rows are numbered by ranges of p, and the least value of all later rows comes from spans of
    that many rows and from a row for each span."""
    if keys:
        w = Window.partitionBy(*keys)
        n = F.count(p).over(w)
        last = F.count(p).over(w.orderBy(p))  # of ties the last rank counts
        return df.withColumn("_a", F.least(F.col(p) * n / last, F.lit(1.0))).withColumn("q", F.min("_a").over(w.orderBy(F.desc(p)))).drop("_a")
    x = stored(ranked(df.where(F.col(p).isNotNull()), F.col(p), name="_k"), "ranked-p")
    n = x.count()
    x = x.withColumns({"_a": F.least(F.col(p) * F.lit(n) / (F.col("_k") + 1), F.lit(1.0)), "_span": F.floor(F.col("_k") / span)})
    spans = x.groupBy("_span").agg(F.min("_a").alias("_least"))
    later = spans.select("_span", F.min("_least").over(Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    here = F.min("_a").over(Window.partitionBy("_span").orderBy(F.desc("_k")))
    out = x.withColumn("_here", here).join(later, "_span").withColumn("q", F.least("_here", "_later")).drop("_k", "_a", "_span", "_here", "_later")
    return out.unionByName(df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))
