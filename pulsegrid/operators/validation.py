"""Comparing detected events with events by hand: matches, errors, intervals of confidence, calibration, sensitivity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from pulsegrid.functions.stats import lv_pair
from pulsegrid.sources.shared import ranked, stored

from .joins import iou, range_join


#: The ends of a pair of events.
ENDS = ("pred_start", "pred_end", "truth_start", "truth_end")


def overlaps(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of predicted and true events (columns train, label, start, end) that overlap, with their IoU; only equal keys meet."""
    p = range_join(pred, truth, keys).withColumn("iou", iou(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end")))
    return p.select(*keys, *[F.col(f"l_{c}").alias(f"pred_{c}") for c in ("label", "start", "end") if c not in keys], *[F.col(f"r_{c}").alias(f"truth_{c}") for c in ("label", "start", "end") if c not in keys], "iou")


def matched(pred: DataFrame, truth: DataFrame, least: float = 0.25, keys: tuple[str, ...] = ("train", "label")) -> DataFrame:
    """Greedy one-to-one matches within keys: pairs of the largest IoU first (then by predicted and true start), each event once. The pairs that can match at all come from a join;
    the scan of a partition's pairs, key by key, is what makes them one to one; it holds the events of one key."""
    pairs = overlaps(pred, truth, list(keys)).where(F.col("iou") >= least)
    kind = to_arrow_schema(pairs.schema)

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen_p, seen_t = None, set(), set()
        for batch in batches:
            c = {name: batch.column(name).to_pylist() for name in (*keys, *ENDS)}
            keep = []
            for i, (key, a, b, d, e) in enumerate(zip(zip(*(c[k] for k in keys), strict=True), *(c[k] for k in ENDS), strict=True)):
                if key != now:  # it may have begun in the batch before
                    now, seen_p, seen_t = key, set(), set()
                if (a, b) not in seen_p and (d, e) not in seen_t:
                    seen_p.add((a, b))
                    seen_t.add((d, e))
                    keep.append(i)
            if keep:
                yield from pa.Table.from_batches([batch]).take(keep).cast(kind).combine_chunks().to_batches()

    ordered = pairs.repartition(*keys).sortWithinPartitions(*keys, F.desc("iou"), "pred_start", "truth_start", "pred_end", "truth_end")
    return ordered.mapInArrow(greedy, pairs.schema)


def match_table(pred: DataFrame, truth: DataFrame, least: float = 0.25) -> DataFrame:
    """Each event once: TP with its boundary errors, label_confusion (matches an event of another label), extra_detector_event or missed_manual_event."""
    m = stored(matched(pred, truth, least), "matches")
    tp = m.select("train", "label", F.lit("TP").alias("kind"), "pred_start", "pred_end", "truth_start", "truth_end", "iou", (F.col("pred_start") - F.col("truth_start")).alias("start_error"), (F.col("pred_end") - F.col("truth_end")).alias("end_error"))
    left = pred.join(m.select("train", "label", F.col("pred_start").alias("start"), F.col("pred_end").alias("end")), ["train", "label", "start", "end"], "left_anti")
    missed = truth.join(m.select("train", "label", F.col("truth_start").alias("start"), F.col("truth_end").alias("end")), ["train", "label", "start", "end"], "left_anti")
    other = overlaps(left, truth, ["train"]).where((F.col("iou") >= least) & (F.col("pred_label") != F.col("truth_label")))
    near = other.groupBy("train", F.col("pred_label").alias("label"), F.col("pred_start").alias("start"), F.col("pred_end").alias("end")).agg(F.max("iou").alias("iou"))
    extra = left.join(near, ["train", "label", "start", "end"], "left").select("train", "label", F.when(F.col("iou").isNotNull(), "label_confusion").otherwise("extra_detector_event").alias("kind"), F.col("start").alias("pred_start"), F.col("end").alias("pred_end"), "iou")
    lost = missed.select("train", "label", F.lit("missed_manual_event").alias("kind"), F.col("start").alias("truth_start"), F.col("end").alias("truth_end"))
    return tp.unionByName(extra, allowMissingColumns=True).unionByName(lost, allowMissingColumns=True)


def event_metrics(pred: DataFrame, truth: DataFrame, tp: DataFrame, by: list[str]) -> DataFrame:
    """Truth, predicted, TP, FP, FN, precision, recall and F1 by class; classes that only one side has get zeros."""
    c = lambda df, n: df.groupBy(*by).agg(F.count(F.lit(1)).alias(n))
    x = c(truth, "truth_n").join(c(pred, "pred_n"), by, "full").join(c(tp, "tp"), by, "left").select(*by, *[F.coalesce(k, F.lit(0)).alias(k) for k in ("truth_n", "pred_n", "tp")])
    return scored(x)


def split(trains: DataFrame, share: float = 0.5, seed: int = 1) -> DataFrame:
    """(train, part): calibration or validation, by the place of a seeded hash among the trains."""
    names = trains.select("train").distinct()
    placed = stored(ranked(names.withColumn("_h", F.xxhash64(F.lit(seed), "train")), F.col("_h"), F.col("train"), name="_k"), "placed-trains")
    first = math.ceil(placed.count() * share)
    return placed.select("train", F.when(F.col("_k") < first, "calibration").otherwise("validation").alias("part"))


METRICS = ["precision", "recall", "f1", "tp", "fp", "fn", "pred_n", "truth_n"]


def scored(x: DataFrame) -> DataFrame:
    """x (truth_n, pred_n, tp) plus the other metrics."""
    x = x.withColumns({"fp": F.greatest(F.col("pred_n") - F.col("tp"), F.lit(0)), "fn": F.col("truth_n") - F.col("tp"), "precision": F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")), "recall": F.when(F.col("truth_n") > 0, F.col("tp") / F.col("truth_n"))})
    return x.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def quantile_6(values: Column, p: float) -> Column:
    """The quantile of a sorted array without nulls at place p * (n + 1), between its ends; null of an empty one."""
    n = F.size(values)
    h = F.least(F.greatest(F.lit(p) * (n + 1), F.lit(1.0)), n.cast("double"))
    low = F.get(values, (F.floor(h) - 1).cast("int"))
    return F.when(n > 0, low + (h - F.floor(h)) * (F.get(values, (F.ceil(h) - 1).cast("int")) - low))


def cluster_bootstrap(per_train: DataFrame, replicates: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(label, metric, observed, replicates, mean, low, high): intervals of the metrics of each label over resampled trains, from (train, label, truth_n, pred_n, tp).

    A replicate draws as many trains as there are, with replacement, by a seeded hash. Matches are within trains, so counts of drawn trains add and nothing is matched again.
    Replicates in which a metric isn't defined don't count for it; the ends are quantiles of the kind p * (n + 1)."""
    names = stored(ranked(per_train.select("train").distinct(), F.col("train"), name="_k"), "numbered-trains")
    n = names.count()
    labels = stored(per_train.select("label").distinct(), "labels")
    draws = names.select("_k", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    draws = draws.select("replicate", F.pmod(F.xxhash64(F.lit(seed), "replicate", "_k"), F.lit(max(1, n))).alias("_k"))
    # as many draws as trains times replicates; Spark takes them for as few as the trains, so it is told not to broadcast them
    draws = draws.repartition("_k").groupBy("_k", "replicate").agg(F.count(F.lit(1)).alias("_w")).hint("merge")
    counted = per_train.join(names, "train").join(draws, "_k").groupBy("replicate", "label").agg(*[F.sum(F.col(c) * F.col("_w")).alias(c) for c in ("truth_n", "pred_n", "tp")])
    each = labels.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).join(counted, ["replicate", "label"], "left").fillna(0, ["truth_n", "pred_n", "tp"])
    long = lambda df, *keep: df.select(*keep, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS])).alias("m")).select(*keep, "m.*")
    values = long(scored(each), "label").groupBy("label", "metric").agg(F.sort_array(F.collect_list("value")).alias("v"), F.avg("value").alias("mean"))
    whole = per_train.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("truth_n", "pred_n", "tp")])
    seen = long(scored(whole), "label").withColumnRenamed("value", "observed")
    tail = (1 - level) / 2
    return seen.join(values, ["label", "metric"]).select("label", "metric", "observed", F.size("v").cast("long").alias("replicates"), "mean", quantile_6(F.col("v"), tail).alias("low"), quantile_6(F.col("v"), 1 - tail).alias("high"))


def iou_sensitivity(pred: DataFrame, truth: DataFrame, grid: tuple[float, ...] = (0.1, 0.25, 0.5)) -> DataFrame:
    """Event metrics at each IoU of the grid."""
    out = None
    for least in grid:
        m = event_metrics(pred, truth, matched(pred, truth, least), ["label"]).withColumn("least", F.lit(least))
        out = m if out is None else out.unionByName(m)
    return out


def rater_agreement(events: DataFrame, least: float = 0.25) -> DataFrame:
    """A row for each two raters of events (rater, train, label, start, end): how many of their events match (whatever the label), with the same label, how well, and Cohen's kappa of the labels,
    where an event without a match has the label none on the other side."""
    names = events.select("rater").distinct()  # a row for each rater
    pairs = stored(names.select(F.col("rater").alias("rater_a")).join(names.select(F.col("rater").alias("rater_b")), F.col("rater_a") < F.col("rater_b")), "rater-pairs")
    side = lambda c: events.join(pairs, events["rater"] == pairs[c]).select("rater_a", "rater_b", "train", "label", "start", "end")
    a, b = side("rater_a"), side("rater_b")
    by, keys = ["rater_a", "rater_b"], ["rater_a", "rater_b", "train"]
    m = stored(matched(a, b, least, tuple(keys)), "rater-matches")
    apart = lambda df, s: df.join(m.select(*keys, F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end")), [*keys, "start", "end"], "left_anti")
    none = F.lit("none")
    labels = m.select(*by, F.col("pred_label").alias("x"), F.col("truth_label").alias("y")).unionByName(apart(a, "pred").select(*by, F.col("label").alias("x"), none.alias("y"))).unionByName(apart(b, "truth").select(*by, none.alias("x"), F.col("label").alias("y")))
    labels = stored(labels.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("n")), "rater-labels")
    total = labels.groupBy(*by).agg(F.sum("n").alias("event_union_n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("_same"))
    one = lambda c: labels.groupBy(*by, F.col(c).alias("label")).agg(F.sum("n").alias(f"_{c}"))
    chance = one("x").join(one("y"), [*by, "label"]).groupBy(*by).agg(F.sum(F.col("_x") * F.col("_y")).alias("_chance"))
    error = (F.abs(F.col("pred_start") - F.col("truth_start")) + F.abs(F.col("pred_end") - F.col("truth_end"))) / 2
    found = m.groupBy(*by).agg(F.count(F.lit(1)).alias("matched_event_n"), F.count_if(F.col("pred_label") == F.col("truth_label")).alias("same_label_match_n"), F.avg("iou").alias("mean_iou_matched"), F.avg(error).alias("mean_boundary_abs_error_isi"))
    count = lambda df, n: df.groupBy(*by).agg(F.count(F.lit(1)).alias(n))
    x = pairs.join(total, by, "left").join(chance, by, "left").join(found, by, "left").join(count(a, "_a"), by, "left").join(count(b, "_b"), by, "left").fillna(0, ["event_union_n", "_same", "_chance", "matched_event_n", "same_label_match_n", "_a", "_b"])
    n = F.col("event_union_n")
    po, pe = F.col("_same") / n, F.col("_chance") / n / n
    f1 = F.when(n > 0, 2 * F.col("same_label_match_n") / (F.col("_a") + F.col("_b")))
    return x.select(*by, "event_union_n", "matched_event_n", "same_label_match_n", F.when(pe < 1, (po - pe) / (1 - pe)).alias("label_kappa"), f1.alias("event_f1_same_label"), "mean_iou_matched", "mean_boundary_abs_error_isi")


def overfit(pred: DataFrame, truth: DataFrame, parts: DataFrame, least: float = 0.25, gap: float = 0.2) -> DataFrame:
    """By label: precision and recall on the calibration trains and on the validation trains (parts: train, part), their differences, and whether the recall falls by more than gap."""
    p, t = pred.join(parts, "train"), truth.join(parts, "train")
    m = event_metrics(p, t, matched(pred, truth, least).join(parts, "train"), ["part", "label"])
    one = lambda c, part: F.max(F.when(F.col("part") == part, F.col(c)))
    x = m.groupBy("label").agg(*[one(c, part).alias(f"{c}_{part}") for c in ("precision", "recall") for part in ("calibration", "validation")])
    x = x.withColumns({f"{c}_gap": F.col(f"{c}_calibration") - F.col(f"{c}_validation") for c in ("precision", "recall")})
    return x.withColumn("possible_overfit", F.coalesce(F.col("recall_gap") > gap, F.lit(False)))


def report(pred: DataFrame, truth: DataFrame, parts: DataFrame | None = None, least: float = 0.25, grid: tuple[float, ...] = (0.1, 0.25, 0.5), replicates: int = 200) -> dict[str, DataFrame]:
    """The tables of a validation of predicted against true events (train, label, start, end) by name, as sources.csv.write() takes them: what became of each event, metrics by label,
    their intervals over resampled trains, how they depend on the IoU asked for; with parts (train, part), how they differ between calibration and validation trains."""
    m = stored(matched(pred, truth, least), "matches")
    per_train = stored(event_metrics(pred, truth, m, ["train", "label"]).select("train", "label", "truth_n", "pred_n", "tp"), "per-train")
    out = {
        "matches": match_table(pred, truth, least),
        "metrics": event_metrics(pred, truth, m, ["label"]),
        "metric_intervals": cluster_bootstrap(per_train, replicates),
        "iou_sensitivity": iou_sensitivity(pred, truth, grid),
    }
    return out if parts is None else out | {"overfit": overfit(pred, truth, parts, least)}


def calibration(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Per equal-width bin of scores (0 to 1) with outcomes (0 or 1): count, mean score, rate and gap."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    return scores.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("outcome").alias("rate"), F.avg((F.col("score") - F.col("outcome")) * (F.col("score") - F.col("outcome"))).alias("brier")).withColumn("gap", F.abs(F.col("mean_score") - F.col("rate")))


def calibration_errors(table: DataFrame) -> DataFrame:
    return table.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"), (F.sum(F.col("n") * F.col("brier")) / F.sum("n")).alias("brier"))


def delta(before: DataFrame, after: DataFrame, least: float = 0.25) -> DataFrame:
    """What became of events between two runs: unchanged, boundary_changed, label_changed, added or removed."""
    before, after = stored(before, "events-before"), stored(after, "events-after")
    m = stored(matched(after, before, least, ("train",)), "matches")
    kind = F.when(F.col("pred_label") != F.col("truth_label"), "label_changed").when((F.col("pred_start") != F.col("truth_start")) | (F.col("pred_end") != F.col("truth_end")), "boundary_changed").otherwise("unchanged")
    same = m.select("train", kind.alias("kind"), F.col("truth_start").alias("start"), F.col("truth_end").alias("end"))
    gone = before.join(m.select("train", F.col("truth_start").alias("start"), F.col("truth_end").alias("end")), ["train", "start", "end"], "left_anti").select("train", F.lit("removed").alias("kind"), "start", "end")
    new = after.join(m.select("train", F.col("pred_start").alias("start"), F.col("pred_end").alias("end")), ["train", "start", "end"], "left_anti").select("train", F.lit("added").alias("kind"), "start", "end")
    return same.unionByName(gone).unionByName(new)


def shuffled_lists(rows: DataFrame, n: int, seed: int = 1, block: int = 1) -> DataFrame:
    """(surrogate, train, intervals): n surrogates of each train, a row for each: its intervals (isi, valid) in an order that a seeded hash of their blocks sets. A train's list is ordered in its own row, so
    nothing is sorted or sent beside the trains themselves."""
    own = rows.where("isi is not null").groupBy("train").agg(F.sort_array(F.collect_list(F.struct("idx", "isi", "valid"))).alias("_s"))
    own = own.withColumn("surrogate", F.explode(F.sequence(F.lit(1), F.lit(n))))
    unit = lambda s: F.floor((s["idx"] - 2) / block)
    mixed = F.sort_array(F.transform("_s", lambda s: F.struct(F.xxhash64(F.lit(seed), "surrogate", "train", unit(s)).alias("h"), unit(s).alias("b"), s["idx"].alias("idx"), s["isi"].alias("isi"), s["valid"].alias("valid"))))
    return own.select("surrogate", "train", F.transform(mixed, lambda m: F.struct(m["isi"].alias("isi"), m["valid"].alias("valid"))).alias("intervals"))


def mean_lv(intervals: Column) -> Column:
    """Local variation of a list of intervals (isi, valid), of the valid ones; null under two."""
    x = F.transform(F.filter(intervals, lambda s: s["valid"]), lambda s: s["isi"])
    n = F.greatest(F.size(x) - 1, F.lit(0))
    total = F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n), lv_pair), F.lit(0.0), lambda a, v: a + v)
    return F.when(n > 0, total / n)


def shuffled_intervals(rows: DataFrame, n: int, seed: int = 1, block: int = 1) -> DataFrame:
    """The rows of shuffled_lists(), with times summed up anew (surrogate, train, idx, us, isi)."""
    x = shuffled_lists(rows, n, seed, block).select("surrogate", "train", F.posexplode("intervals").alias("_k", "x"))
    x = x.select("surrogate", "train", (F.col("_k") + 2).alias("idx"), "x.*").withColumn("step", F.round(F.col("isi") * 1e12).cast("long"))
    order = Window.partitionBy("surrogate", "train").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("surrogate", "train", "idx", "isi", F.sum("step").over(order).alias("us"), "valid")


def empirical_p(observed: DataFrame, surrogates: DataFrame, value: str) -> DataFrame:
    """Per train: the share of surrogates with a value at least as large, by the rule (1 + k) / (n + 1)."""
    s = surrogates.select("train", F.col(value).alias("_v"))
    return observed.join(s, "train").groupBy("train", value).agg(F.count("_v").alias("n"), F.count_if(F.col("_v") >= F.col(value)).alias("k")).withColumn("p", (1 + F.col("k")) / (F.col("n") + 1))


def strict_or_family(label: Column, mode: str) -> Column:
    from pulsegrid.functions.labels import family

    return family(label) if mode == "family" else label
