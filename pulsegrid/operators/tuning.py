"""Detection under many settings at once, and what it says: sensitivity to settings, tuning on some trains and validation on others.

A setting's variant and a train are the key of everything here: all variants are one detection and one matching, and every later step adds up the counts of (variant, train, label).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.grammar import Grammar
from pulsegrid.sources.shared import ranked, stored

from . import detectors
from .runs import segments
from .statistics import benjamini_hochberg
from .validation import event_metrics, matched, quantile_6, scored

BASELINE, SEP = "baseline", "\x1f"
# What the scan says of a variant, and how a split came about.
FLAGS = ("baseline", "insufficient_train_pairs", "sensitive_after_BH_FDR", "stable_within_effect_threshold", "not_significant_after_BH_FDR")
SPLIT_NOTES = ("stratified_train_holdout", "insufficient_labeled_trains_for_independent_holdout")
COUNTS = ["truth_n", "pred_n", "tp"]


def variants(spark: SparkSession, names: list[str], base: Grammar | None = None, step: float = 0.25) -> DataFrame:
    """(variant, place, setting, value, and a column for each name): the baseline, and each setting down and up by a share of its value, the others as they are. A row for each of them."""
    base = base or Grammar()
    now = {n: getattr(base, n) for n in names}
    rows = [(BASELINE, 0, None, None, *now.values())]
    for n, v in now.items():
        for way, new in (("decrease", v * (1 - step)), ("increase", v * (1 + step))):
            new = type(v)(round(new)) if isinstance(v, int) else new
            if new != v:
                rows.append((f"{n}_{way}", len(rows), n, float(new), *(now | {n: new}).values()))
    kinds = ", ".join(f"{n} {'int' if isinstance(v, int) else 'double'}" for n, v in now.items())
    return spark.createDataFrame(rows, f"variant string, place int, setting string, value double, {kinds}").coalesce(1)


def grammars(names: DataFrame) -> dict[str, Grammar]:
    """The settings of each variant: its own, and the defaults for the others, as detected_variants() takes them. names: a row for each variant."""
    own = [c for c in names.columns if c not in ("variant", "place", "setting", "value")]
    return {r["variant"]: dataclasses.replace(Grammar(), **{c: r[c] for c in own}) for r in names.orderBy("place").collect()}


def keyed(variant: Column, train: Column) -> Column:
    return F.concat_ws(SEP, variant, train.cast("string"))


def detected_variants(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """(variant, train, label, start, end): the events that each variant finds in each of its trains. settings: variant, train and any settings, a row for each two.

    One detection: a train under a variant is a train of its own, whose rows and settings have that key."""
    kind = rows.schema["train"].dataType
    keys = settings.withColumn("_key", keyed(F.col("variant"), F.col("train")))
    own = rows.drop("manual", "auto", "negative").join(keys.select("train", "_key"), "train").withColumn("train", F.col("_key")).drop("_key")
    values = stored(keys.withColumn("train", F.col("_key")).drop("_key", "variant", "place", "setting", "value"), "variant-settings")
    labelled, _ = detectors.detect(own, values, lock_manual=False)
    found = segments(labelled, F.col("auto")).where("label <> ''")
    parts = F.split("train", SEP, 2)
    return found.select(parts[0].alias("variant"), parts[1].cast(kind).alias("train"), "label", "start", "end")


def counts(pred: DataFrame, truth: DataFrame, names: DataFrame, least: float = 0.25) -> DataFrame:
    """(variant, train, label, truth_n, pred_n, tp) of predicted events (variant, train, label, start, end) against true ones (train, label, start, end), for the variants named."""
    both = truth.join(F.broadcast(names.select("variant")))  # a row for each variant: a parameter
    keys = ["variant", "train", "label"]
    m = event_metrics(pred, both, stored(matched(pred, both, least, tuple(keys)), "variant-matches"), keys)
    return m.select(*keys, *COUNTS)


def macro(c: DataFrame, by: list[str]) -> DataFrame:
    """(by, precision, recall, f1): means over labels of the metrics of their summed counts; undefined ones don't count."""
    each = scored(c.groupBy(*by, "label").agg(*[F.sum(k).alias(k) for k in COUNTS]))
    return each.groupBy(*by).agg(*[F.avg(k).alias(f"macro_{k}") for k in ("precision", "recall", "f1")])


def sign_flips(differences: DataFrame, permutations: int = 999, seed: int = 1, exact: int = 12) -> DataFrame:
    """(variant, pairs, mean, p) of paired differences (variant, train, difference): how often the mean of differences with random signs is at least as far from zero, (1 + k) / (n + 1).

    Signs come from a seeded hash of train and permutation; all combinations are taken instead where there are no more of them than permutations, of `exact` trains at most. Differences count in units of
    1e-12, so sums are exact and ties are ties. Under two trains there is no p; if nothing differs it is 1."""
    d = stored(differences.where("difference is not null").select("variant", "train", F.round(F.col("difference") * 1e12).cast("long").alias("d")), "differences")
    seen = d.groupBy("variant").agg(F.count(F.lit(1)).alias("pairs"), F.sum("d").alias("total"), F.max(F.abs("d")).alias("most"))
    few = (F.col("pairs") <= exact) & (F.pow(F.lit(2.0), "pairs") <= permutations + 1)
    seen = stored(seen.withColumns({"few": few, "n": F.when(few, F.pow(F.lit(2.0), "pairs")).otherwise(F.lit(permutations)).cast("int")}), "observed")
    x = d.join(F.broadcast(seen.where("pairs >= 2 and most > 0").select("variant", "few", "n")), "variant")  # a row for each variant
    nth = F.row_number().over(Window.partitionBy("variant").orderBy("train")) - 1  # of a dozen trains at most
    x = x.where("not few").withColumn("_at", F.lit(0)).unionByName(x.where("few").withColumn("_at", nth))
    x = x.where("d <> 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))  # nothing is added by a zero of either sign
    bit = F.when(F.col("few"), F.getbit(F.col("k").cast("long"), F.col("_at"))).otherwise(F.pmod(F.xxhash64(F.lit(seed), "variant", "train", "k"), F.lit(2))).cast("int")
    flipped = x.groupBy("variant", "k").agg(F.sum(F.when(bit == 1, F.col("d")).otherwise(-F.col("d"))).alias("s"))
    hits = flipped.join(F.broadcast(seen.select("variant", "total")), "variant").groupBy("variant").agg(F.count_if(F.abs("s") >= F.abs("total")).alias("_k"), F.count(F.lit(1)).alias("_n"))
    p = F.when(F.col("pairs") < 2, None).when(F.col("most") == 0, 1.0).otherwise((1 + F.col("_k")) / (F.col("_n") + 1))
    return seen.join(hits, "variant", "left").select("variant", "pairs", (F.col("total") / 1e12 / F.col("pairs")).alias("mean"), p.alias("p"))


def sensitivity(c: DataFrame, names: DataFrame, alpha: float = 0.05, effect: float = 0.02, permutations: int = 999, seed: int = 1) -> DataFrame:
    """A row for each variant: macro metrics of its counts, their change against the baseline, the paired sign-flip test of the trains' macro F1, Benjamini-Hochberg over the variants, and a verdict."""
    whole = macro(c, ["variant"])
    base = whole.where(F.col("variant") == BASELINE).select(F.col("macro_f1").alias("_base"))
    each = stored(macro(c, ["variant", "train"]).select("variant", "train", "macro_f1"), "train-metrics")
    mine = each.where(F.col("variant") == BASELINE).select("train", F.col("macro_f1").alias("_b"))
    d = each.where(F.col("variant") != BASELINE).join(mine, "train").select("variant", "train", (F.col("macro_f1") - F.col("_b")).alias("difference"))
    tests = benjamini_hochberg(sign_flips(d, permutations, seed).withColumn("_all", F.lit(1)), ["_all"], "p").drop("_all")  # a row for each variant
    x = names.select("variant", "place", "setting", "value").join(whole, "variant", "left").join(tests, "variant", "left").join(F.broadcast(base))  # one row
    x = x.withColumn("change", F.col("macro_f1") - F.col("_base")).drop("_base")
    flag = F.when(F.col("variant") == BASELINE, FLAGS[0]).when(F.col("q").isNull(), FLAGS[1]).when((F.col("q") <= alpha) & (F.abs("change") >= effect), FLAGS[2]).when(F.abs("change") < effect, FLAGS[3]).otherwise(FLAGS[4])
    return x.withColumn("flag", flag)


def strata(trains: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """trains (by, train, duration) plus events and stratum: which labels a train's true events have, and which third of the durations (of its group, by) it lies in; bins are closed at their ends."""
    by = by or []
    kinds = truth.groupBy("train").agg(F.concat_ws("+", F.array_sort(F.collect_set("label"))).alias("_kinds"), F.count(F.lit(1)).alias("events"))
    thirds = trains.groupBy(*by).agg(F.percentile("duration", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_q"), F.min("duration").alias("_a"), F.max("duration").alias("_b"), F.count_distinct("duration").alias("_d"))
    x = trains.join(kinds, "train", "left").fillna(0, ["events"])
    x = x.join(thirds, by) if by else x.join(F.broadcast(thirds))  # one row
    ends = F.array_distinct(F.array("_a", F.get("_q", 0), F.get("_q", 1), "_b"))  # equal ends make one bin less
    bin_ = F.greatest(F.lit(1), F.size(F.filter(ends, lambda e: e < F.col("duration"))))
    name = F.when(F.col("_d") < 3, "all_lengths").otherwise(F.coalesce(F.get(F.array(F.lit("short"), F.lit("medium"), F.lit("long")), bin_ - 1), F.lit("unknown_length")))
    return x.withColumn("stratum", F.concat_ws("|", F.coalesce("_kinds", F.lit("none")), name)).drop("_kinds", "_q", "_a", "_b", "_d")


def _nth(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """df plus nth (from 0, by order) and size of its group. Rows are numbered by ranges: a group may hold most of them."""
    x = stored(ranked(df, *[F.col(c) for c in group], *order, name="_r"), "numbered")
    first = x.groupBy(*group).agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias("size"))
    return x.join(first, group).withColumn("nth", F.col("_r") - F.col("_first")).drop("_r", "_first")


def stratified_splits(table: DataFrame, by: list[str], share: float = 0.25, seed: int = 1, least: int = 1) -> DataFrame:
    """(by, train, part, note) of strata() in groups (by): validation, calibration, or unlabelled where a train has no true event.

    Of each stratum with two trains or more the given share, one at least and not all, go to validation, by a seeded hash of group and train; then others by that hash until the share of all is reached."""
    h = F.xxhash64(F.lit(seed), *by, "train")
    x = _nth(table.where("events > 0").withColumn("_h", h), [*by, "stratum"], F.col("_h"), F.col("train"))
    taken = F.when(F.col("size") >= 2, F.least(F.greatest(F.lit(1), F.floor(F.col("size") * share)), F.col("size") - 1)).otherwise(0)
    x = stored(x.withColumn("_v", F.col("nth") < taken).drop("nth", "size"), "first-choice")
    groups = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.count_if("_v").alias("_have"))
    needed = F.when(F.col("_n") > 1, F.least(F.greatest(F.lit(least), F.floor(F.col("_n") * share)), F.col("_n") - 1)).otherwise(1)
    rest = _nth(x.where("not _v"), by, F.col("_h"), F.col("train")).join(groups.withColumn("_more", needed - F.col("_have")), by)
    rest = rest.select(*by, "train", (F.col("nth") < F.col("_more")).alias("_v"))
    some = stored(x.where("_v").select(*by, "train", "_v").unionByName(rest), "splits")
    parts = some.groupBy(*by).agg(F.count_if("_v").alias("_a"), F.count_if(~F.col("_v")).alias("_b"))
    note = F.when((F.coalesce("_a", F.lit(0)) == 0) | (F.coalesce("_b", F.lit(0)) == 0), SPLIT_NOTES[1]).otherwise(SPLIT_NOTES[0])
    out = table.select(*by, "train").join(some, [*by, "train"], "left").join(parts, by, "left")
    return out.select(*by, "train", F.when(F.col("_v"), "validation").when(~F.col("_v"), "calibration").otherwise("unlabelled").alias("part"), note.alias("note"))


def chosen(c: DataFrame, names: DataFrame, inner: DataFrame, by: list[str], metric: str = "macro_f1") -> DataFrame:
    """(by, variant, score): of each group (by) of an inner split (by, train, part), the first variant of those with the best macro metric on its validation trains; the baseline if the split has only one part
    or no variant has a metric."""
    parts = inner.where("part <> 'unlabelled'").groupBy(*by).agg(F.count_if(F.col("part") == "validation").alias("_v"), F.count_if(F.col("part") == "calibration").alias("_c"))
    score = macro(c.join(inner.where("part = 'validation'").select(*by, "train"), "train"), [*by, "variant"]).join(names.select("variant", "place"), "variant")
    best = score.where(F.col(metric).isNotNull()).groupBy(*by).agg(F.max_by(F.struct("variant", F.col(metric).alias("score")), F.struct(metric, -F.col("place"))).alias("b"))
    x = inner.select(*by).distinct().join(parts, by, "left").join(best, by, "left")
    whole = F.coalesce((F.col("_v") > 0) & (F.col("_c") > 0) & F.col("b").isNotNull(), F.lit(False))
    return x.select(*by, F.when(whole, F.col("b.variant")).otherwise(BASELINE).alias("variant"), F.when(whole, F.col("b.score")).alias("score"))


def repeated_holdout(
    c: DataFrame, names: DataFrame, trains: DataFrame, truth: DataFrame, repeats: int = 50, share: float = 0.25, inner_share: float = 0.25, nested: bool = True, seed: int = 1, metric: str = "macro_f1"
) -> dict[str, DataFrame]:
    """Repeated validation on held-out trains (train, duration): in each repeat a variant is chosen on an inner split of the calibration trains (nested; else the baseline is taken), and scored on the validation trains.

    splits (repeat, train, part, note), choices (repeat, variant, score), metrics (repeat, label, counts, precision, recall, f1), repeats (their macro values) and summary (by label: means, deviation and
    quantiles over repeats). Everything is keyed by the repeat; nothing is detected again."""
    own = stored(strata(trains, truth), "strata").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    splits = stored(stratified_splits(own, ["repeat"], share, seed), "outer-splits")
    choices = splits.select("repeat").distinct().select("repeat", F.lit(BASELINE).alias("variant"), F.lit(None).cast("double").alias("score"))
    if nested:
        inside = strata(splits.where("part = 'calibration'").select("repeat", "train").join(trains, "train"), truth, ["repeat"])
        inner = stored(stratified_splits(stored(inside, "inner-strata"), ["repeat"], inner_share, seed + 1), "inner-splits")
        found = stored(chosen(c, names, inner, ["repeat"], metric), "choices")
        choices = choices.join(found.select("repeat", F.col("variant").alias("_v"), F.col("score").alias("_s")), "repeat", "left").select("repeat", F.coalesce("_v", "variant").alias("variant"), F.col("_s").alias("score"))
    choices = stored(choices, "chosen-variants")
    held = splits.where("part = 'validation'").select("repeat", "train").join(choices.select("repeat", "variant"), "repeat")
    m = c.join(held, ["variant", "train"]).groupBy("repeat", "label").agg(*[F.sum(k).alias(k) for k in COUNTS])
    metrics = stored(scored(m), "holdout-metrics")
    means = metrics.groupBy("repeat").agg(*[F.avg(k).alias(f"macro_{k}") for k in ("precision", "recall", "f1")])
    sizes = splits.groupBy("repeat").agg(F.count_if(F.col("part") == "calibration").alias("calibration_n"), F.count_if(F.col("part") == "validation").alias("validation_n"), F.max("note").alias("note"))
    v = F.sort_array(F.collect_list("f1"))
    by_label = metrics.groupBy("label").agg(F.count(F.lit(1)).alias("repeats"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.stddev_samp("f1").alias("f1_sd"), v.alias("_v"))
    by_label = by_label.withColumns({f"f1_q{int(p * 100):02d}": quantile_6(F.col("_v"), p) for p in (0.05, 0.5, 0.95)}).drop("_v")
    return {"splits": splits, "choices": choices, "metrics": metrics, "repeats": sizes.join(choices, "repeat").join(means, "repeat", "left"), "summary": by_label}
