"""Events after detection: how event-like they are, what family they belong to, ledgers, policies and tables about them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from pulsegrid.functions.stats import clamp

from .joins import range_join
from .runs import runs, segments
from .statistics import regularity, span_metrics


def in_train() -> WindowSpec:
    return Window.partitionBy("train").orderBy("idx")


def eventness(rows: DataFrame, events: DataFrame, gap: int = 2, width: int = 12, short: float = 0.02, outlier: float = 3.5) -> DataFrame:
    """events (train, label, start, end) with measures, the contrast to both flanks (edge) and to the median of up to `width` rows beyond a gap on each side (context), how
    far the flanks return to that level, and scores from 0 to 1: boundary, eventness and regularity."""
    x = span_metrics(rows, events, 0.01, short, intervals=True, context=(gap, width), keep=("label",))
    flank = F.when(F.col("pre").isNotNull() & F.col("post").isNotNull(), (F.col("pre") + F.col("post")) / 2).otherwise(F.coalesce("pre", "post"))
    x = x.withColumns({"edge": F.least("pre_ratio", "post_ratio"), "context_contrast": F.col("context") / F.col("q90"), "flank_return": clamp(F.exp(-F.abs(F.ln(flank / F.col("context"))) / float(np.log(1.5))))})
    x = x.withColumns({"boundary": F.least(clamp(F.col("edge") / 3), clamp(F.col("context_contrast") / 3)), "outliers": F.size(F.filter("isi_values", lambda v: v / F.col("q50") > outlier)).cast("long"), "short_share": (F.col("core") + F.col("bridges")) / F.col("n_isi"), "regularity": regularity(F.coalesce("cv", F.lit(0.0)), F.coalesce("lv", F.lit(0.0)), F.col("q90"), F.col("q10"))})
    x = x.withColumn("eventness", (F.col("boundary") + F.col("flank_return")) / 2)
    return x.withColumn("zone", F.when(F.col("eventness").isNull(), "unknown").when(F.col("eventness") >= 0.6, "event_like").when(F.col("eventness") <= 0.45, "state_like").otherwise("medium_review"))


def recommended(x: DataFrame) -> DataFrame:
    """A family and subtype for each event with eventness measures; its label stays as it is."""
    n, spikes = F.col("n_isi"), F.col("end") - F.col("start") + 2
    e, family = F.col("eventness"), F.col("label").isin("burst", "long_burst", "possible_burst")
    burst_like = (e >= 0.6) | (family & e.isNull())
    sub = (
        F.when(F.col("label") == "pause", "pause_event")
        .when(burst_like & (n >= 10) & (F.col("edge") >= 3.5), "long_burst")
        .when(burst_like & spikes.between(3, 15) & (F.col("edge") >= 3.0) & (F.col("context_contrast") >= 3.0) & (F.col("q90") <= 0.015), "high_frequency_burst")
        .when(burst_like & spikes.between(3, 10) & (F.col("edge") >= 3.5) & (F.col("outliers") <= 1), "classic_burst")
        .when(burst_like, "possible_burst")
        .when((n >= 6) & (F.col("regularity") >= 0.7) & (F.coalesce(e, F.lit(0.0)) <= 0.5), "high_frequency_tonic")
        .when((n >= 29) & (F.col("short_share") >= 0.7) & (F.coalesce(e, F.lit(0.0)) <= 0.65), "high_frequency_spiking")
        .when((n >= 3) & (F.col("regularity") >= 0.6), "tonic")
        .otherwise("ambiguous")
    )
    x = x.withColumn("subtype", sub)
    fam = F.when(F.col("subtype") == "pause_event", "pause").when(F.col("subtype").endswith("burst"), "burst_family").when(F.col("subtype").isin("tonic", "high_frequency_tonic", "high_frequency_spiking"), "state").otherwise("ambiguous")
    return x.withColumns({"family": fam, "agrees": (F.col("subtype") == F.col("label")) | ((fam == "burst_family") & F.col("label").isin("burst", "long_burst", "possible_burst")) | ((fam == "pause") & (F.col("label") == "pause"))})


# Why a burst counts as a possible one, and the labels that are certain unless they need review.
SUSPECT, ONE_SIDED, COMPRESSED = "contains_refractory_suspect_ISI", "boundary_one_sided_evidence", "local_compression_review_candidate"
CERTAIN = ["burst", "long_burst", "tonic", "high_frequency_tonic", "high_frequency_spiking", "pause"]


def decided(x: DataFrame) -> DataFrame:
    """final_class, reason, tier and warnings of each event. Bursts with suspect intervals, with an interval on one side only (at a record's edge), and short ones that only stand out locally (a column local_compression,
    if there is one) are possible bursts. Possible events need review; the other labels of detectors are of high confidence, and whatever else there is counts as context."""
    burst, one = F.col("label").isin("burst", "long_burst"), F.col("pre").isNull() != F.col("post").isNull()
    local = F.coalesce("local_compression", F.lit(False)) if "local_compression" in x.columns else F.lit(False)
    reason = F.when(burst & (F.col("suspects") > 0), SUSPECT).when((burst | (F.col("label") == "unclassified")) & one, ONE_SIDED).when((F.col("label") == "burst") & local, COMPRESSED).otherwise("")
    x = x.withColumn("reason", reason).withColumn("final_class", F.when(F.col("reason") != "", "possible_burst").otherwise(F.col("label")))
    review = F.col("final_class").isin("possible_burst", "possible_pause", "unclassified", "rejected")
    tier = F.when(review, "review_required").when(F.col("final_class").isin(CERTAIN), "high_confidence").otherwise("contextual")
    return x.withColumns({"tier": tier, "warnings": F.concat_ws(";", F.when(F.col("suspects") > 0, "refractory_suspect"), F.when(F.col("pre").isNull() | F.col("post").isNull(), "record_edge"))})


def refractory_policy(events: DataFrame, action: str = "demote") -> DataFrame:
    """events (label, suspects): warn, demote (burst to possible_burst), multiunit (flagged), exclude (dropped)."""
    hit = F.col("suspects") > 0
    if action == "exclude":
        return events.where(~hit)
    label = F.when(hit & F.col("label").isin("burst", "long_burst"), "possible_burst").otherwise(F.col("label")) if action == "demote" else F.col("label")
    return events.withColumns({"label": label, "flag": F.when(hit, {"warn": "warning", "demote": "demoted", "multiunit": "multiunit"}[action]).otherwise("")})


def split_at_suspects(rows: DataFrame, events: DataFrame) -> DataFrame:
    """events cut at suspect intervals: (train, label, start, end) of the parts between."""
    at = rows.select("train", F.col("idx").alias("start"), F.col("idx").alias("end"), "suspect")
    inside = range_join(events.select("train", "label", "start", "end"), at, ["train"]).where(~F.col("r_suspect"))
    run = F.col("r_start") - F.row_number().over(Window.partitionBy("train", "l_start").orderBy("r_start"))
    return inside.withColumn("_run", run).groupBy("train", "l_start", "_run", F.col("l_label").alias("label")).agg(F.min("r_start").alias("start"), F.max("r_start").alias("end")).select("train", "label", "start", "end")


def promoted(rows: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with possible_burst turned into burst inside the events given, an audit row for each change)."""
    at = rows.where("auto = 'possible_burst'").select("train", F.col("idx").alias("start"), F.col("idx").alias("end"))
    hit = range_join(events.select("train", "start", "end"), at, ["train"]).select("train", F.col("r_start").alias("idx")).distinct().withColumn("_p", F.lit(True))
    out = rows.join(hit, ["train", "idx"], "left").withColumn("before", F.col("auto")).withColumn("auto", F.when(F.col("_p"), "burst").otherwise(F.col("auto")))
    return out.drop("_p", "before"), out.where("_p").select("train", "idx", "before", F.col("auto").alias("after"))


def interval_table(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Long table (train, label, start, kind, value): flanks, own intervals and gaps to the next event of the label."""
    m = span_metrics(rows, events.select("train", "start", "end"), 0.01, 0.015).join(events.select("train", "start", "end", "label"), ["train", "start", "end"])
    t = rows.select("train", "idx", "t")
    m = m.join(t.select("train", F.col("idx").alias("end"), F.col("t").alias("_e")), ["train", "end"]).join(t.select("train", (F.col("idx") + 1).alias("start"), F.col("t").alias("_a")), ["train", "start"], "left")
    gap = F.lead("_a").over(Window.partitionBy("train", "label").orderBy("start")) - F.col("_e")
    wide = m.select("train", "label", "start", "pre", "post", F.col("mean_isi").alias("intra"), "duration", gap.alias("gap"))
    return wide.unpivot(["train", "label", "start"], ["pre", "post", "intra", "duration", "gap"], "kind", "value").where("value is not null")


def greedy_suppression(found: DataFrame, share: float = 0.75) -> DataFrame:
    """Candidates (train, candidate, start, end, priority, score) kept in the order of priority and score, unless one kept before covers `share` of the shorter of the two. A scan of each train's
    candidates, in which each looks only at those kept that stand in the same stretches of 64 intervals."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["priority", "score", "start", "candidate"], ascending=[False, False, True, True], kind="stable")
        kept: dict[int, list[tuple[int, int]]] = {}
        rows = []
        for i, s, e in zip(pdf.index, pdf["start"].tolist(), pdf["end"].tolist(), strict=True):
            stretches = range(s // 64, e // 64 + 1)
            if all((min(e, b) - max(s, a) + 1) / min(e - s + 1, b - a + 1) < share for k in stretches for a, b in kept.get(k, ())):
                for k in stretches:
                    kept.setdefault(k, []).append((s, e))
                rows.append(i)
        return pdf.loc[rows]

    x = found.select("train", "candidate", "start", "end", "priority", "score")
    return x.groupBy("train").applyInPandas(keep, x.schema)


def linked(seeds: DataFrame, rows: DataFrame, gap: int = 1, ratio: float = 3.5, longest: float = 0.08, inflate: float = 1.25) -> DataFrame:
    """Neighbouring seeds (train, start, end, q90) joined where at most `gap` intervals part them that are short for both: connected parts are islands, since only
    neighbours link."""
    order = Window.partitionBy("train").orderBy("start")
    x = seeds.withColumns({"_next": F.lead("start").over(order), "_q": F.greatest("q90", F.lead("q90").over(order))})
    between = x.where(F.col("_next").isNotNull() & (F.col("_next") - F.col("end") - 1 <= gap) & (F.col("_next") > F.col("end") + 1)).select("train", F.col("start").alias("_seed"), (F.col("end") + 1).alias("start"), (F.col("_next") - 1).alias("end"), "_q")
    at = rows.select("train", F.col("idx").alias("start"), F.col("idx").alias("end"), "isi")
    most = range_join(between, at, ["train"]).groupBy("train", F.col("l__seed").alias("start"), F.col("l__q").alias("_q")).agg(F.max("r_isi").alias("_m"))
    ok = most.where((F.col("_m") <= longest) & (F.col("_m") / (F.col("_q") * inflate) <= ratio)).select("train", "start", F.lit(True).alias("_ok"))
    y = seeds.join(ok, ["train", "start"], "left")
    new = F.coalesce(F.lag("_ok").over(order), F.lit(False))
    y = y.withColumn("_run", F.sum(F.when(new, 0).otherwise(1)).over(order))
    return y.groupBy("train", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("seeds")).drop("_run")


def local_compression(rows: DataFrame, width: int = 3, ratio: float = 2.2) -> DataFrame:
    """Windows of `width` valid intervals whose mean is `ratio` times shorter than the median around them, as runs of their starts."""
    from .isi import local_median

    x = local_median(rows, 5)
    ahead = F.collect_list(F.when(F.col("valid"), F.col("isi"))).over(in_train().rowsBetween(0, width - 1))
    x = x.withColumn("_w", ahead)
    flag = (F.size("_w") == width) & (F.col("local_median") / (F.aggregate("_w", F.lit(0.0), lambda a, v: a + v) / width) >= ratio)
    return runs(x, flag).select("train", "start", (F.col("end") + width - 1).alias("end"), "n")


def high_frequency_modes(rows: DataFrame, bound: float = 0.02, least: int = 4, stable: float = 0.4) -> DataFrame:
    """Runs of short intervals, told apart by their variation: stable or irregular."""
    from pulsegrid.functions.stats import cv

    x = runs(rows, F.col("valid") & (F.col("isi") <= bound), F.avg("isi").alias("mean_isi"), cv("isi").alias("cv"), least=least)
    return x.withColumn("mode", F.when(F.col("cv") <= stable, "stable").otherwise("irregular"))


def tonic_growth(rows: DataFrame, ratio: float = 1.4, lv_max: float = 0.35, least: int = 4) -> DataFrame:
    """Runs that begin with two intervals of like length and grow to both sides, forward first, while their LV stays under lv_max. Growth depends on what has grown, so this is a scan of a train;
    running sums give the LV of any stretch at once."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        v, ok, idx = pdf["isi"].to_numpy(), pdf["valid"].to_numpy(), pdf["idx"].to_numpy()
        sums = np.concatenate([[0.0], np.cumsum(3 * (v[:-1] - v[1:]) ** 2 / (v[:-1] + v[1:]) ** 2)]) if len(v) else np.zeros(1)
        lv = lambda a, b: float(sums[b] - sums[a]) / (b - a)
        out, i, floor = [], 0, 0
        while i < len(v) - 1:
            if ok[i] and ok[i + 1] and max(v[i], v[i + 1]) / min(v[i], v[i + 1]) <= ratio:
                a, b = i, i + 1
                while b + 1 < len(v) and ok[b + 1] and lv(a, b + 1) <= lv_max:
                    b += 1
                while a - 1 >= floor and ok[a - 1] and lv(a - 1, b) <= lv_max:
                    a -= 1
                if b - a + 1 >= least:
                    out.append((pdf["train"].iloc[0], int(idx[a]), int(idx[b]), lv(a, b)))
                    floor = b + 1
                i = b + 1
            else:
                i += 1
        return pd.DataFrame(out, columns=["train", "start", "end", "lv"])

    x = rows.where("isi is not null").select("train", "idx", "isi", "valid")
    return x.groupBy("train").applyInPandas(grow, f"train {rows.schema['train'].dataType.simpleString()}, start long, end long, lv double")


def consistency(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Checks between layers, a row each with the number of violations: events that overlap, events beyond their train, rows whose label no event covers."""
    order = Window.partitionBy("train").orderBy("start")
    overlap = events.withColumn("_b", F.lag("end").over(order)).where("_b >= start").agg(F.count(F.lit(1)).alias("n")).select(F.lit("overlapping_events").alias("check"), "n")
    last = rows.groupBy("train").agg(F.max("idx").alias("_last"))
    beyond = events.join(last, "train").where("end > _last or start < 2").agg(F.count(F.lit(1)).alias("n")).select(F.lit("events_beyond_train").alias("check"), "n")
    at = rows.where("auto <> ''").select("train", F.col("idx").alias("start"), F.col("idx").alias("end"))
    covered = range_join(events.select("train", "start", "end"), at, ["train"]).select("train", F.col("r_start").alias("start")).distinct()
    loose = at.join(covered, ["train", "start"], "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("labels_without_event").alias("check"), "n")
    return overlap.unionByName(beyond).unionByName(loose)


def of_labels(rows: DataFrame, column: str) -> DataFrame:
    return segments(rows, F.col(column)).where("label <> ''").select("train", "label", "start", "end")
