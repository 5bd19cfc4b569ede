"""Detectors of events in trains. Each gives a table of candidates: train, start, end (intervals), layer, label, gate, action, score, priority and measures.

Candidates are made by windows and joins over all trains at once; only selection among overlapping ones is a scan of a train's candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.grammar import Grammar
from pulsegrid.functions.stats import array_quantiles, clamp, q

from pulsegrid.sources.shared import stored

from .bounds import Bounds
from .gates import BURSTS, Limits, negative_overlap, validated
from .isi import in_train
from .joins import range_join
from .medians import with_medians
from .runs import extended, run_length, runs, runs_beside, support_runs
from .statistics import span_metrics

#: What a table of candidates holds. The last columns are of spiking states alone: shares of short, bridged and larger intervals, and the bounds that they were found with; pre and post are the
#: intervals beside a candidate.
COLUMNS = ["train", "start", "end", "layer", "label", "gate", "action", "score", "priority", "n_isi", "n_spikes", "duration", "q90", "cv", "lv", "mm", "pre", "post"]
STATE = ["short", "bridged", "large", "tolerated_gap", "q90_most"]


def usable(rows: DataFrame, g: Grammar | None = None) -> DataFrame:
    """rows with valid redefined for detection: there is an interval, and it's no artifact."""
    return rows.withColumn("valid", F.col("isi").isNotNull() & ~F.col("artifact"))


def references(rows: DataFrame, g: Grammar | Bounds) -> DataFrame:
    """Per train: quantiles of its usable intervals, the bounds of tonic firing and the floor of pauses that follow from them. Tonic firing keeps off the end of the burst band and its bridge, whichever is
    longer."""
    g = bounds(g)
    x = rows.where("valid").groupBy("train").agg(F.count("isi").alias("_n"), F.sort_array(F.collect_list("isi")).alias("_s"))
    x = x.withColumn("_q", array_quantiles(F.col("_s"), [0.1, 0.5, 0.75, 0.9])).drop("_s")
    x = g.on(x.withColumns({f"_q{p}": F.get("_q", i) for i, p in enumerate((10, 50, 75, 90))}).drop("_q"))
    few = F.col("_n") < 6
    base = F.greatest(g.pause_min, F.col("_q90"))
    lower = F.when(few, g.tonic_min).otherwise(F.greatest(g.min_isi, F.least(g.tonic_min, F.col("_q10")), burst_reference(g) * g.tonic_guard))
    x = x.withColumns({"_base": base, "_lower": lower})
    high = F.greatest(g.tonic_max, F.col("_q75") * 1.25, F.when(F.col("_q90") <= 1.5 * F.col("_q75"), F.col("_q90") * 1.02), F.col("_lower") * 1.5)
    capped = F.when((F.col("_base") > 1.15 * F.col("_q90")) & (F.col("_base") > F.col("_lower")), F.least(high, F.col("_base") * 0.98)).otherwise(high)
    upper = F.when(capped <= F.col("_lower"), F.greatest(g.tonic_max, F.col("_q75"), F.col("_lower") + g.min_isi)).otherwise(capped)
    x = x.withColumn("_upper", F.when(few, g.tonic_max).otherwise(upper))
    x = x.withColumn("_floor", F.when(F.col("_n") >= 10, F.greatest("_base", F.col("_upper") * 1.15)).otherwise(F.col("_base")))
    return stored(g.off(x), "references")


def bounds(g: Grammar | Bounds | DataFrame | None) -> Bounds:
    return g if isinstance(g, Bounds) else Bounds(g)


def burst_reference(g: Bounds) -> Column:
    """The longest interval that bursts may hold: tonic firing has to stand clear of it."""
    return F.greatest(g.seed_high, g.bridge)


def _table(df: DataFrame, layer: str, **more: Column) -> DataFrame:
    x = df.withColumns({"layer": F.lit(layer), **more}).withColumns({"n_spikes": F.col("end") - F.col("start") + 2, "score": F.col("score").cast("double"), "priority": F.col("priority").cast("double")})
    return x.select(*COLUMNS, *[F.col(c) if layer == "hf_spiking" else F.lit(None).cast("double").alias(c) for c in STATE])


#: What a gate that fails by nothing (a value at a limit that it has to be over) counts as.
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class Gate:
    """value must stand to limit as sense says (<=, <, >=, >); what isn't known passes. by is how far the limit would have to move for that, as a share of it; 0 if the gate holds."""

    name: str
    value: Column
    limit: Column
    sense: str = "<="

    @property
    def holds(self) -> Column:
        v, x = self.value, self.limit
        return F.coalesce({"<=": v <= x, "<": v < x, ">=": v >= x, ">": v > x}[self.sense], F.lit(True))

    @property
    def by(self) -> Column:
        return F.when(self.holds, 0.0).otherwise(F.greatest(F.abs(self.value - self.limit) / self.limit, F.lit(LEAST_SHARE)))


@dataclass(frozen=True)
class Known(Gate):
    """A gate that what isn't known fails, by any amount."""

    @property
    def holds(self) -> Column:
        v, x = self.value, self.limit
        return F.coalesce({"<=": v <= x, "<": v < x, ">=": v >= x, ">": v > x}[self.sense], F.lit(False))

    @property
    def by(self) -> Column:
        return F.when(self.holds, 0.0).otherwise(F.when((F.abs(self.value - self.limit) / self.limit).isNull(), float("inf")).otherwise(F.greatest(F.abs(self.value - self.limit) / self.limit, F.lit(LEAST_SHARE))))


@dataclass(frozen=True)
class Either:
    """Routes of gates, any of which is enough: the one that asks for the least counts."""

    name: str
    routes: tuple[tuple[Gate, ...], ...]

    @property
    def holds(self) -> Column:
        return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [g.holds for g in r]) for r in self.routes])

    @property
    def by(self) -> Column:
        every = [F.greatest(*[g.by for g in r]) if len(r) > 1 else r[0].by for r in self.routes]
        return F.least(*every) if len(every) > 1 else every[0]


def all_hold(gates: list[Gate | Either]) -> Column:
    return reduce(lambda a, b: a & b, [g.holds for g in gates])


def missed(m: DataFrame, gates: list[Gate | Either], layer: str, slack: float) -> DataFrame:
    """(train, start, end, layer, gate, by, failed) of spans that fail, but would pass if every gate were relaxed by a share of slack at most: the gate that asks for most, by how much, and how many fail."""
    x = m.withColumn("_m", F.filter(F.array(*[F.struct(g.by.alias("by"), F.lit(g.name).alias("gate")) for g in gates]), lambda s: s["by"] > 0))
    x = x.where(F.size("_m") > 0).withColumn("_w", F.array_max("_m")).where(F.col("_w.by") <= slack)
    return x.select("train", "start", "end", F.lit(layer).alias("layer"), "_w.gate", "_w.by", F.size("_m").alias("failed"))


def possible_priority(m_contrast: Column, core: Column, bridge_share: Column, purity: Column, g: Bounds, two: bool = False, one: bool = False, excess: Column | None = None) -> Column:
    p = 260 + 180 * F.least(F.lit(1.5), F.coalesce(m_contrast, F.lit(0.0)) / g.contrast) + 120 * F.least(F.lit(1.0), purity) + 20 * F.least(F.lit(5), core) + (80 if two else 0) + (50 if one else 0)
    if excess is not None:
        p = p - F.when(excess > 1, 60 * F.least(F.lit(2.0), excess - 1)).otherwise(0)
    return clamp(p - 120 * F.greatest(F.lit(0.0), bridge_share - 0.35), 180.0, 760.0)


def burst_measures(rows: DataFrame, ref: DataFrame, g: Bounds) -> tuple[DataFrame, DataFrame]:
    """(spans of runs of seeds with their extensions, the same with their measures)."""
    own = g.on(rows)
    seeds = runs_beside(own, F.col("valid") & F.col("isi").between(g.seed_low, g.seed_high), g.bridge, int(g.most("max_extension")))
    seeds = g.on(seeds).where(F.col("n") >= g.min_seeds).select("train", "start", "end", "_l", "_r")
    some = g.on(extended(seeds)).where((F.col("start") - F.col("s") <= g.max_extension) & (F.col("e") - F.col("end") <= g.max_extension))
    order = Window.partitionBy("train").orderBy("start", F.desc("s"), "e")  # the order in which they are made
    once = F.row_number().over(Window.partitionBy("train", "s", "e").orderBy("start"))
    some = some.withColumn("_k", once).where("_k = 1").where(F.col("e") - F.col("s") + 2 >= g.min_spikes)
    if g.given("max_candidates"):
        some = some.withColumn("_i", F.row_number().over(order)).where(F.coalesce(F.col("_i") <= g.max_candidates, F.lit(True)))
    spans = stored(some.select("train", F.col("s").alias("start"), F.col("e").alias("end")), "burst-spans")
    flags = rows.withColumn("suspect", F.lit(False))
    m = g.on(span_metrics(flags, g.on(spans), g.seed_high, g.bridge).join(ref, "train"))
    m = m.withColumns({"purity": F.col("core") / F.col("n_isi"), "bridge_share": F.col("bridges") / F.col("n_isi"), "excess": F.col("q95") / g.bridge, "contrast": F.least("pre_ratio", "post_ratio"), "spikes": F.col("end") - F.col("start") + 2})
    return spans, m


def bursts(rows: DataFrame, ref: DataFrame, g: Grammar | Bounds) -> DataFrame:
    """Burst candidates: runs of seed intervals with up to four bridges added on each side, judged by how they stand out from their flanks, and dense episodes."""
    g = bounds(g)
    spans, m = burst_measures(rows, ref, g)
    core, n = F.col("core"), F.col("n_isi")
    a, b = F.col("pre_ratio"), F.col("post_ratio")
    ok = lambda c: F.coalesce(c, F.lit(False))
    q95 = (F.col("excess") <= 1) | (~g.strict_q95 & (F.col("excess") <= g.q95_limit))
    passed = ok((F.col("bridges") <= g.max_bridges) & (F.col("bridge_share") <= g.max_bridge_share) & (F.col("q90") <= g.bridge) & q95)
    two = ok((a >= g.contrast) & (b >= g.contrast))
    maybe = ok((a >= g.possible_contrast) & (b >= g.possible_contrast))
    one = ok(a >= g.contrast + g.one_sided_extra) | ok(b >= g.contrast + g.one_sided_extra)
    clean = one & (F.col("purity") >= g.one_sided_purity) & (F.col("bridge_share") <= F.least(g.one_sided_bridge_share, g.max_bridge_share))
    scale = F.greatest("_q75", "pre", "post") / F.col("q90")
    rescue = passed & (F.col("purity") >= g.rescue_purity) & (F.col("cv").isNull() | (F.col("cv") <= g.rescue_cv)) & ok(scale >= g.rescue_ratio)
    strong = rescue & ok(scale >= g.strong_rescue_ratio)
    size = F.when(F.col("spikes") <= g.classic_spikes, "burst").when(F.col("spikes").between(*g.long_spikes), "long_burst").otherwise("prolonged")
    sized = size != "prolonged"
    priority = lambda **k: possible_priority(F.col("contrast"), core, F.col("bridge_share"), F.col("purity"), g, excess=F.col("excess"), **k)
    m = m.withColumn("gate", F.when(passed & two & sized, "two_sided").when(passed & two, "prolonged").when(passed & clean, F.when(a.isNull() | b.isNull(), "edge_limited").otherwise("one_sided")).when(passed & maybe, "possible_two_sided").when(strong & sized, "rescue").when(rescue, "possible_rescue").otherwise("reject"))
    gate = F.col("gate")
    m = m.withColumns({
        "label": F.when(gate.isin("two_sided", "rescue"), size).when(gate == "reject", "reject").otherwise("possible_burst"),
        "priority": F.when((gate == "two_sided") & (size == "burst"), 1250.0).when(gate == "two_sided", 1160.0).when(gate == "prolonged", priority(two=True)).when(gate.isin("edge_limited", "one_sided"), priority(one=True)).when(gate == "possible_two_sided", priority(two=True)).when((gate == "rescue") & (size == "burst"), 1010.0).when(gate == "rescue", 960.0).when(gate == "possible_rescue", priority()).otherwise(0.0),
        "action": F.when(gate.isin("two_sided", "rescue"), "accept").when(gate == "reject", "reject").otherwise("demote_to_possible"),
        "score": F.coalesce("contrast", F.lit(0.0)) + 0.16 * core + 0.35 * F.col("purity") - 0.20 * F.col("bridges") - 0.45 * F.col("bridge_share") - F.when(F.col("excess") > 1, 0.45 * F.least(F.lit(2.0), F.col("excess") - 1)).otherwise(0.0),
    })
    return _table(m, "burst").unionByName(episodes(rows, spans, ref, g))


def episodes(rows: DataFrame, taken: DataFrame, ref: DataFrame, g: Grammar | Bounds) -> DataFrame:
    """Dense episodes: runs below a bound that the train's own scale sets, without long intervals at their ends."""
    g = bounds(g)
    top = F.greatest(g.bridge, F.least(g.bridge * g.episode_bridge_factor, F.col("_q75") * g.episode_background))
    tops = stored(g.on(ref).select("train", "_q75", top.alias("_top")), "episode-bounds")
    x = rows.join(tops, "train")
    flag = F.col("valid") & (F.col("isi") <= F.col("_top"))
    found = g.on(runs(x, flag, q("isi", 0.9).alias("_e90"), F.first("_top").alias("_top"))).where(F.col("n") >= g.episode_min_isi)
    edge = F.least(F.greatest(g.bridge, 1.1 * F.col("_e90")), F.col("_top"))
    at = rows.select("train", F.col("idx").alias("start"), F.col("idx").alias("end"), "isi")
    inside = range_join(found.select("train", "start", "end", edge.alias("edge")), at, ["train"]).where(F.col("r_isi") <= F.col("l_edge"))
    trimmed = g.on(inside.groupBy("train", "l_start").agg(F.min("r_start").alias("start"), F.max("r_start").alias("end")).drop("l_start")).where(F.col("end") - F.col("start") + 1 >= g.episode_min_isi)
    new = stored(trimmed.select("train", "start", "end").join(taken, ["train", "start", "end"], "left_anti"), "episode-spans")
    seed = F.when(F.col("isi").between(g.seed_low, g.seed_high), F.col("isi"))
    m = g.on(span_metrics(g.off(g.on(rows).withColumn("suspect", seed.isNotNull())), g.on(new), g.seed_high, g.bridge).join(tops, "train"))
    n = F.col("n_isi")
    shares = {"seed_share": F.col("suspects") / n, "bridge_share": (F.col("core") + F.col("bridges")) / n, "compression": F.col("_q75") / F.col("q90"), "spikes": F.col("end") - F.col("start") + 2}
    m = m.withColumns(shares)
    entry = ((F.col("suspects") >= 1) & (F.col("seed_share") >= g.episode_seed_share)) | (F.col("compression") >= g.rescue_ratio)
    m = m.where(entry & (n >= g.episode_min_isi) & (F.col("q90") <= F.col("_top")) & (F.col("cv").isNull() | (F.col("cv") <= g.episode_cv)) & (F.col("compression") >= g.rescue_ratio) & (F.col("spikes") >= g.min_spikes))
    label = F.when(F.col("spikes") <= F.greatest(g.classic_spikes, g.episode_spikes), "burst").when(F.col("spikes").between(*g.long_spikes), "long_burst").otherwise("possible_burst")
    # the variation of the intervals takes nothing off: the compression is always finite here
    score = 4 + 0.12 * n + 0.6 * F.col("seed_share") + 0.5 * F.col("bridge_share") + F.least(F.lit(4.0), 0.2 * F.col("compression"))
    m = m.withColumn("label", label)
    possible = possible_priority(F.least("pre_ratio", "post_ratio"), F.col("core"), 1 - F.col("core") / n, F.col("core") / n, g)
    return _table(m, "episode", gate=F.lit("dense_episode"), action=F.when(F.col("label") == "possible_burst", "demote_to_possible").otherwise("accept"), score=score, priority=F.when(F.col("label") == "burst", 1035.0).when(F.col("label") == "long_burst", 985.0).otherwise(possible))


def high_frequency_spiking(rows: DataFrame, ref: DataFrame, g: Grammar | Bounds) -> DataFrame:
    """Long states of mostly short intervals, across a few longer ones.

    Intervals labelled by hand as a burst belong to no state and no gap. A gap holds no interval as long as the least of the hard break, the pause and the state's greatest interval. Artifacts may stand in a
    gap; across such a gap a state goes on only while it is still too short by itself."""
    m, gates, strict = spiking_measures(rows, bounds(g))
    m = m.where(all_hold(gates))
    score = 24 + 0.08 * (F.col("end") - F.col("start") + 2) + 2.5 * F.col("short") + 2.0 * F.col("mid") + 1.5 * F.col("bridged") - 2.0 * F.col("large") + F.when(strict, 1.0).otherwise(0.4)
    return _table(m, "hf_spiking", label=F.lit("high_frequency_spiking"), gate=F.lit("hf_spiking_state"), action=F.lit("accept"), score=score, priority=F.lit(1040.0))


def spiking_measures(rows: DataFrame, g: Bounds) -> tuple[DataFrame, list[Gate | Either], Column]:
    """(long runs of support with their measures, the gates that they have to pass, whether the strict one does)."""
    own = g.on(rows)
    locked = F.coalesce(F.col("manual").isin("burst", "long_burst", "possible_burst"), F.lit(False)) if "manual" in rows.columns else F.lit(False)
    own = own.withColumns({"_locked": locked}).withColumn("valid", F.col("valid") & ~F.col("_locked"))
    most = lambda c: F.coalesce(F.col("isi") <= c, F.lit(True))  # noqa: E731  null: no limit
    support = (F.col("isi") <= g.hfs_bridge) & (F.col("isi") < g.pause_min) & most(g.hfs_max)
    own = own.withColumns({"_side": (F.greatest(F.lit(3), g.hfs_spikes) - 1).cast("int"), "_s": support})
    found = support_runs(own, F.col("_s"), F.least(g.hfs_tolerated, g.hfs_max), F.least(g.hfs_break, g.pause_min, g.hfs_max), F.greatest(F.lit(1), g.hfs_gap), transparent=F.col("artifact"), short_side="_side")
    found = stored(g.on(found).where(F.col("end") - F.col("start") + 2 >= F.greatest(F.lit(3), g.hfs_spikes)).select("train", "start", "end"), "spiking-spans")
    if "manual" in rows.columns:  # only an artifact can be labelled and inside
        held = own.where(F.col("_locked")).select("train", F.col("idx").alias("start"), F.col("idx").alias("end"))
        held = range_join(found, held, ["train"]).select("train", F.col("l_start").alias("start"), F.col("l_end").alias("end")).distinct()
        found = found.join(held, ["train", "start", "end"], "left_anti")
    above = F.col("valid") & (F.col("isi") > g.hfs_bridge)
    n_valid = F.count_if("valid").over(in_train().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    own = own.withColumns({"suspect": F.col("isi") <= g.hfs_q90, "_above": F.coalesce(above, F.lit(False)), "_nth": n_valid})
    # an invalid interval doesn't part the ones beside it: it has the number of the valid one before it
    up = in_train().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = F.when(F.col("_above"), F.col("_nth") - F.coalesce(F.max(F.when(F.col("valid") & ~F.col("_above"), F.col("_nth"))).over(up), F.lit(0))).otherwise(0)
    own = own.withColumns({"_row": row, "_over": F.col("isi") > g.hfs_tolerated})
    m = g.on(span_metrics(g.off(own), g.on(found), g.hfs_short, g.hfs_bridge, quantiles=(0.8, 0.9), longest=("max", "_row"), over=("count", "_over")))
    n = F.col("n_isi")
    m = m.withColumns({"short": F.col("core") / n, "mid": F.col("suspects") / n, "bridged": (F.col("core") + F.col("bridges")) / n, "tolerated": 1 - F.col("over") / n})
    m = m.withColumns({"large": 1 - F.col("bridged"), "tolerated_gap": g.hfs_tolerated.cast("double"), "q90_most": g.hfs_q90.cast("double")})
    strict = Gate("q90", F.col("q90"), g.hfs_q90)
    robust = Gate("q80", F.col("q80"), g.hfs_q80)
    majority = [Gate("short", F.col("short"), F.lit(0.55), ">="), Gate("mid", F.col("mid"), F.lit(0.6), ">="), Gate("bridged", F.col("bridged"), F.lit(0.75), ">=")]
    gates: list[Gate | Either] = [
        Either("compact", ((strict,), *((robust, x) for x in majority))), Gate("tolerated", F.col("tolerated"), F.lit(0.95), ">="), Gate("large", F.col("large"), g.hfs_large_share),
        Gate("large_run", F.col("longest"), F.greatest(F.lit(2), g.hfs_gap)),
    ]
    return m, gates, strict.holds


def high_frequency_tonic(rows: DataFrame, ref: DataFrame, g: Grammar | Bounds) -> DataFrame:
    """Fast regular runs without bursts."""
    m, gates = fast_tonic_measures(rows, bounds(g))
    m = m.where(all_hold(gates))
    return _table(m, "hf_tonic", label=F.lit("high_frequency_tonic"), gate=F.lit("hf_tonic_state"), action=F.lit("accept"), score=5 + (1 - F.col("low")) + F.coalesce(1 / (1 + F.col("cv")), F.lit(0.0)), priority=F.lit(500.0))


def fast_tonic_measures(rows: DataFrame, g: Bounds) -> tuple[DataFrame, list[Gate | Either]]:
    own = g.on(rows)
    member = F.coalesce(F.col("valid") & (F.col("isi") <= g.hft_max), F.lit(False))
    found = g.on(runs(own, member)).where(F.col("end") - F.col("start") + 2 >= g.hft_spikes).select("train", "start", "end")
    own = own.withColumn("_seed", member & F.col("isi").between(g.seed_low, g.seed_high))
    own = own.withColumns({"suspect": F.col("isi") < g.hft_floor, "_row": run_length(F.col("_seed"))})
    m = g.on(span_metrics(g.off(own), g.on(found), g.seed_high, g.hft_max, longest=("max", "_row")))
    m = m.withColumn("low", F.col("suspects") / F.col("n_isi"))
    gates: list[Gate | Either] = [
        Gate("q90", F.col("q90"), g.hft_max), Either("low_tail", ((Gate("q10", F.col("q10"), g.hft_floor, ">="),), (Gate("low_share", F.col("low"), g.hft_low_share),))), Gate("seed_run", F.col("longest"), g.min_seeds - 1),
        Gate("cv", F.col("cv"), g.hft_cv), Gate("lv", F.col("lv"), g.hft_lv), Gate("mm", F.col("mm"), g.hft_mm),
    ]
    return m, gates


def tonic(rows: DataFrame, ref: DataFrame, g: Grammar | Bounds) -> DataFrame:
    """Stable runs within the train's tonic band, and the cores of such runs without slower beginnings and ends."""
    m, gates = tonic_measures(rows, ref, bounds(g))
    m = m.where(all_hold(gates))
    lv = F.col("lv")
    return _table(m, "tonic", label=F.lit("tonic"), action=F.lit("accept"), score=3 + F.coalesce(1 / (1 + lv), F.lit(0.0)), priority=F.when(F.col("gate") == "tonic", 350.0).otherwise(340.0))


def tonic_measures(rows: DataFrame, ref: DataFrame, g: Bounds) -> tuple[DataFrame, list[Gate | Either]]:
    """(runs within the tonic band with their measures, the gates that they have to pass)."""
    x = rows.join(ref.select("train", "_lower", "_upper", "_q75", "_n"), "train")
    band = F.col("valid") & F.col("isi").between(F.col("_lower"), F.col("_upper"))
    core_low = F.when(F.greatest("_lower", F.when(F.col("_n") >= 6, F.col("_q75") * 0.65)) > F.col("_upper"), F.col("_lower")).otherwise(F.greatest("_lower", F.when(F.col("_n") >= 6, F.col("_q75") * 0.65)))
    full = runs(x, band).select("train", "start", "end", F.lit("tonic").alias("gate"))
    core = runs(x, band & (F.col("isi") >= core_low)).select("train", "start", "end", F.lit("tonic_core").alias("gate")).join(full, ["train", "start", "end"], "left_anti")
    found = stored(g.off(g.on(full.unionByName(core)).where(F.col("end") - F.col("start") + 2 >= g.tonic_spikes)), "tonic-spans")
    seeds = F.col("isi").between(g.seed_low, g.seed_high)
    # core counts what lies within the longest interval of bursts
    m = span_metrics(g.off(g.on(rows).withColumn("suspect", seeds)), g.on(found), burst_reference(g), burst_reference(g)).join(found, ["train", "start", "end"])
    m = g.on(m)
    ref_ = burst_reference(g)
    lv, n = F.col("lv"), F.col("n_isi")
    mm_low, mm_high = g.tonic_mm
    most = F.when((lv <= F.least(g.tonic_lv, F.lit(0.15))) & (F.col("cv") <= 0.3), F.greatest(g.tonic_calm_mm, mm_high)).otherwise(mm_high)
    gates: list[Gate | Either] = [
        Gate("mean", F.col("mean_isi"), ref_ * g.tonic_guard, ">"), Gate("median", F.col("q50"), ref_ * g.tonic_guard, ">"), Gate("low_quantile", F.col("q10"), ref_, ">"), Gate("low_share", F.col("core") / n, g.tonic_low_share),
        Gate("lv", lv, g.tonic_lv), Gate("mm_high", F.col("mm"), most), Gate("mm_low", F.col("mm"), mm_low, ">="), Gate("seed_share", F.col("suspects") / n, F.lit(0.2)),
    ]
    return m, gates


def pauses(rows: DataFrame, ref: DataFrame, g: Grammar | Bounds) -> DataFrame:
    """Runs of intervals over the train's pause floor that are long for their surroundings and for the train."""
    g = bounds(g)
    x = pause_measures(rows, ref, g)
    local = F.col("_local")
    stands = F.col("_long") & ((F.col("_n") < 6) | ((local.isNull() | (F.col("isi") >= local * g.pause_local)) & (F.col("isi") >= F.col("_median") * g.pause_global)))
    found = stored(runs(x, stands, F.max("isi").alias("_m"), F.first("_floor").alias("_f")), "pause-spans")
    m = span_metrics(rows, g.on(found), g.seed_high, g.bridge).join(found.select("train", "start", "end", (F.col("_m") / F.col("_f")).alias("score")), ["train", "start", "end"])
    return _table(m, "pause", label=F.lit("pause"), gate=F.lit("pause_gap"), action=F.lit("accept"), priority=F.lit(300.0))


def pause_measures(rows: DataFrame, ref: DataFrame, g: Bounds, slack: float = 0.0) -> DataFrame:
    """(train, idx, isi, valid, the train's floor and median, _long, _local) of the intervals that come within a share of slack of the floor: _local is the median of those around that aren't over it (of all
    others, if there are none)."""
    x = g.on(rows.join(ref.select("train", "_floor", F.col("_q50").alias("_median"), "_n"), "train"))
    long = F.coalesce(F.col("valid") & (F.col("isi") >= F.col("_floor")), F.lit(False))
    wanted = F.col("valid") & (F.col("isi") >= F.col("_floor") * (1 - slack))
    x = x.withColumns({"_long": long, "_wanted": F.coalesce(wanted, F.lit(False)), "_other": F.when(F.col("valid"), F.col("isi"))}).withColumn("_calm", F.when(~F.col("_long"), F.col("_other")))
    x = with_medians(x.select("train", "idx", "isi", "valid", "_floor", "_median", "_n", "_long", "_wanted", "_calm", "_other"), {"_a": ("_calm", 11), "_b": ("_other", 11)}, only="_wanted")
    return g.on(x.withColumn("_local", F.coalesce("_a", "_b")).drop("_wanted", "_calm", "_other", "_a", "_b"))


def hard_threshold(rows: DataFrame, bound: float, g: Grammar | Bounds, core: int = 2) -> DataFrame:
    """Runs at or below a bound set by hand, with enough seed intervals; nothing else is asked of them."""
    g = bounds(g)
    found = runs(g.on(rows), F.col("valid") & (F.col("isi") <= bound), F.count_if(F.col("isi") <= g.seed_high).alias("_core"))
    found = g.on(found).where((F.col("_core") >= core) & (F.col("end") - F.col("start") + 2 >= g.min_spikes))
    m = g.on(span_metrics(rows, g.on(found.select("train", "start", "end")), g.seed_high, bound))
    label = F.when(F.col("n_isi") + 1 <= g.classic_spikes, "burst").otherwise("long_burst")
    return _table(m, "hard_threshold", label=label, gate=F.lit("hard_threshold"), action=F.lit("accept"), score=F.col("core") / F.col("n_isi"), priority=F.lit(1800.0))


#: What a pipeline of detectors may be made of.
DETECTORS = {"bursts": bursts, "high_frequency_spiking": high_frequency_spiking, "high_frequency_tonic": high_frequency_tonic, "tonic": tonic, "pauses": pauses}


def candidates(rows: DataFrame, g: Grammar | Bounds, names: list[str] | None = None) -> DataFrame:
    """All candidates of the detectors named (all of them if none are), with an id in the order of layer, start and end."""
    g = bounds(g)
    ref = references(rows, g)
    made = reduce(DataFrame.unionByName, [stored(DETECTORS[n](rows, ref, g), f"candidates-{n}") for n in names or DETECTORS])
    return made.withColumn("candidate", F.row_number().over(Window.partitionBy("train").orderBy("layer", "start", "end", "gate")))


# What becomes of a candidate because of a spiking state.
DOMINATED, PACKETS, NEIGHBOUR = "reject_burst_dominated_hf_spiking_state", "reject_burst_packet_like_hf_spiking_state", "reject_burst_packet_neighbor_hf_spiking_state"
COVERED, EMBEDDED = "suppress_for_hf_spiking_state", "suppress_embedded_burst_for_hf_spiking_state"
#: The greatest gap between neighbouring states, in intervals, and in seconds where none is known.
STATE_GAP, STATE_SECONDS = 3, 0.075


def burst_cover(states: DataFrame, events: DataFrame) -> DataFrame:
    """(train, candidate, bursts, groups, covered) of states that hold bursts whole: how many, how many groups of overlapping ones, and how many intervals those groups cover together."""
    inside = range_join(states.select("train", "start", "end", "candidate"), events.select("train", "start", "end"), ["train"], 64).where((F.col("r_start") >= F.col("l_start")) & (F.col("r_end") <= F.col("l_end")))
    before = F.max("r_end").over(Window.partitionBy("train", "l_candidate").orderBy("r_start", "r_end").rowsBetween(Window.unboundedPreceding, -1))
    x = inside.withColumn("_before", before)
    new = F.greatest(F.lit(0), F.col("r_end") - F.greatest(F.coalesce("_before", F.col("r_start") - 1), F.col("r_start") - 1))
    apart = F.col("_before").isNull() | (F.col("r_start") > F.col("_before"))
    return x.groupBy("train", F.col("l_candidate").alias("candidate")).agg(F.count(F.lit(1)).alias("bursts"), F.count_if(apart).alias("groups"), F.sum(new).alias("covered"))


def state_verdicts(found: DataFrame) -> DataFrame:
    """(train, candidate, bursts, groups, coverage, packet_like, action) of every spiking state; action is null if it stands.

    A state is struck out if groups of bursts dominate it, or if it varies and holds groups like packets. What then varies and lies within three intervals, and a gap short enough, of a packet-like state goes as
    well; that isn't passed on any further."""
    no = lambda c: F.coalesce(c, F.lit(False))
    states = found.where("label = 'high_frequency_spiking'")
    cover = burst_cover(states, found.where(F.col("label").isin("burst", "long_burst")))
    x = states.join(cover, ["train", "candidate"], "left").fillna(0, ["bursts", "groups", "covered"]).withColumn("_n", F.col("end") - F.col("start") + 1)
    x = x.withColumn("coverage", F.col("covered") / F.col("_n"))
    groups, coverage = F.col("groups"), F.col("coverage")
    dominated = (groups >= F.greatest(F.lit(6), F.ceil(F.lit(0.055) * F.col("_n")))) & (coverage >= 0.25)
    x = x.withColumn("_varies", no(F.col("cv") >= 0.65) | no(F.col("lv") >= 0.45) | no(F.col("mm") >= 3.0))
    packet = (F.col("_varies") | no(F.col("large") >= 0.08)) & (((groups >= 2) & (coverage >= 0.08)) | ((groups >= 1) & (coverage >= 0.18)))
    x = stored(x.withColumns({"packet_like": packet, "action": F.when(dominated, DOMINATED).when(packet, PACKETS)}), "states")
    rest = x.where("action is null and _varies").select("train", "candidate", (F.col("start") - STATE_GAP - 1).alias("start"), (F.col("end") + STATE_GAP + 1).alias("end"), "pre", "post", "tolerated_gap")
    near = range_join(rest, x.where("packet_like").select("train", "start", "end", "pre", "post", "tolerated_gap"), ["train"], 64)
    a, b = F.col("l_start") + STATE_GAP + 1, F.col("l_end") - STATE_GAP - 1
    gap = F.when(F.col("r_end") < a, F.coalesce("l_pre", "r_post")).when(b < F.col("r_start"), F.coalesce("l_post", "r_pre")).otherwise(0.0)
    tolerated = F.coalesce(F.greatest("l_tolerated_gap", "r_tolerated_gap"), F.lit(STATE_SECONDS))
    beside = near.where(gap <= tolerated).select("train", F.col("l_candidate").alias("candidate")).distinct().withColumn("_beside", F.lit(True))
    x = x.join(beside, ["train", "candidate"], "left").withColumn("action", F.when(F.col("_beside"), NEIGHBOUR).otherwise(F.col("action")))
    return x.select("train", "candidate", "bursts", "groups", "coverage", "packet_like", "action")


def protected(found: DataFrame) -> DataFrame:
    """Candidates with those struck out (label reject, and the action that says why) that high-frequency spiking states decide over: states that are made of bursts (state_verdicts); then, for
    those that stand, possible bursts, tonic states and pauses that overlap one, and short bursts inside a strong one."""
    gone = stored(state_verdicts(found).where("action is not null").select("train", "candidate", "action"), "states-struck-out")
    states = found.where("label = 'high_frequency_spiking'").join(gone, ["train", "candidate"], "left_anti").withColumn("_n", F.col("end") - F.col("start") + 1)
    weak = found.where(F.col("label").isin("possible_burst", "high_frequency_tonic", "tonic", "pause")).select("train", "start", "end", "candidate")
    covered = range_join(states.select("train", "start", "end"), weak, ["train"], 64).select("train", F.col("r_candidate").alias("candidate"), F.lit(COVERED).alias("action"))
    most = lambda c, least: F.coalesce(F.col(c) >= least, F.lit(True))  # noqa: E731  null: not known, not asked for
    calm = F.coalesce(F.col("q90") <= F.col("q90_most"), F.lit(True))
    sustained = (F.col("_n") >= 80) & most("short", 0.70) & most("bridged", 0.90) & calm
    pure = (F.col("_n") >= 30) & F.coalesce((F.col("short") >= 0.85) & (F.col("bridged") >= 0.95), F.lit(False)) & calm
    bursts_ = found.where(F.col("label").isin("burst", "long_burst")).select("train", "start", "end", "candidate", "duration")
    inside = range_join(states.where(sustained | pure).select("train", "start", "end"), bursts_, ["train"], 64)
    size, n = F.col("r_end") - F.col("r_start") + 1, F.col("l_end") - F.col("l_start") + 1
    short = (size <= F.greatest(F.lit(8), F.ceil(F.lit(0.06) * n))) & F.coalesce(F.col("r_duration") <= 0.25, F.lit(True))
    inside = inside.where((F.col("r_start") >= F.col("l_start")) & (F.col("r_end") <= F.col("l_end")) & short).select("train", F.col("r_candidate").alias("candidate"), F.lit(EMBEDDED).alias("action"))
    struck = stored(gone.unionByName(covered).unionByName(inside).distinct().withColumnRenamed("action", "_action"), "struck-out")
    x = found.join(struck, ["train", "candidate"], "left")
    out = F.col("_action").isNotNull()
    return x.withColumns({"label": F.when(out, "reject").otherwise(F.col("label")), "action": F.coalesce("_action", "action")}).drop("_action")


def value(c: DataFrame) -> Column:
    """What a candidate is worth in the selection."""
    label, n, score, p = F.col("label"), F.col("n_isi"), F.col("score"), F.col("priority")
    hard = F.when(label == "burst", 1800 * 10000 + 2_500_000 * F.least(n, F.lit(80))).when(label == "long_burst", 980 * 10000 + 20_000 * F.least(n, F.lit(300))).otherwise(900 * 10000 + 5_000 * F.least(n, F.lit(300))) + 180 * score
    episode = F.when(label == "burst", 1250).otherwise(1160) * 10000 + 180 * score + 2_500_000 * F.least(n, F.lit(80))
    other = F.when(label == "possible_burst", F.least(p, F.lit(520.0))).otherwise(p) * 10000 + 100 * score + n
    return F.when(F.col("layer") == "hard_threshold", hard).when(label == "high_frequency_spiking", 1040 * 10000 + 180 * score + 45_000 * F.least(n, F.lit(300))).when(label.isin("burst", "long_burst") & (F.col("layer") == "episode"), episode).otherwise(other).cast("double")


def best_apart(starts: np.ndarray, ends: np.ndarray, worth: np.ndarray) -> list[int]:
    """Places of the ranges without overlap that are worth most in all, of ranges in the order of their ends."""
    before = ends.searchsorted(starts, side="left").tolist()  # how many end before it starts
    best, take = [0.0], []
    for value, b in zip(worth.tolist(), before, strict=True):
        with_it = value + best[b]
        take.append(with_it > best[-1])
        best.append(max(with_it, best[-1]))
    chosen, j = [], len(take)
    while j > 0:
        if take[j - 1]:
            chosen.append(j - 1)
            j = before[j - 1]
        else:
            j -= 1
    return chosen


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidates sorted by train and end, those that best_apart() takes of each train; a train may go on in the next batch."""

    def close(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        starts, ends, worth = (t.column(c).to_numpy() for c in ("start", "end", "value"))
        named = t.column("train").combine_chunks().dictionary_encode() if t.num_rows else None
        code = named.indices.to_numpy(zero_copy_only=False) if named is not None else np.zeros(0, int)
        edges = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True]) if len(code) else []
        keep = [int(a) + i for a, b in zip(edges, edges[1:], strict=False) for i in best_apart(starts[a:b], ends[a:b], worth[a:b])]
        if keep:
            yield from t.select(["train", "candidate"]).take(keep).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        train, last = b.column(0), b.column(0)[b.num_rows - 1]
        differs = pc.not_equal(train, last).to_numpy(zero_copy_only=False)
        n = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if n or (held and held[0].column(0)[0] != last):
            yield from close([*held, b.slice(0, n)])
            held = []
        held.append(b.slice(n))
    if held:
        yield from close(held)


def select(found: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """found plus selected: of each train's candidates, those without overlap that are worth most in all. With locked (train, idx), candidates that hold such a row are left out.

    A train's choice depends on all its candidates in order, so it's one scan of them; rows hold numbers only.
    """
    pool = found.where(F.col("label") != "reject").withColumn("value", value(found))
    if locked is not None:
        at = locked.select("train", F.col("idx").alias("start"), F.col("idx").alias("end"))
        hit = range_join(pool.select("train", "candidate", "start", "end"), at, ["train"]).select("train", F.col("l_candidate").alias("candidate")).distinct()
        pool = pool.join(hit, ["train", "candidate"], "left_anti")

    rows = pool.select("train", "candidate", "start", "end", "value").repartition("train").sortWithinPartitions("train", "end", "start", "candidate")
    chosen = rows.mapInArrow(_chosen, f"train {found.schema['train'].dataType.simpleString()}, candidate int").withColumn("selected", F.lit(True))
    return found.join(chosen, ["train", "candidate"], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def written(rows: DataFrame, chosen: DataFrame, lock_manual: bool = True, limits: Limits | None = None) -> DataFrame:
    """rows with auto: the label of the selected candidate that covers the row. What is left of events is checked (gates.validated), and rows with a label by hand are blanked."""
    # selected candidates don't overlap: laid out, they have a row for each interval at most
    cover = chosen.where("selected").select("train", F.explode(F.sequence(*[F.col(c).cast(dict(rows.dtypes)["idx"]) for c in ("start", "end")])).alias("idx"), F.col("label").alias("auto"))
    out = rows.drop("auto").join(cover, ["train", "idx"], "left").withColumn("auto", F.coalesce("auto", F.lit("")))
    out = validated(out if lock_manual or "manual" not in rows.columns else out.withColumnRenamed("manual", "_manual"), limits=limits).drop("removed")
    out = out.withColumnRenamed("_manual", "manual") if "_manual" in out.columns else out
    if lock_manual and "manual" in rows.columns:
        out = out.withColumn("auto", F.when(F.coalesce("manual", F.lit("")) != "", "").otherwise(F.col("auto")))
    return out


def without_negatives(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates with bursts struck out (label reject, gate manual_negative_veto) that hold an interval labelled as no burst (rows with negative)."""
    if "negative" not in rows.columns:
        return found
    veto = F.col("label").isin(BURSTS) & (F.col("negative_share") > 0)
    x = negative_overlap(rows, found)
    return x.withColumns({"gate": F.when(veto, "manual_negative_veto").otherwise(F.col("gate")), "label": F.when(veto, "reject").otherwise(F.col("label"))}).drop("negative_share")


def detect(rows: DataFrame, g: Grammar | DataFrame | Bounds | None = None, lock_manual: bool = True, limits: Limits | None = None, kept: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with auto labels, all candidates with what became of them). Labels by hand that deny a burst (column negative) strike out burst candidates; limits are those of gates.validated.

    Settings are one Grammar for all trains, or a table with a train and any settings a row: each train is judged by its own, in the same plan. Rows that are kept are a stored table already."""
    g = bounds(g)
    rows = usable(rows) if kept else stored(usable(rows), "trains")
    found = stored(candidates(rows, g), "candidates")
    if "negative" in rows.columns:
        found = stored(without_negatives(rows, found), "judged")
    ledger = stored(select(protected(found)), "ledger")
    return written(rows, ledger, lock_manual, limits), ledger


def final_labels(rows: DataFrame) -> DataFrame:
    """rows plus final: the label by hand if there is one, else the detected one; an artifact takes the label that both neighbours share, if of the burst family or tonic."""
    base = F.when(F.coalesce("manual", F.lit("")) != "", F.col("manual")).otherwise(F.col("auto"))
    x = rows.withColumn("_l", base)
    shared = (F.lag("_l").over(in_train()) == F.lead("_l").over(in_train())) & F.lag("_l").over(in_train()).isin("burst", "long_burst", "possible_burst", "tonic")
    return x.withColumns({"final": F.when(F.col("artifact") & (F.col("_l") == "") & shared, F.lag("_l").over(in_train())).otherwise(F.col("_l")), "source": F.when(F.coalesce("manual", F.lit("")) != "", "manual").when(F.col("auto") != "", "auto").otherwise("none")}).drop("_l")


def extracted(rows: DataFrame, label: str = "final") -> DataFrame:
    """One row for each event: runs of equal labels with their measures, flanks and the list of intervals."""
    from .runs import segments

    seg = segments(rows, F.col(label)).where("label <> ''").select("train", "label", "start", "end")
    m = span_metrics(rows, seg.select("train", "start", "end"), 0.01, 0.015, intervals=True)
    return seg.join(m, ["train", "start", "end"]).withColumns({"n_spikes": F.col("end") - F.col("start") + 2, "family": F.when(F.col("label").isin("burst", "long_burst", "possible_burst"), "burst_family").otherwise(F.col("label")), "review": (F.col("label") == "possible_burst") | (F.col("suspects") > 0)})


def near_misses(found: DataFrame, g: Grammar, slack: float = 0.25) -> DataFrame:
    """Rejected burst candidates that fail by one gate, and by no more than the slack: which, and by how much."""
    over = lambda c, most: F.greatest(F.lit(0.0), F.col(c) / most - 1)
    x = found.where("label = 'reject' and layer = 'burst'").withColumns({"_q90": over("q90", g.bridge), "_cv": over("cv", g.rescue_cv)})
    misses = F.filter(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(f"_{n}").alias("by")) for n in ("q90", "cv")]), lambda s: s["by"] > 0)
    return x.withColumn("_m", misses).where((F.size("_m") == 1) & (F.col("_m")[0]["by"] <= slack)).select("train", "start", "end", F.col("_m")[0]["gate"].alias("failed"), F.col("_m")[0]["by"].alias("by"))


def gate_near_misses(rows: DataFrame, g: Grammar | DataFrame | Bounds | None = None, slack: float = 0.25, layers: tuple[str, ...] = ("burst", "hf_spiking", "hf_tonic", "tonic", "pause")) -> DataFrame:
    """(train, start, end, layer, gate, by, failed): what each layer's detector turned down but would have found with every gate relaxed by a share of slack at most, the gate that asks for most and by how much.

    A burst has to keep within its bridges and to stand out from both flanks, or to be pure, even and short for its train or its flanks; a pause has to reach the train's floor, its surroundings and the
    median, interval by interval. A condition that can't be met by relaxing, as a missing flank, is no near miss."""
    g = bounds(g)
    rows = stored(usable(rows), "trains")
    ref = references(rows, g)
    out = []
    if "burst" in layers:
        _, m = burst_measures(rows, ref, g)
        scale = F.greatest("_q75", "pre", "post") / F.col("q90")
        least = F.when(F.col("pre_ratio").isNotNull() & F.col("post_ratio").isNotNull(), F.least("pre_ratio", "post_ratio"))
        two = Known("flanks", least, g.possible_contrast, ">=")
        rescue = (Gate("purity", F.col("purity"), g.rescue_purity, ">="), Gate("cv", F.col("cv"), g.rescue_cv), Known("scale", scale, g.rescue_ratio, ">="))
        one = F.greatest("pre_ratio", "post_ratio")
        clean = (Known("flank", one, g.contrast + g.one_sided_extra, ">="), Gate("one_sided_purity", F.col("purity"), g.one_sided_purity, ">="), Gate("one_sided_bridges", F.col("bridge_share"), F.least(g.one_sided_bridge_share, g.max_bridge_share)))
        limit = F.when(g.strict_q95, 1.0).otherwise(g.q95_limit)
        gates = [Gate("bridges", F.col("bridges"), g.max_bridges), Gate("bridge_share", F.col("bridge_share"), g.max_bridge_share), Gate("q90", F.col("q90"), g.bridge), Gate("q95", F.col("excess"), limit), Either("contrast", ((two,), clean, rescue))]
        out.append(missed(m, gates, "burst", slack))
    if "hf_spiking" in layers:
        m, gates, _ = spiking_measures(rows, g)
        out.append(missed(m, gates, "hf_spiking", slack))
    if "hf_tonic" in layers:
        out.append(missed(*fast_tonic_measures(rows, g), "hf_tonic", slack))
    if "tonic" in layers:
        m, gates = tonic_measures(rows, ref, g)
        out.append(missed(m.where("gate = 'tonic'"), gates, "tonic", slack))
    if "pause" in layers:
        x = pause_measures(rows, ref, g, slack).where(F.col("valid") & (F.col("isi") >= F.col("_floor") * (1 - slack)))
        gates = [Gate("floor", F.col("isi"), F.col("_floor"), ">="), Gate("surroundings", F.when(F.col("_n") >= 6, F.col("isi")), F.col("_local") * g.pause_local, ">="), Gate("median", F.when(F.col("_n") >= 6, F.col("isi")), F.col("_median") * g.pause_global, ">=")]
        out.append(missed(x.withColumns({"start": F.col("idx"), "end": F.col("idx")}), gates, "pause", slack))
    return reduce(DataFrame.unionByName, out)
