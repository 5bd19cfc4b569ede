"""Gates on spans of intervals (train, label, start, end), the veto of negative labels, and the checks of events after selection."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pulsegrid.functions.stats import array_median, q

from .isi import by_train, in_train, valid_pairs
from .joins import range_join
from .statistics import span_metrics

BURSTS = ["burst", "long_burst", "possible_burst"]
# Labels by hand that mean something else than a pattern.
NEGATIVE = ["not_burst", "hard_negative_burst", "not burst", "not-burst"]
AMBIGUOUS = ["ambiguous", "manual_uncertain", "uncertain", "needs_review", "review", "unknown", "possible_uncertain", "boundary_uncertain"]
#: Least and greatest intervals (seconds) of a label; None: no limit.
Limits = dict[str, tuple[float | None, float | None]]


def _norm(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def clear_events(events: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(events to score, events left out because their label by hand is ambiguous)."""
    unclear = _norm(F.col(label)).isin(AMBIGUOUS)
    return events.where(~unclear), events.where(unclear)


def negative_overlap(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """spans plus negative_share: the share of a span's intervals that were labelled as no burst (columns negative, or manual in older files); any is a veto."""
    flags = [_norm(F.col(c)).isin(NEGATIVE) for c in ("negative", "manual") if c in rows.columns]
    at = rows.where(reduce(lambda a, b: a | b, flags, F.lit(False))).select("train", F.col("idx").alias("start"), F.col("idx").alias("end"))
    hit = range_join(spans.select("train", "start", "end").distinct(), at, ["train"]).groupBy("train", F.col("l_start").alias("start"), F.col("l_end").alias("end")).agg(F.count(F.lit(1)).alias("_n"))
    return spans.join(hit, ["train", "start", "end"], "left").withColumn("negative_share", F.coalesce(F.col("_n") / (F.col("end") - F.col("start") + 1), F.lit(0.0))).drop("_n")


def _limit(label: Column, limits: Limits, i: int) -> Column:
    """The limit of a label, a possible burst has that of a burst."""
    known = [(k, v[i]) for k, v in limits.items() if v[i] is not None and v[i] > 0]
    name = F.when(label == "possible_burst", "burst").otherwise(label)
    return F.element_at(F.create_map(*[F.lit(x) for kv in known for x in kv]), name) if known else F.lit(None).cast("double")


def gate_reason(label: Column, limits: Limits, least: Column, most: Column, q10: Column, q90: Column) -> Column:
    """Why a span's valid intervals (their ends and quantiles; null without any) fail the limits of its label, or how they pass."""
    lo, hi = _limit(label, limits, 0), _limit(label, limits, 1)
    burst, tonic, spiking = label.isin(BURSTS), label == "high_frequency_tonic", label == "high_frequency_spiking"
    low = F.coalesce(F.when(tonic, q10).otherwise(least) < lo, F.lit(False))
    high = F.coalesce(F.when(burst | tonic, q90).otherwise(most) > hi, F.lit(False))
    low_name = F.when(tonic, "hf_tonic_q10_below_pattern_Min_ISI").otherwise("below_pattern_Min_ISI")
    high_name = F.when(burst, "burst_family_q90_above_pattern_Max_ISI").when(tonic, "hf_tonic_q90_above_pattern_Max_ISI").when(spiking, "hf_spiking_above_pattern_Max_ISI").otherwise("above_pattern_Max_ISI")
    why = F.concat_ws(";", F.when(low, low_name), F.when(high, high_name))
    return F.when(lo.isNull() & hi.isNull(), "pattern_isi_gate_disabled").when(least.isNull(), "no_valid_isi_for_pattern_isi_gate").when(why == "", "pattern_isi_gate_pass").otherwise(why)


def passes(reason: Column) -> Column:
    return reason.isin("pattern_isi_gate_pass", "pattern_isi_gate_disabled")


def _inside(rows: DataFrame, spans: DataFrame, *columns: str) -> DataFrame:
    at = rows.select("train", F.col("idx").alias("start"), F.col("idx").alias("end"), *columns)
    return range_join(spans, at, ["train"])


def pattern_gate(rows: DataFrame, spans: DataFrame, limits: Limits) -> DataFrame:
    """spans plus reason and passed: do their valid intervals keep to the limits of their label? Bursts and high-frequency tonic states are judged by quantiles, others by every interval."""
    x = F.when(F.col("r_valid"), F.col("r_isi"))
    m = _inside(rows, spans, "isi", "valid").groupBy("train", F.col("l_label").alias("label"), F.col("l_start").alias("start"), F.col("l_end").alias("end"))
    m = m.agg(F.min(x).alias("least"), F.max(x).alias("most"), q(x, 0.1).alias("q10"), q(x, 0.9).alias("q90"))
    reason = gate_reason(F.col("label"), limits, F.col("least"), F.col("most"), F.col("q10"), F.col("q90"))
    return m.withColumn("reason", reason).select("train", "label", "start", "end", "reason", passes(F.col("reason")).alias("passed"))


def vetoes(rows: DataFrame, spans: DataFrame, seed: float, lv_core: float, tonic: tuple[float, float]) -> DataFrame:
    """spans plus anti_burst (two or more intervals of at most seed, or two in a row whose mean is that short) and anti_tonic (regular, with a mean in the tonic band)."""
    rows = rows.withColumn("_before", F.lag("isi").over(in_train()))
    both = (F.col("r_start") > F.col("l_start")) & F.col("r__before").isNotNull() & F.col("r_isi").isNotNull()
    a, b = F.col("r__before"), F.col("r_isi")
    m = _inside(rows, spans, "isi", "_before").groupBy("train", F.col("l_label").alias("label"), F.col("l_start").alias("start"), F.col("l_end").alias("end")).agg(
        F.count("r_isi").alias("_n"),
        F.count_if(b <= seed).alias("_short"),
        F.min(F.when(both, (a + b) / 2)).alias("_two"),
        F.avg(F.when(both & (a + b > 0), 3 * (a - b) * (a - b) / ((a + b) * (a + b)))).alias("lv"),
        F.avg("r_isi").alias("mean"),
    )
    no = lambda c: F.coalesce(c, F.lit(False))
    burst = (F.col("_short") >= 2) | no(F.col("_two") <= seed)
    calm = no((F.col("_n") >= 2) & (F.col("lv") <= lv_core) & F.col("mean").between(*tonic))
    return m.select("train", "label", "start", "end", "lv", "mean", burst.alias("anti_burst"), calm.alias("anti_tonic"))


@dataclass(frozen=True)
class BurstGate:
    """What a burst must show; None: not asked for."""

    edge: float = 3.0
    context: float = 2.5
    edge_return: float = 0.60
    tonic_edge: float = 3.5
    tonic_context: float = 3.0
    pause_context: float = 3.0
    ceiling: float | None = None
    fuzzy_percent: float = 0.0
    allow_fuzzy: bool = False
    max_bridge: float | None = None
    q95_to_q50: float = 3.5
    max_to_q50: float = 5.0
    cv: float = 1.5
    lv: float = 2.0
    one_flank: float = 2.5
    boundary: bool = True
    negatives: bool = True


def phenotype(rows: DataFrame) -> DataFrame:
    """(train, prior): what kind of firing a train mostly shows, which makes the burst gate stricter."""
    rows = rows.withColumn("valid", F.col("isi").isNotNull() & ~F.col("artifact"))
    x = valid_pairs(rows).withColumn("_median", q("isi", 0.5).over(by_train()))
    x = x.groupBy("train").agg(
        F.count("isi").alias("n"), q("isi", 0.1).alias("q10"), q("isi", 0.9).alias("q90"), F.avg("lv").alias("lv"), F.avg((F.col("isi") <= 0.020).cast("int")).alias("fast"),
        F.avg((F.col("isi") >= F.greatest(F.lit(0.100), 2.5 * F.col("_median"))).cast("int")).alias("slow"),
    )
    prior = (
        F.when(F.col("n") < 30, "low_spike_count_unreliable")
        .when(F.col("slow") >= 0.12, "pause_dominant")
        .when((F.col("fast") >= 0.60) & (F.col("lv") <= 0.35), "hf_tonic_dominant")
        .when((F.col("lv") <= 0.35) & (F.col("q90") / F.col("q10") <= 2.5), "tonic_dominant")
        .when(F.col("fast") >= 0.15, "burst_capable")
        .otherwise("mixed")
    )
    return rows.select("train").distinct().join(x.select("train", prior.alias("prior")), "train", "left").fillna("low_spike_count_unreliable", ["prior"])


def context_medians(rows: DataFrame, k: int = 5) -> DataFrame:
    """(train, idx, before, after): medians of the k nearest valid intervals before and after each row, without its own."""
    near = rows.where("valid").select("train", "idx", *[F.collect_list("isi").over(in_train().rowsBetween(a, b)).alias(n) for n, a, b in (("_b", 1 - k, 0), ("_a", 0, k - 1))])
    x = rows.select("train", "idx").join(near, ["train", "idx"], "left")
    up, down = in_train().rowsBetween(Window.unboundedPreceding, -1), by_train().orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({"_b": F.last("_b", True).over(up), "_a": F.last("_a", True).over(down)})
    return x.select("train", "idx", array_median(F.col("_b")).alias("before"), array_median(F.col("_a")).alias("after"))


def canonical_bursts(rows: DataFrame, spans: DataFrame, g: BurstGate | None = None, ranges: DataFrame | None = None, min_isi: float = 0.0009) -> DataFrame:
    """Judges burst candidates (train, label, start, end) by their flanks, their surroundings, a ceiling and their coherence: final label, decision and what it was made of.

    ranges (train, high): learned ceilings, the lower one counts. A candidate that only misses a flank at a train's end is a possible burst, and so is one within the fuzzy zone over the ceiling."""
    g = g or BurstGate()
    m = span_metrics(rows, spans.select("train", "start", "end").distinct(), 0.0, 0.0).join(spans, ["train", "start", "end"])
    c = context_medians(rows)
    m = m.join(c.select("train", F.col("idx").alias("start"), "before"), ["train", "start"]).join(c.select("train", F.col("idx").alias("end"), "after"), ["train", "end"])
    m = m.join(phenotype(rows), "train")
    m = negative_overlap(rows, m) if g.negatives else m.withColumn("negative_share", F.lit(0.0))
    low = F.lit(g.ceiling).cast("double")
    if ranges is not None:
        m = m.join(ranges.select("train", F.col("high").alias("_learned")), "train", "left")
        low = F.least(low, F.when(F.col("_learned") > 0, F.col("_learned")))
    yes = lambda x: F.coalesce(x, F.lit(False))
    q90, ceiling = F.col("q90"), F.col("ceiling")
    m = m.withColumns({"ceiling": low, "pre": F.when(F.col("pre") >= min_isi, F.col("pre")), "post": F.when(F.col("post") >= min_isi, F.col("post"))})
    m = m.withColumns({"_edge": F.least("pre", "post"), "_context": (F.coalesce("before", "after") + F.coalesce("after", "before")) / 2})
    m = m.withColumns({"edge_ratio": F.col("_edge") / q90, "context_ratio": F.col("_context") / q90, "edge_return": F.col("_edge") / F.col("_context")})
    calm, paused = F.col("prior").isin("tonic_dominant", "hf_tonic_dominant"), F.col("prior") == "pause_dominant"
    strict, fuzzy = ceiling.isNull() | (q90 <= ceiling), (q90 > ceiling) & (q90 <= ceiling * (1 + g.fuzzy_percent / 100))
    m = m.withColumn("zone", F.when(ceiling.isNull(), "disabled").when(strict, "strict").when(fuzzy, "fuzzy").otherwise("fail"))
    zone = F.col("zone")
    edge = F.greatest(F.when(calm, max(g.edge, g.tonic_edge)).otherwise(g.edge), F.when(zone == "fuzzy", 3.5 if g.fuzzy_percent <= 5 else 4.0).otherwise(0.0))
    context = F.when(calm, max(g.context, g.tonic_context)).when(paused, max(g.context, g.pause_context)).otherwise(g.context)
    m = m.withColumns({"_e": edge, "_veto": F.col("negative_share") > 0, "_bridge": F.lit(True) if g.max_bridge is None else F.col("max_isi") <= g.max_bridge})
    kept = lambda x, most: F.coalesce(x <= most, F.lit(True))
    inner = kept(F.col("q95") / F.col("q50"), g.q95_to_q50) & kept(F.col("max_isi") / F.col("q50"), g.max_to_q50) & kept(F.col("cv"), g.cv) & kept(F.col("lv"), g.lv)
    m = m.withColumns({"edge_pass": yes(F.col("edge_ratio") >= F.col("_e")), "context_pass": yes(F.col("context_ratio") >= context), "return_pass": F.coalesce(F.col("edge_return") >= g.edge_return, F.lit(True)), "coherent": inner})
    two = F.col("pre").isNotNull() & F.col("post").isNotNull()
    sound = (zone != "fail") & F.col("_bridge") & F.col("context_pass") & F.col("coherent") & ~F.col("_veto")
    whole = two & sound & F.col("edge_pass") & F.col("return_pass")
    one = ~two & sound & yes(F.col("edge_ratio") >= F.greatest(F.col("_e"), F.lit(g.one_flank))) & F.lit(g.boundary)
    doubtful = (zone == "fuzzy") & F.lit(not g.allow_fuzzy)
    possible = F.col("label") == "possible_burst"
    weak = F.concat_ws(";", F.when(~F.col("edge_pass"), "edge_ratio_fail"), F.when(~F.col("context_pass"), "context_compression_fail"))
    uneven = F.concat_ws(";", F.when(~F.col("coherent"), "internal_coherence_fail"), F.when(~F.col("_bridge"), "max_bridge_fail"))
    decision = (
        F.when(whole & doubtful, "fuzzy_abs_ceiling_pass_requires_review")
        .when(whole & possible, "possible_burst_candidate_passed_arbitration_gates")
        .when(whole, "canonical_burst_gate_pass")
        .when(one, "one_sided_boundary_burst_review")
        .when(zone == "fail", "reject_abs_ceiling_fail")
        .when(F.col("_veto"), "manual_negative_veto")
        .when(weak != "", weak)
        .when(uneven != "", uneven)
        .otherwise("arbitration_reject")
    )
    final = F.when(whole & ~doubtful & ~possible, F.when(F.col("label") == "long_burst", "long_burst").otherwise("burst")).when(whole | one, "possible_burst").otherwise("reject")
    return m.select("train", "start", "end", "label", final.alias("final_label"), decision.alias("decision"), "zone", "prior", "edge_ratio", "context_ratio", "edge_return", "edge_pass", "context_pass", "return_pass", "coherent", "negative_share")


#: Fewest spikes that an event of a label has.
LEAST_SPIKES = {"burst": 3, "long_burst": 11, "possible_burst": 3, "tonic": 5, "high_frequency_tonic": 6, "high_frequency_spiking": 30, "pause": 2}


def validated(rows: DataFrame, least_spikes: dict[str, int] | None = None, least_seconds: dict[str, float] | None = None, limits: Limits | None = None) -> DataFrame:
    """rows (with auto, and manual if labels by hand are to be left alone) plus removed: what selection left of events must still be events.

    Intervals of a high-frequency spiking state outside its limits are cut out first (removed: trimmed). Then runs of a label that have too few spikes or valid intervals, are too short, or
    fail the limits of their label lose it (removed: fragment or gate)."""
    limits, seconds = limits or {}, least_seconds or {}
    locked = F.coalesce("manual", F.lit("")) != "" if "manual" in rows.columns else F.lit(False)
    real = F.col("isi").isNotNull() & ~F.col("artifact")
    spiking = F.lit("high_frequency_spiking")
    out_of = (F.col("isi") < _limit(spiking, limits, 0)) | (F.col("isi") > _limit(spiking, limits, 1))
    trim = (F.col("auto") == spiking) & ~locked & real & F.coalesce(out_of, F.lit(False))
    x = rows.withColumns({"auto": F.when(F.col("idx") == 1, "").otherwise(F.coalesce("auto", F.lit(""))), "_trim": trim})
    x = x.withColumn("auto", F.when(F.col("_trim"), "").otherwise(F.col("auto")))
    change = F.coalesce((F.col("auto") != F.lag("auto").over(in_train())).cast("int"), F.lit(1))
    x = x.withColumns({"_run": F.sum(change).over(in_train()), "_from": F.coalesce(F.lag("t").over(in_train()), "t")})
    run = Window.partitionBy("train", "_run")
    known = lambda d, default: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in d.items() for v in kv]), F.col("auto")), F.lit(default)) if d else F.lit(default)
    least = known(least_spikes or LEAST_SPIKES, 1)
    x = x.withColumns({"_n": F.count(F.lit(1)).over(run), "_real": F.count_if(real).over(run), "_long": F.max("t").over(run) - F.min("_from").over(run)})
    fine = (F.col("_n") + 1 >= least) & (F.col("_real") >= least - 1) & (F.col("_long") >= known(seconds, 0.0))
    gate = F.lit(True)
    if any(v is not None and v > 0 for pair in limits.values() for v in pair):
        value = F.when(F.col("valid"), F.col("isi"))
        x = x.withColumns({"_a": F.min(value).over(run), "_b": F.max(value).over(run), "_q10": q(value, 0.1).over(run), "_q90": q(value, 0.9).over(run)})
        gate = passes(gate_reason(F.col("auto"), limits, F.col("_a"), F.col("_b"), F.col("_q10"), F.col("_q90")))
    bad = (F.col("auto") != "") & ~locked
    removed = F.when(F.col("_trim"), "trimmed").when(bad & ~gate, "gate").when(bad & ~fine, "fragment")
    return x.withColumn("removed", removed).withColumn("auto", F.when(F.col("removed").isNotNull(), "").otherwise(F.col("auto"))).drop(*[c for c in x.columns if c.startswith("_")])


def result_layers(events: DataFrame) -> dict[str, DataFrame]:
    """Views of an event table: what is certain, what is to be reviewed, the burst family, and all events with their family."""
    family = F.when(F.col("label").isin(BURSTS), "burst_family").otherwise(F.col("label"))
    return {
        "high_confidence": events.where("label <> 'possible_burst'"),
        "review_candidates": events.where("label = 'possible_burst'").withColumn("review_family", F.lit("burst_review_candidate")),
        "burst_family": events.where(F.col("label").isin(BURSTS)).withColumn("pattern_family", F.lit("burst_family")),
        "all_event_family_map": events.withColumn("pattern_family", family),
    }


def event_ledger(events: DataFrame, run_id: str, settings_hash: str) -> DataFrame:
    """Final events with an id each (in the order of train and start), the run and the settings that they come from, and their layer and family."""
    order = Window.partitionBy("train").orderBy("start")
    layer = F.when(F.col("label") == "possible_burst", "review_candidate").when(F.col("label").isin("burst", "long_burst"), "high_confidence_burst_family_member").otherwise("high_confidence_nonburst_or_other")
    named = F.concat_ws(":", F.lit(run_id), F.lit("event"), F.col("train").cast("string"), F.row_number().over(order).cast("string"))
    family = F.when(F.col("label").isin(BURSTS), "burst_family").otherwise(F.col("label"))
    return events.withColumns({"event_id": named, "run_id": F.lit(run_id), "params_hash": F.lit(settings_hash), "event_layer": layer, "pattern_family": family})
