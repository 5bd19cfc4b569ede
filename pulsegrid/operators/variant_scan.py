"""Detection under a few settings for all trains, as one scan: what detectors.detect() finds, without a row for each (variant, interval).

Rows are shuffled and sorted by train once. A task holds whole trains of a batch as numbers and goes over them with every variant; only events, or their counts against labels by hand, leave it. Detectors that don't
read what a variant changes are run once for the variants that agree.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pulsegrid.functions.grammar import Grammar
from pulsegrid.functions.stats import between

from .detectors import STATE_GAP
from .gates import LEAST_SPIKES
from .medians import around, whole_trains
from .statistics import PAIRS, QUANTILES, SHIFT

#: Labels by their place (0: none), and layers in the order that decides between candidates of one span.
LABELS = ("", "burst", "long_burst", "possible_burst", "tonic", "high_frequency_tonic", "high_frequency_spiking", "pause")
NONE, BURST, LONG, POSSIBLE, TONIC, FAST, SPIKING, PAUSE = range(len(LABELS))
LAYERS = ("burst", "episode", "hf_spiking", "hf_tonic", "pause", "tonic", "tonic_core")
#: What a candidate is known by after its detector.
FIELDS = ("start", "end", "label", "score", "priority", "n", "duration")
STATE = ("q90", "cv", "lv", "mm", "pre", "post", "short", "bridged", "large")

Table = dict[str, np.ndarray]


def _some(t: Table, keep: np.ndarray) -> Table:
    return {k: v[keep] for k, v in t.items()}


def _most(v: np.ndarray, limit: float | np.ndarray) -> np.ndarray:
    """v <= limit; what isn't known passes."""
    return ~(v > limit)


class Trains:
    """Whole trains of a batch: intervals (NaN: none) in order, and what all variants share. Places are those of the batch."""

    def __init__(self, code: np.ndarray, isi: np.ndarray, artifact: np.ndarray, t: np.ndarray):
        self.code, self.isi, self.artifact, self.t = code, isi, artifact, t
        n = len(isi)
        self.place = np.arange(n)
        self.new = np.r_[True, code[1:] != code[:-1]]
        self.last = np.r_[self.new[1:], True]
        self.real = ~np.isnan(isi)
        self.valid = self.real & ~artifact
        self.seen = np.cumsum(self.valid)
        self.x = isi[self.valid]
        order = self.x.argsort(kind="stable")
        self.in_order, self.rank = self.x[order], np.empty(len(self.x), np.int64)
        self.rank[order] = np.arange(len(self.x))
        first = np.flatnonzero(self.new)
        self.n = np.add.reduceat(self.valid.astype(np.int64), first)
        self.q10, self.q50, self.q75, self.q90 = self._quantiles()
        self.memo: dict[tuple, object] = {}

    def _quantiles(self) -> list[np.ndarray]:
        """Of each train's valid intervals; NaN without any."""
        ranks = (self.code[self.valid] << SHIFT) | self.rank
        ranks.sort()
        v = np.r_[self.in_order[ranks & ((1 << SHIFT) - 1)], np.nan]
        at = np.r_[0, np.cumsum(self.n)[:-1]]
        out = []
        for p in (0.1, 0.5, 0.75, 0.9):
            h = np.maximum(self.n - 1, 0) * p
            lo, hi = (np.where(self.n > 0, v[np.minimum(at + f(h).astype(np.int64), len(v) - 1)], np.nan) for f in (np.floor, np.ceil))
            out.append(np.where(lo == hi, lo, between(lo, hi, h - np.floor(h))))
        return out

    def runs(self, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of maximal runs with the flag."""
        return np.flatnonzero(flag & (self.new | ~np.r_[False, flag[:-1]])), np.flatnonzero(flag & (self.last | ~np.r_[flag[1:], False]))

    def before(self, flag: np.ndarray) -> np.ndarray:
        """The last place with the flag at or before each of its train; -1 if none."""
        found = np.maximum.accumulate(np.where(flag, self.place, -1))
        return np.where(found >= self.place[self.new][self.code], found, -1)

    def after(self, flag: np.ndarray) -> np.ndarray:
        """The first place with the flag at or after each of its train; the greatest number if none."""
        none = np.iinfo(np.int64).max
        found = np.minimum.accumulate(np.where(flag, self.place, none)[::-1])[::-1]
        return np.where(found <= self.place[self.last][self.code], found, none)

    def streak(self, flag: np.ndarray) -> np.ndarray:
        """How many places in a row, up to each of its train, have the flag."""
        stop = np.where(~flag, self.place, np.where(self.new, self.place - 1, -1))
        return self.place - np.maximum.accumulate(stop)

    def streak_ahead(self, flag: np.ndarray) -> np.ndarray:
        stop = np.where(~flag, self.place, np.where(self.last, self.place + 1, len(flag)))
        return np.minimum.accumulate(stop[::-1])[::-1] - self.place

    def measured(self, start: np.ndarray, end: np.ndarray, low: float, bridge: float, quantiles: tuple[float, ...] = QUANTILES, count: dict[str, np.ndarray] | None = None, most: dict[str, np.ndarray] | None = None) -> Table:
        """Measures of spans that hold valid intervals, as statistics.span_metrics() finds them. count and most: columns of all places by name."""
        a, b = self.seen[start] - self.valid[start], self.seen[end]
        held = b > a
        start, end, a, b = start[held], end[held], a[held], b[held]
        inner = {k: c[self.valid] for k, c in ((count or {}) | (most or {})).items()}
        beside = np.r_[self.isi, np.nan]
        pre, post = np.where(self.new[start], np.nan, beside[start - 1]), np.where(self.last[end], np.nan, beside[end + 1])
        parts, at = [], 0
        while at < len(start):
            total = np.cumsum((b - a)[at:])
            to = at + max(1, int(total.searchsorted(PAIRS, side="right")))
            parts.append(self._part(a[at:to], b[at:to], low, bridge, quantiles, {k: inner[k] for k in count or {}}, {k: inner[k] for k in most or {}}))
            at = to
        if not parts:
            none = np.zeros(0)
            names = ("mean", "max", "duration", "cv", "mm", "lv", *(f"q{round(p * 100)}" for p in quantiles), *(most or {}))
            return {"start": start, "end": end, "pre": none, "post": none, **{k: start for k in ("n", "core", "bridges", *(count or {}))}, **dict.fromkeys(names, none)}
        return {"start": start, "end": end, "pre": pre, "post": post, **{k: np.concatenate([p[k] for p in parts]) for k in parts[0]}}

    def _part(self, a: np.ndarray, b: np.ndarray, low: float, bridge: float, quantiles: tuple[float, ...], count: Table, most: Table) -> Table:
        n = b - a
        first = np.r_[0, np.cumsum(n)[:-1]]
        which = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(which)) + np.repeat(a - first, n)
        v = self.x[place]
        add = lambda c: np.add.reduceat(c, first)
        total, longest = add(v), np.maximum.reduceat(v, first)
        mean = total / n
        with np.errstate(all="ignore"):
            cv = np.where(n > 1, np.sqrt(add((v - mean[which]) ** 2) / (n - 1)) / mean, np.nan)
            pair = np.r_[np.nan, 3 * (v[:-1] - v[1:]) ** 2 / (v[:-1] + v[1:]) ** 2]
            pair[first] = np.nan  # the first of a span has none before it
            known = ~np.isnan(pair)
            pairs = add(known.astype(np.int64))
            lv = np.where(pairs > 0, add(np.where(known, pair, 0.0)) / np.maximum(pairs, 1), np.nan)
        ranks = (which << SHIFT) | self.rank[place]
        ranks.sort()
        v_in_order = self.in_order[ranks & ((1 << SHIFT) - 1)]
        out = {"n": n, "mean": mean, "max": longest, "duration": total, "cv": cv, "mm": longest / mean, "lv": lv, "core": add((v <= low).astype(np.int64)), "bridges": add(((v > low) & (v <= bridge)).astype(np.int64))}
        for p in quantiles:
            h = (n - 1) * p
            i, j = np.floor(h).astype(np.int64), np.ceil(h).astype(np.int64)
            lo, hi = v_in_order[first + i], v_in_order[first + j]
            out[f"q{round(p * 100)}"] = np.where((i == j) | (lo == hi), lo, between(lo, hi, h - i))
        out |= {k: add(c[place].astype(np.int64)) for k, c in count.items()}
        return out | {k: np.maximum.reduceat(c[place], first) for k, c in most.items()}

    def once(self, g: Grammar, what: Callable[[Trains, Grammar], object], *reads: str):
        """what(self, g), found once for all grammars that agree in the settings that begin with any of reads."""
        key = (what.__name__, *(v for k, v in dataclasses.asdict(g).items() if k.startswith(reads)))
        if key not in self.memo:
            self.memo[key] = what(self, g)
        return self.memo[key]


def _possible(contrast: np.ndarray, core: np.ndarray, bridge_share: np.ndarray, purity: np.ndarray, g: Grammar, two: bool = False, one: bool = False, excess: np.ndarray | None = None) -> np.ndarray:
    p = 260 + 180 * np.minimum(1.5, np.nan_to_num(contrast) / g.contrast) + 120 * np.minimum(1.0, purity) + 20 * np.minimum(5, core) + (80 if two else 0) + (50 if one else 0)
    if excess is not None:
        p = p - np.where(excess > 1, 60 * np.minimum(2.0, excess - 1), 0)
    return np.minimum(np.maximum(p - 120 * np.maximum(0.0, bridge_share - 0.35), 180.0), 760.0)


def _made(m: Table, **fields: np.ndarray | float | int) -> Table:
    m = m | {k: np.broadcast_to(v, len(m["start"])) for k, v in fields.items()}
    return {k: m[k] for k in (*FIELDS, *(STATE if "short" in m else ()))}


def _bursts(x: Trains, g: Grammar) -> list[Table]:
    ok = x.valid & (x.isi <= g.bridge)
    a, b = x.runs(x.valid & (x.isi >= g.seed_low) & (x.isi <= g.seed_high))
    long = b - a + 1 >= g.min_seeds
    a, b = a[long], b[long]
    reach = int(g.max_extension)
    left = np.where(x.new[a], 0, np.minimum(x.streak(ok)[a - 1], reach))
    right = np.where(x.last[b], 0, np.minimum(x.streak_ahead(ok)[np.minimum(b + 1, len(ok) - 1)], reach))
    ways = (left + 1) * (right + 1)
    run = np.repeat(np.arange(len(a)), ways)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(ways) - ways, ways)
    start, end = a[run] - nth // (right + 1)[run], b[run] + nth % (right + 1)[run]
    once = np.unique(start * len(x.isi) + end, return_index=True)[1]  # the first run that gives a span counts
    start, end, seed = start[once], end[once], a[run][once]
    big = end - start + 2 >= g.min_spikes
    start, end, seed = start[big], end[big], seed[big]
    if g.max_candidates is not None and len(start):
        order = np.lexsort((end, -start, seed))
        train = x.code[start[order]]
        place = np.arange(len(order)) - np.searchsorted(train, train)
        order = order[place < g.max_candidates]
        start, end = start[order], end[order]
    m = x.measured(start, end, g.seed_high, g.bridge)
    n, core, q90 = m["n"], m["core"], m["q90"]
    left, right = m["pre"] / q90, m["post"] / q90
    excess, purity, share, spikes = m["q95"] / g.bridge, core / n, m["bridges"] / n, m["end"] - m["start"] + 2
    contrast = np.fmin(left, right)
    passed = (m["bridges"] <= g.max_bridges) & (share <= g.max_bridge_share) & (q90 <= g.bridge) & ((excess <= 1) | ((not g.strict_q95) & (excess <= g.q95_limit)))
    two, maybe = (left >= g.contrast) & (right >= g.contrast), (left >= g.possible_contrast) & (right >= g.possible_contrast)
    one = (left >= g.contrast + g.one_sided_extra) | (right >= g.contrast + g.one_sided_extra)
    clean = one & (purity >= g.one_sided_purity) & (share <= min(g.one_sided_bridge_share, g.max_bridge_share))
    scale = np.fmax(np.fmax(x.q75[x.code[m["start"]]], m["pre"]), m["post"]) / q90
    rescue = passed & (purity >= g.rescue_purity) & _most(m["cv"], g.rescue_cv) & (scale >= g.rescue_ratio)
    strong = rescue & (scale >= g.strong_rescue_ratio)
    size = np.where(spikes <= g.classic_spikes, BURST, np.where((spikes >= g.long_spikes[0]) & (spikes <= g.long_spikes[1]), LONG, NONE))
    sized = size != NONE
    priority = lambda **k: _possible(contrast, core, share, purity, g, excess=excess, **k)
    gates = [passed & two & sized, passed & two, passed & clean, passed & maybe, strong & sized, rescue]
    label = np.select(gates, [size, POSSIBLE, POSSIBLE, POSSIBLE, size, POSSIBLE], NONE)
    rank = np.select(gates, [np.where(size == BURST, 1250.0, 1160.0), priority(two=True), priority(one=True), priority(two=True), np.where(size == BURST, 1010.0, 960.0), priority()], 0.0)
    score = np.nan_to_num(contrast) + 0.16 * core + 0.35 * purity - 0.20 * m["bridges"] - 0.45 * share - np.where(excess > 1, 0.45 * np.minimum(2.0, excess - 1), 0.0)
    return [_some(_made(m, label=label, score=score, priority=rank), label != NONE), _episodes(x, g, start, end)]


def _episodes(x: Trains, g: Grammar, taken_start: np.ndarray, taken_end: np.ndarray) -> Table:
    tops = np.fmax(g.bridge, np.fmin(g.bridge * g.episode_bridge_factor, x.q75 * g.episode_background))
    a, b = x.runs(x.valid & (x.isi <= tops[x.code]))
    long = b - a + 1 >= g.episode_min_isi
    a, b = a[long], b[long]
    if len(a):
        n = b - a + 1
        first = np.cumsum(n) - n
        which = np.repeat(np.arange(len(a)), n)
        place = np.arange(len(which)) + np.repeat(a - first, n)
        v = x.isi[place]
        by = v[np.lexsort((v, which))]
        h = (n - 1) * 0.9
        i, j = np.floor(h), np.ceil(h)
        lo, hi = by[first + i.astype(np.int64)], by[first + j.astype(np.int64)]
        e90 = np.where(lo == hi, lo, (j - h) * lo + (h - i) * hi)  # as Spark's percentile() adds them
        top = tops[x.code[a]]
        inside = v <= np.minimum(np.maximum(g.bridge, 1.1 * e90), top)[which]
        a = np.minimum.reduceat(np.where(inside, place, np.iinfo(np.int64).max), first)
        b = np.maximum.reduceat(np.where(inside, place, -1), first)
        keep = (b - a + 1 >= g.episode_min_isi) & ~np.isin(a * len(x.isi) + b, taken_start * len(x.isi) + taken_end)
        a, b = a[keep], b[keep]
    m = x.measured(a, b, g.seed_high, g.bridge, count={"suspects": (x.isi >= g.seed_low) & (x.isi <= g.seed_high)})
    n, core = m["n"], m["core"]
    q75, top = (v[x.code[m["start"]]] for v in (x.q75, tops))
    seeds, share, compression, spikes = m["suspects"] / n, (core + m["bridges"]) / n, q75 / m["q90"], m["end"] - m["start"] + 2
    entry = ((m["suspects"] >= 1) & (seeds >= g.episode_seed_share)) | (compression >= g.rescue_ratio)
    keep = entry & (n >= g.episode_min_isi) & (m["q90"] <= top) & _most(m["cv"], g.episode_cv) & (compression >= g.rescue_ratio) & (spikes >= g.min_spikes)
    label = np.where(spikes <= max(g.classic_spikes, g.episode_spikes), BURST, np.where((spikes >= g.long_spikes[0]) & (spikes <= g.long_spikes[1]), LONG, POSSIBLE))
    score = 4 + 0.12 * n + 0.6 * seeds + 0.5 * share + np.minimum(4.0, 0.2 * compression)
    possible = _possible(np.fmin(m["pre"] / m["q90"], m["post"] / m["q90"]), core, 1 - core / n, core / n, g)
    return _some(_made(m, label=label, score=score, priority=np.where(label == BURST, 1035.0, np.where(label == LONG, 985.0, possible))), keep)


def _spiking(x: Trains, g: Grammar) -> Table:
    none = lambda *v: min(c for c in v if c is not None)  # noqa: E731  null: no limit
    tolerated, hard, most, least = none(g.hfs_tolerated, g.hfs_max), none(g.hfs_break, g.pause_min, g.hfs_max), max(1, g.hfs_gap), max(3, g.hfs_spikes)
    support = x.valid & (x.isi <= g.hfs_bridge) & (x.isi < g.pause_min) & (x.isi <= g.hfs_max if g.hfs_max is not None else True)
    clear = ~support & x.artifact
    block = ~support & ~clear & ~(x.valid & (x.isi <= tolerated) & (x.isi < hard))
    back, ahead = x.before(support), x.after(support)
    known = (back >= 0) & (ahead < np.iinfo(np.int64).max)
    gap = known & ~support & (np.where(known, ahead - back - 1, 0) <= most) & (x.before(block) < back) & (x.after(block) > ahead)
    doubt = gap & ((x.before(clear) > back) | (x.after(clear) < ahead))
    a, b = x.runs(support | (gap & ~doubt))
    linked, keep = np.flatnonzero(np.isin(a, ahead[doubt])), np.ones(len(a), bool)
    start, end = a.tolist(), b.tolist()
    for i in linked.tolist():  # across an artifact a state goes on only while it's too short by itself
        if end[i - 1] - start[i - 1] + 1 <= least - 1:
            start[i] = start[i - 1]
            keep[i - 1] = False
    a, b = np.array(start, np.int64)[keep], np.array(end, np.int64)[keep]
    long = b - a + 2 >= least
    above = x.valid & (x.isi > g.hfs_bridge)
    calm = x.valid & ~above
    low = x.before(calm)
    row = np.where(above, x.seen - np.where(low >= 0, x.seen[low], (x.seen - x.valid)[x.place[x.new][x.code]]), 0)
    m = x.measured(a[long], b[long], g.hfs_short, g.hfs_bridge, (0.8, 0.9), {"suspects": x.isi <= g.hfs_q90, "over": x.isi > g.hfs_tolerated}, {"longest": row})
    n = m["n"]
    short, mid, bridged = m["core"] / n, m["suspects"] / n, (m["core"] + m["bridges"]) / n
    large = 1 - bridged
    strict = m["q90"] <= g.hfs_q90
    compact = strict | ((m["q80"] <= g.hfs_q80) & ((short >= 0.55) | (mid >= 0.6) | (bridged >= 0.75)))
    keep = compact & (1 - m["over"] / n >= 0.95) & (large <= g.hfs_large_share) & (m["longest"] <= max(2, g.hfs_gap))
    score = 24 + 0.08 * (m["end"] - m["start"] + 2) + 2.5 * short + 2.0 * mid + 1.5 * bridged - 2.0 * large + np.where(strict, 1.0, 0.4)
    return _some(_made(m | {"short": short, "bridged": bridged, "large": large}, label=SPIKING, score=score, priority=1040.0), keep)


def _fast_tonic(x: Trains, g: Grammar) -> Table:
    member = x.valid & (x.isi <= g.hft_max)
    a, b = x.runs(member)
    long = b - a + 2 >= g.hft_spikes
    seeds = x.streak(member & (x.isi >= g.seed_low) & (x.isi <= g.seed_high))
    m = x.measured(a[long], b[long], g.seed_high, g.hft_max, count={"suspects": x.isi < g.hft_floor}, most={"longest": seeds})
    low = m["suspects"] / m["n"]
    keep = (m["q90"] <= g.hft_max) & ((m["q10"] >= g.hft_floor) | (low <= g.hft_low_share)) & (m["longest"] <= g.min_seeds - 1) & _most(m["cv"], g.hft_cv) & _most(m["lv"], g.hft_lv) & (m["mm"] <= g.hft_mm)
    return _some(_made(m, label=FAST, score=5 + (1 - low) + np.nan_to_num(1 / (1 + m["cv"])), priority=500.0), keep)


def _references(x: Trains, g: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bounds of tonic firing and the floor of pauses of each train."""
    few = x.n < 6
    base = np.fmax(g.pause_min, x.q90)
    lower = np.where(few, g.tonic_min, np.fmax(g.min_isi, np.fmax(np.fmin(g.tonic_min, x.q10), max(g.seed_high, g.bridge) * g.tonic_guard)))
    high = np.fmax(np.fmax(np.fmax(g.tonic_max, x.q75 * 1.25), np.where(x.q90 <= 1.5 * x.q75, x.q90 * 1.02, np.nan)), lower * 1.5)
    capped = np.where((base > 1.15 * x.q90) & (base > lower), np.fmin(high, base * 0.98), high)
    upper = np.where(few, g.tonic_max, np.where(capped <= lower, np.fmax(np.fmax(g.tonic_max, x.q75), lower + g.min_isi), capped))
    return lower, upper, np.where(x.n >= 10, np.fmax(base, upper * 1.15), base)


def _tonic(x: Trains, g: Grammar) -> list[Table]:
    lower, upper, _ = _references(x, g)
    core = np.fmax(lower, np.where(x.n >= 6, x.q75 * 0.65, np.nan))
    core = np.where(core > upper, lower, core)[x.code]
    band = x.valid & (x.isi >= lower[x.code]) & (x.isi <= upper[x.code])
    full, inner = x.runs(band), x.runs(band & (x.isi >= core))
    n = len(x.isi)
    new = ~np.isin(inner[0] * n + inner[1], full[0] * n + full[1])
    top = max(g.seed_high, g.bridge)
    seeds = (x.isi >= g.seed_low) & (x.isi <= g.seed_high)
    out = []
    for (a, b), priority in ((full, 350.0), ((inner[0][new], inner[1][new]), 340.0)):
        long = b - a + 2 >= g.tonic_spikes
        m = x.measured(a[long], b[long], top, top, (0.1, 0.5, 0.9), count={"suspects": seeds})
        lv, low, high = m["lv"], *g.tonic_mm
        most = np.where((lv <= min(g.tonic_lv, 0.15)) & (m["cv"] <= 0.3), max(g.tonic_calm_mm, high), high)
        keep = (m["mean"] > top * g.tonic_guard) & (m["q50"] > top * g.tonic_guard) & (m["q10"] > top) & (m["core"] / m["n"] <= g.tonic_low_share) & _most(lv, g.tonic_lv) & (m["mm"] <= most) & (m["mm"] >= low) & (m["suspects"] / m["n"] <= 0.2)
        out.append(_some(_made(m, label=TONIC, score=3 + np.nan_to_num(1 / (1 + lv)), priority=priority), keep))
    return out


def _pauses(x: Trains, g: Grammar) -> Table:
    floor = _references(x, g)[2]
    long = x.valid & (x.isi >= floor[x.code])
    at = np.flatnonzero(long)
    calm, other = np.where(x.valid & ~long, x.isi, np.nan), np.where(x.valid, x.isi, np.nan)
    local = around(calm, x.code, at, 11) if len(at) else np.zeros(0)
    alone = np.isnan(local)
    if alone.any():
        local[alone] = around(other, x.code, at[alone], 11)
    v, code = x.isi[at], x.code[at]
    stands = np.zeros(len(x.isi), bool)
    stands[at] = (x.n[code] < 6) | (~(v < local * g.pause_local) & (v >= x.q50[code] * g.pause_global))
    a, b = x.runs(stands)
    n = b - a + 1
    score = np.maximum.reduceat(x.isi[stands], np.cumsum(n) - n) / floor[x.code[a]] if len(a) else np.zeros(0)
    return _made({"start": a, "end": b, "n": n, "duration": np.zeros(len(a))}, label=PAUSE, score=score, priority=300.0)


def _pairs(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all j from first[i] to before last[i]."""
    n = np.maximum(last - first, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]


def _standing(x: Trains, s: Table, bursts: Table) -> np.ndarray:
    """Which spiking states stand: detectors.state_verdicts()."""
    n = s["end"] - s["start"] + 1
    order = np.lexsort((bursts["end"], bursts["start"]))
    begin, stop = bursts["start"][order], bursts["end"][order]
    i, j = _pairs(begin.searchsorted(s["start"]), begin.searchsorted(s["end"], side="right"))
    inside = stop[j] <= s["end"][i]
    i, j = i[inside], j[inside]
    # the greatest end so far within a state: states are apart, so ends of earlier ones are lower
    so_far = np.maximum.accumulate(stop[j]) if len(j) else j
    fresh = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
    before = np.r_[0, so_far[:-1]] if len(j) else j
    edge = begin[j] - 1
    covered = np.maximum(0, stop[j] - np.where(fresh, edge, np.maximum(before, edge)))
    apart = fresh | (begin[j] > before)
    groups, cover = (np.bincount(i, v, len(n)) for v in (apart, covered))
    coverage = cover / n
    varies = (s["cv"] >= 0.65) | (s["lv"] >= 0.45) | (s["mm"] >= 3.0)
    dominated = (groups >= np.maximum(6, np.ceil(0.055 * n))) & (coverage >= 0.25)
    packet = (varies | (s["large"] >= 0.08)) & (((groups >= 2) & (coverage >= 0.08)) | ((groups >= 1) & (coverage >= 0.18)))
    stands = ~dominated & ~packet
    p = np.flatnonzero(packet)
    rest = np.flatnonzero(stands & varies)
    wide = STATE_GAP + 1
    i, j = _pairs(s["end"][p].searchsorted(s["start"][rest] - wide), s["start"][p].searchsorted(s["end"][rest] + wide, side="right"))
    i, j = rest[i], p[j]
    same = x.code[s["start"][i]] == x.code[s["start"][j]]
    i, j = i[same], j[same]
    either = lambda a, b: np.where(np.isnan(a), b, a)
    gap = np.where(s["end"][j] < s["start"][i], either(s["pre"][i], s["post"][j]), either(s["post"][i], s["pre"][j]))
    stands[i[gap <= s["tolerated"][i]]] = False
    return stands


def _protected(x: Trains, g: Grammar, found: list[Table]) -> tuple[Table, np.ndarray]:
    """(candidates that detectors.protected() leaves, their layers)."""
    states = found[LAYERS.index("hf_spiking")]
    layer = np.repeat(np.arange(len(found)), [len(t["start"]) for t in found])
    every = {k: np.concatenate([t[k] for t in found]) for k in FIELDS}
    label, start, end = every["label"], every["start"], every["end"]
    burst = (label == BURST) | (label == LONG)
    keep = np.ones(len(label), bool)
    if len(states["start"]):
        states = states | {"tolerated": np.full(len(states["start"]), g.hfs_tolerated)}
        stands = _standing(x, states, _some(every, burst))
        keep[np.flatnonzero(label == SPIKING)] = stands
        s = _some(states, stands)
        weak = ~burst & (label != SPIKING)
        keep[weak & (s["end"].searchsorted(start) < s["start"].searchsorted(end, side="right"))] = False
        n = s["end"] - s["start"] + 1
        calm = s["q90"] <= g.hfs_q90
        strong = _some(s, calm & (((n >= 80) & (s["short"] >= 0.70) & (s["bridged"] >= 0.90)) | ((n >= 30) & (s["short"] >= 0.85) & (s["bridged"] >= 0.95))))
        if len(strong["start"]):
            at = np.minimum(strong["end"].searchsorted(start), len(strong["start"]) - 1)
            n = (strong["end"] - strong["start"] + 1)[at]
            inside = (start >= strong["start"][at]) & (end <= strong["end"][at])
            keep[burst & inside & (end - start + 1 <= np.maximum(8, np.ceil(0.06 * n))) & (every["duration"] <= 0.25)] = False
    return _some(every, keep), layer[keep]


def _selected(x: Trains, c: Table, layer: np.ndarray) -> Table:
    """Of each train's candidates, those without overlap that are worth most in all."""
    label, n, score, p = c["label"], c["n"], c["score"], c["priority"]
    state = 1040 * 10000 + 180 * score + 45_000 * np.minimum(n, 300)
    episode = np.where(label == BURST, 1250, 1160) * 10000 + 180 * score + 2_500_000 * np.minimum(n, 80)
    other = np.where(label == POSSIBLE, np.minimum(p, 520.0), p) * 10000 + 100 * score + n
    worth = np.where(label == SPIKING, state, np.where(((label == BURST) | (label == LONG)) & (layer == LAYERS.index("episode")), episode, other))
    order = np.lexsort((layer, c["start"], c["end"]))
    start, end, worth = c["start"][order], c["end"][order], worth[order].tolist()
    before = end.searchsorted(start, side="left").tolist()
    edges = np.flatnonzero(np.r_[True, np.diff(x.code[start]) != 0, True]).tolist() if len(start) else []
    chosen = []
    for first, stop in zip(edges, edges[1:], strict=False):  # as detectors.best_apart(); ends of earlier trains are before all starts
        best, take = [0.0], []
        for i in range(first, stop):
            with_it, without = worth[i] + best[before[i] - first], best[-1]
            take.append(with_it > without)
            best.append(with_it if with_it > without else without)
        j = stop
        while j > first:
            if take[j - 1 - first]:
                chosen.append(j - 1)
                j = before[j - 1]
            else:
                j -= 1
    chosen = np.array(chosen[::-1], np.int64)
    return {"start": start[chosen], "end": end[chosen], "label": label[order][chosen]}


def _events(x: Trains, label: np.ndarray) -> Table:
    """Runs of equal labels."""
    change = x.new | np.r_[True, label[1:] != label[:-1]]
    a = np.flatnonzero(change)
    b = np.r_[a[1:], len(label)] - 1
    named = label[a] != NONE
    return {"start": a[named], "end": b[named], "label": label[a[named]]}


#: Spikes that an event of each label has at least.
_LEAST = np.array([1, *(LEAST_SPIKES[name] for name in LABELS[1:])])


def _validated(x: Trains, chosen: Table) -> Table:
    label = np.zeros(len(x.isi), np.int64)
    i, at = _pairs(chosen["start"], chosen["end"] + 1)
    label[at] = chosen["label"][i]
    label[x.new] = NONE
    e = _events(x, label)
    real = np.r_[0, np.cumsum(x.real & ~x.artifact)]
    least, n = _LEAST[e["label"]], e["end"] - e["start"] + 1
    fine = (n + 1 >= least) & (real[e["end"] + 1] - real[e["start"]] >= least - 1) & (x.t[e["end"]] - x.t[np.maximum(e["start"] - 1, 0)] >= 0)
    return _some(e, fine)


def found(x: Trains, g: Grammar) -> Table:
    """(start, end, label) of the events that detectors.detect() finds under a grammar, places in the batch."""
    with np.errstate(all="ignore"):
        bursts, episodes = x.once(g, _bursts, "seed_", "bridge", "contrast", "possible_", "one_sided_", "min_", "max_", "q95_", "strict_", "classic_", "long_", "rescue_", "strong_", "episode_")
        spiking, fast = x.once(g, _spiking, "hfs_", "pause_min"), x.once(g, _fast_tonic, "hft_", "seed_", "min_seeds")
        tonic, core = _tonic(x, g)
        return _validated(x, _selected(x, *_protected(x, g, [bursts, episodes, spiking, fast, _pauses(x, g), tonic, core])))


def _matches(n: int, pred: Table, truth: Table, least: float) -> np.ndarray:
    """Labels of the matches of predicted and true events that validation.matched() makes in each train."""
    out = []
    for label in np.unique(truth["label"]):
        p, t = (_some(e, e["label"] == label) for e in (pred, truth))
        i, j = _pairs(t["end"].searchsorted(p["start"]), t["start"].searchsorted(p["end"], side="right"))
        a, b, c, d = p["start"][i], p["end"][i], t["start"][j], t["end"][j]
        iou = (np.minimum(b, d) - np.maximum(a, c) + 1) / (np.maximum(b, d) - np.minimum(a, c) + 1)
        good = iou >= least
        i, j, iou = i[good], j[good], iou[good]
        single = (np.bincount(i, minlength=len(p["start"]))[i] == 1) & (np.bincount(j, minlength=len(t["start"]))[j] == 1)
        took = i[single].tolist()
        rest = np.flatnonzero(~single)
        rest = rest[np.lexsort((j[rest], i[rest], -iou[rest]))]
        seen_p, seen_t = set(), set()
        for k, m in zip(i[rest].tolist(), j[rest].tolist(), strict=True):
            if k not in seen_p and m not in seen_t:
                seen_p.add(k)
                seen_t.add(m)
                took.append(k)
        out.append(np.c_[p["start"][took], np.full(len(took), label)])
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Trains]]:
    for t, code in whole_trains(batches):
        number = lambda c, t=t: t.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
        idx = t.column("idx").to_numpy()
        if ((np.diff(idx) != 1) & (np.diff(code) == 0)).any() or (idx[np.r_[True, np.diff(code) != 0]] != 1).any():
            raise ValueError("rows of a train have to be numbered from 1")
        yield t, Trains(code, number("isi"), t.column("artifact").fill_null(False).to_numpy(zero_copy_only=False), number("t"))


def _in_order(rows: DataFrame, *more: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that small rows aren't put together for few tasks: the work is in the scan
    return rows.where("train is not null").select("train", "idx", "isi", "t", "artifact", *more).repartition(n, "train").sortWithinPartitions("train", "idx")


def detected(rows: DataFrame, grammars: dict[str, Grammar]) -> DataFrame:
    """(variant, train, label, start, end): the events that each grammar finds in each train, as tuning.detected_variants() gives them. rows are all intervals of their trains."""
    schema = f"variant string, train {dict(rows.dtypes)['train']}, label string, start int, end int"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, x in _batches(batches):
            idx = t.column("idx").to_numpy()
            for name, g in grammars.items():
                e = found(x, g)
                columns = [pa.array([name] * len(e["start"])), t.column("train").take(pa.array(e["start"])), pa.array(np.array(LABELS)[e["label"]], pa.string()), pa.array(idx[e["start"]]), pa.array(idx[e["end"]])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return _in_order(rows).mapInArrow(run, schema)


def counts(rows: DataFrame, grammars: dict[str, Grammar], truth: str = "manual", least: float = 0.25) -> DataFrame:
    """(variant, train, label, truth_n, pred_n, tp) of the events that each grammar finds against runs of labels by hand (a column of rows): tuning.counts() of detected(), found where the train is."""
    schema = f"variant string, train {dict(rows.dtypes)['train']}, label string, truth_n long, pred_n long, tp long"
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, x in _batches(batches):
            by_hand = t.column("_truth").fill_null("").dictionary_encode()
            names = list(LABELS) + [v for v in by_hand.dictionary.to_pylist() if v not in LABELS]
            place = np.array([names.index(v) for v in by_hand.dictionary.to_pylist()])
            true = _events(x, place[by_hand.indices.to_numpy(zero_copy_only=False)])
            first = np.flatnonzero(x.new)
            count = lambda start, label, k=len(names), x=x: np.bincount(x.code[start] * k + label, minlength=(x.code[-1] + 1) * k)
            truth_n = count(true["start"], true["label"])
            for name, g in grammars.items():
                e = found(x, g)
                m = _matches(len(x.isi), e, true, least)
                pred_n, tp = count(e["start"], e["label"]), count(m[:, 0], m[:, 1])
                some = np.flatnonzero(truth_n + pred_n)
                columns = [pa.array([name] * len(some)), t.column("train").take(pa.array(first[some // len(names)])), pa.array([names[i] for i in (some % len(names)).tolist()], pa.string()), *(pa.array(c[some]) for c in (truth_n, pred_n, tp))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, kind, strict=True)], schema=kind)

    return _in_order(rows.withColumn("_truth", F.col(truth)), "_truth").mapInArrow(run, schema)
