"""Surrogate sequences of labels: what the order, the runs or the transitions of a train's labels would look like by chance, and how its own compare."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from pulsegrid.sources.shared import stored

from .dynamics import entropy_rate, motifs, transitions
from .runs import segments

#: Shuffled kinds keep what they shuffle; made kinds are drawn anew from a train's transitions, or from its states and their runs.
SHUFFLED, MADE = ["label_permutation", "block_shuffle", "run_shuffle"], ["markov", "renewal"]
KINDS = [*SHUFFLED, *MADE]
METRICS = ["transition_entropy", "max_transition_prob", "top_motif_rate", "mean_dwell_isi", "dwell_cv", "state_n"]
#: Places that are drawn at once, and labels that are measured at once.
CHUNK, LABELS = 8192, 1_000_000


def _numbered(states: DataFrame) -> DataFrame:
    order = Window.partitionBy("train").orderBy("idx")
    x = states.where("state is not null and state <> ''").withColumns({"_k": F.row_number().over(order) - 1, "_new": F.coalesce((F.col("state") != F.lag("state").over(order)).cast("int"), F.lit(1))})
    return x.select("train", "state", "_k", F.sum("_new").over(order).alias("_run"))


def shuffled(states: DataFrame, n: int, kinds: list[str] | None = None, block: int = 10, seed: int = 1) -> DataFrame:
    """(kind, surrogate, train, idx, state), places from 1: each train's labels, one by one, in blocks or in runs, in the order of a seeded hash."""
    x = _numbered(states)
    unit = {"label_permutation": F.col("_k"), "block_shuffle": F.floor(F.col("_k") / block), "run_shuffle": F.col("_run")}
    x = x.withColumn("_u", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), unit[k].cast("long").alias("unit")) for k in kinds or SHUFFLED])))
    x = x.withColumn("surrogate", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("train", "state", "_k", "_u.*", "surrogate")
    order = Window.partitionBy("kind", "surrogate", "train").orderBy(F.xxhash64(F.lit(seed), "kind", "surrogate", "train", "unit"), "unit", "_k")
    return x.select("kind", "surrogate", "train", F.row_number().over(order).alias("idx"), "state")


def _draw(kind: str, states: list[str], n: int, weights: list[float], rows: list[list[float]], lengths: dict[str, tuple[list[int], list[float]]], rng: np.random.Generator) -> Iterator[list[str]]:
    """The states of a sequence of n places, in parts. rows are cumulative weights of the next state."""
    pick = lambda ends, u: min(bisect.bisect_right(ends, u * ends[-1]), len(ends) - 1)
    first = np.cumsum(weights).tolist()
    now, left, done, after = None, n, [], {}
    while left > 0:
        draws = iter(rng.random(2 * min(CHUNK, left)).tolist())
        for u in draws:
            if kind == "markov":
                now, length = pick(first if now is None else rows[now], u), 1
            else:
                if now not in after:
                    open_ = [w if i != now else 0.0 for i, w in enumerate(weights)]
                    after[now] = np.cumsum(open_ if sum(open_) > 0 else [1.0] * len(open_)).tolist()
                now = pick(after[now], u)
                sizes, ends = lengths[states[now]]
                length = sizes[pick(ends, next(draws))]
            take = min(length, left)
            left -= take
            while take:  # a run may be longer than a part
                part = min(take, CHUNK - len(done))
                done += [states[now]] * part
                take -= part
                if len(done) == CHUNK:
                    yield done
                    done = []
            if not left:
                break
    if done:
        yield done


def _made(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                key = [seed, KINDS.index(r["kind"]), r["surrogate"], zlib.crc32(str(r["train"]).encode())]
                sizes = {s["state"]: ([x["length"] for x in s["sizes"]], np.cumsum([x["n"] for x in s["sizes"]]).tolist()) for s in r["lengths"] or []}
                names = r["states"]
                at = 1
                for part in _draw(r["kind"], names, r["n"], r["weights"], [np.cumsum(x).tolist() for x in r["rows"]], sizes, np.random.default_rng(key)):
                    k = len(part)
                    train = pa.array([r["train"]] * k, b.schema.field("train").type)
                    yield pa.RecordBatch.from_arrays([pa.array([r["kind"]] * k), pa.array([r["surrogate"]] * k, pa.int32()), train, pa.array(range(at, at + k), pa.int32()), pa.array(part)], ["kind", "surrogate", "train", "idx", "state"])
                    at += k

    return run


def _tables(x: DataFrame, smoothing: float) -> DataFrame:
    """What made sequences are drawn from, a row for each train of _numbered() states: its states in order, their smoothed transitions, how many labels and runs each has, and the lengths of those runs."""
    each = x.groupBy("train", "state").agg(F.count(F.lit(1)).alias("c"))
    runs_ = x.groupBy("train", "state", "_run").agg(F.count(F.lit(1)).alias("length"))
    sizes = runs_.groupBy("train", "state", "length").agg(F.count(F.lit(1)).alias("n"))
    by_state = sizes.groupBy("train", "state").agg(F.sum("n").alias("runs"), F.sort_array(F.collect_list(F.struct("length", "n"))).alias("sizes"))
    moves = x.select("train", F.col("state").alias("a"), F.lead("state").over(Window.partitionBy("train").orderBy("_k")).alias("b")).where("b is not null").groupBy("train", "a", "b").agg(F.count(F.lit(1)).alias("m"))
    listed = each.join(by_state, ["train", "state"]).groupBy("train").agg(F.sum("c").alias("n"), F.sort_array(F.collect_list(F.struct("state", "c", "runs", "sizes"))).alias("s"))
    moved = moves.groupBy("train").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("a", "b"), F.col("m").cast("double")))).alias("moves"))
    t = listed.join(moved, "train", "left")
    count = lambda a, b: F.coalesce(F.try_element_at("moves", F.struct(a.alias("a"), b.alias("b"))), F.lit(0.0)) + smoothing
    rows = F.transform("s.state", lambda a: F.transform("s.state", lambda b: count(a, b)))
    return t.select("train", "n", F.col("s.state").alias("states"), rows.alias("rows"), F.transform("s", lambda v: v["c"].cast("double")).alias("by_label"), F.transform("s", lambda v: v["runs"].cast("double")).alias("by_run"), F.transform("s", lambda v: F.struct(v["state"].alias("state"), v["sizes"].alias("sizes"))).alias("all_lengths"))


def made(states: DataFrame, n: int, kinds: list[str] | None = None, smoothing: float = 1.0, seed: int = 1) -> DataFrame:
    """(kind, surrogate, train, idx, state), places from 1: markov sequences of each train's smoothed transitions, and renewal ones, whose runs are drawn from the states' own, no state after itself.

    A sequence is drawn from a generator seeded by train and surrogate; what a task holds of a train is its table of transitions and the different lengths of its runs, however long it is."""
    kinds = kinds or MADE
    t = _tables(stored(_numbered(states), "numbered-states"), smoothing)
    train = t.schema["train"].dataType.simpleString()
    t = t.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds]))).withColumn("surrogate", F.explode(F.sequence(F.lit(1), F.lit(n))))
    t = t.withColumns({"weights": F.when(F.col("kind") == "markov", F.col("by_label")).otherwise(F.col("by_run")), "lengths": F.when(F.col("kind") == "renewal", F.col("all_lengths"))})
    spread = t.select("kind", "surrogate", "train", "n", "states", "weights", "rows", "lengths").repartition("train", "surrogate", "kind")
    return spread.mapInArrow(_made(seed), f"kind string, surrogate int, train {train}, idx int, state string")


def surrogates(states: DataFrame, n: int, kinds: list[str] | None = None, block: int = 10, smoothing: float = 1.0, seed: int = 1) -> DataFrame:
    """(kind, surrogate, train, idx, state): n sequences of each kind for each train of (train, idx, state), as long as its own; rows without a label don't count."""
    kinds = kinds or KINDS
    parts = [f(states, n, some, **more, seed=seed) for f, some, more in ((shuffled, [k for k in kinds if k in SHUFFLED], {"block": block}), (made, [k for k in kinds if k in MADE], {"smoothing": smoothing})) if some]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def sequence_measures(states: DataFrame, motif: int = 3) -> DataFrame:
    """(train, metric, value) of labels (train, idx, state): entropy of the next label, the most certain transition, the share of the most frequent motif, mean and variation of the runs' lengths, and the number
    of labels; under two rows only the last. Values are rounded to twelve digits, so that equal ones are equal however they were added up."""
    t = transitions(states)
    next_ = entropy_rate(t).select("train", F.col("entropy_rate").alias("transition_entropy"))
    most = t.groupBy("train").agg(F.max("row").alias("max_transition_prob"))
    m = motifs(states, motif, collapse=False).groupBy("train").agg((F.max("n") / F.sum("n")).alias("top_motif_rate"))
    runs_ = segments(states, F.col("state")).groupBy("train").agg(F.avg("n").alias("mean_dwell_isi"), (F.stddev_samp("n") / F.avg("n")).alias("dwell_cv"), F.sum("n").alias("_n"))
    n = states.groupBy("train").agg(F.count_distinct("state").cast("double").alias("state_n"))
    x = n.join(next_, "train", "left").join(most, "train", "left").join(m, "train", "left").join(runs_, "train", "left")
    value = lambda c: F.when((F.col("_n") >= 2) | F.lit(c == "state_n"), F.round(c, 12))
    return x.select("train", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), value(c).alias("value")) for c in METRICS])))


def measured(codes: np.ndarray, sizes: np.ndarray, motif: int = 3) -> list[np.ndarray]:
    """The METRICS of sequences that stand one after another (states as numbers from 0; sizes are their lengths, one at least), each an array with a value for each sequence, before rounding; NaN is null."""
    g, s, ends = np.repeat(np.arange(len(sizes)), sizes), int(codes.max(initial=0)) + 1, np.cumsum(sizes)
    add = lambda at, v=None: np.bincount(at, v, len(sizes))

    def top(at: np.ndarray, v: np.ndarray) -> np.ndarray:  # at: sorted
        out, start = np.full(len(sizes), np.nan), np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
        if len(start):
            out[at[start]] = np.maximum.reduceat(v, start)
        return out

    def grams(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, first place, last place, count) of each different run of k labels."""
        at = np.flatnonzero(np.arange(len(codes)) + k <= ends[g])
        key = g[at]
        for j in range(k):
            key = key * s + codes[at + j]
            if len(sizes) * float(s) ** (j + 2) > 2.0**62:  # numbered anew, in the same order
                key = np.unique(key, return_inverse=True)[1]
        _, place, n = np.unique(key, return_index=True, return_counts=True)
        return g[at[place]], codes[at[place]], at[place], n

    with np.errstate(all="ignore"):
        of, source, _, n = grams(2)
        left = np.unique(of * s + source, return_inverse=True)[1]
        share = n / np.bincount(left, n, 1)[left] if len(n) else np.zeros(0)
        entropy = add(of, -n * np.log2(share)) / add(of, n)
        whose, _, _, m = grams(motif)
        new = np.r_[True, codes[1:] != codes[:-1]] if len(codes) else np.zeros(0, bool)
        new[ends - sizes] = True
        start = np.flatnonzero(new)
        length, run = np.diff(np.r_[start, len(codes)]), g[start]
        count = add(run)
        mean = sizes / count
        dwell = np.sqrt(add(run, (length - mean[run]) ** 2) / (count - 1)) / mean
        out = [entropy, top(of, share), top(whose, m.astype(float)) / add(whose, m), mean, np.where(count > 1, dwell, np.nan)]
    return [np.where(sizes > 1, v, np.nan) for v in out] + [add(np.unique(g * s + codes) // s).astype(float)]


def _parts(sizes: np.ndarray) -> Iterator[slice]:
    """Sequences in order, of LABELS in all at a time (one, if it's longer)."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(total.searchsorted((total[at - 1] if at else 0) + LABELS, side="right")))
        yield slice(at, end)
        at = end


def _out(columns: list, values: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(v, pa.float64(), mask=np.isnan(v)) for v in values]], schema=schema)


def _flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    c = b.column(name)
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(c).to_numpy(zero_copy_only=False).astype(np.int64)


def _measured_lists(schema: pa.Schema, motif: int, block: int):
    """Measures of each row's list of labels (codes), or of what the order of its units makes of it (order, kind); the other columns go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for some in _parts(_flat(whole, "codes")[1]):
                b = whole.slice(some.start, some.stop - some.start)
                codes, sizes = _flat(b, "codes")
                if "order" in b.schema.names:
                    order, units = _flat(b, "order")
                    kind = np.array([SHUFFLED.index(k) for k in b.column("kind").to_pylist()], int)
                    g, first, at = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes, np.cumsum(units) - units
                    k = np.arange(len(codes)) - first[g]
                    new = np.r_[0, codes[1:] != codes[:-1]] if len(codes) else np.zeros(0, int)
                    new[first] = 0
                    runs_ = np.cumsum(new)
                    unit = np.choose(kind[g], [k, k // block, runs_ - runs_[first][g]])
                    of, rank = np.repeat(np.arange(len(units)), units), np.zeros(len(order), np.int64)
                    rank[at[of] + order] = np.arange(len(order)) - at[of]
                    codes = codes[np.argsort(at[g] + rank[at[g] + unit], kind="stable")]
                yield _out([b.column(n) for n in b.schema.names if n not in ("order", "codes")] if "order" in b.schema.names else list(b.columns), measured(codes, sizes, motif), schema)

    return run


def _measured_made(schema: pa.Schema, motif: int, n: int, kinds: list[str], seed: int):
    """Measures of the sequences of each kind that are drawn from a train's tables, the same as surrogates() draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, keys, total = [], [], 0

            def close() -> pa.RecordBatch:
                at = pa.array([k[0] for k in keys])
                through = [b.column(f"o{i}").take(at) for i in range(len(METRICS))]
                values = measured(np.concatenate(held), np.array([len(h) for h in held]), motif)
                return _out([b.column("train").take(at), pa.array([k[1] for k in keys]), *through], values, schema)

            for i, r in enumerate(b.select([c for c in b.schema.names if c not in {f"o{i}" for i in range(len(METRICS))}]).to_pylist()):
                names, rows = list(range(len(r["states"]))), [np.cumsum(x).tolist() for x in r["rows"]]
                sizes = {k: ([x["length"] for x in s["sizes"]], np.cumsum([x["n"] for x in s["sizes"]]).tolist()) for k, s in enumerate(r["all_lengths"])}
                train = zlib.crc32(str(r["train"]).encode())
                for kind in kinds:
                    for g in range(1, n + 1):
                        parts = _draw(kind, names, r["n"], r["by_label" if kind == "markov" else "by_run"], rows, sizes, np.random.default_rng([seed, KINDS.index(kind), g, train]))
                        held.append(np.concatenate([np.array(p, np.int64) for p in parts]))
                        keys.append((i, kind))
                        total += len(held[-1])
                        if total >= LABELS:
                            yield close()
                            held, keys, total = [], [], 0
            if held:
                yield close()

    return run


def controls(states: DataFrame, n: int = 199, kinds: list[str] | None = None, block: int = 10, smoothing: float = 1.0, motif: int = 3, seed: int = 1) -> DataFrame:
    """(train, kind, metric, observed, mean, sd, p_high, p_low, p_two_sided): each train's measures against those of n surrogates of each kind, by the rule (1 + k) / (n + 1). Undefined values of surrogates don't
    count; p is null where the observed value is, or all of theirs are.

    The surrogates are those of surrogates(), but a sequence is never rows: it is ordered or drawn, and measured, within a task that holds one train's labels as numbers, and only its measures leave it."""
    kinds = kinds or KINDS
    spark = states.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)  # more than the bytes ask for: the work is in what is made of them
    x = stored(_numbered(states), "numbered-states")
    kind = f"train {x.schema['train'].dataType.simpleString()}"
    fields = lambda c: ", ".join(f"{c}{i} double" for i in range(len(METRICS)))
    arrow = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    lists = x.groupBy("train").agg(F.sort_array(F.collect_list(F.struct("_k", "state"))).alias("s"), F.sort_array(F.collect_set("state")).alias("names"), F.max("_run").alias("runs"))
    lists = lists.select("train", "runs", F.transform("s", lambda v: (F.array_position("names", v["state"]) - 1).cast("int")).alias("codes")).where("train is not null")
    seen_ddl = f"{kind}, runs long, codes array<int>, {fields('o')}"
    seen = stored(lists.mapInArrow(_measured_lists(arrow(seen_ddl), motif, block), seen_ddl), "observed-measures")
    observed, ddl = [f"o{i}" for i in range(len(METRICS))], f"{kind}, kind string, {fields('o')}, {fields('v')}"
    values = []
    mixed, drawn = [k for k in kinds if k in SHUFFLED], [k for k in kinds if k in MADE]
    if mixed:
        # as many units as shuffled() orders, by the same hash of each
        size = F.size("codes").cast("long")
        last = {"label_permutation": size - 1, "block_shuffle": F.floor((size - 1) / block).cast("long"), "run_shuffle": F.col("runs")}
        y = seen.repartition(parts, "train").withColumn("_u", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(int(k == "run_shuffle")).cast("long").alias("from"), last[k].alias("to")) for k in mixed])))
        y = y.withColumn("surrogate", F.explode(F.sequence(F.lit(1), F.lit(n)))).select("train", "codes", "surrogate", "_u.*", *observed)
        hashed = F.transform(F.sequence("from", "to"), lambda u: F.struct(F.xxhash64(F.lit(seed), "kind", "surrogate", "train", u).alias("h"), u.alias("u")))
        y = y.select("train", "kind", *observed, "codes", F.transform(F.sort_array(hashed), lambda v: (v["u"] - F.col("from")).cast("int")).alias("order"))
        values.append(y.mapInArrow(_measured_lists(arrow(ddl), motif, block), ddl))
    if drawn:
        t = _tables(x, smoothing).join(seen.select("train", *observed), "train").repartition(parts, "train")
        values.append(t.mapInArrow(_measured_made(arrow(ddl), motif, n, drawn, seed), ddl))
    y = reduce(DataFrame.unionByName, values)
    digits = lambda c: F.round(c, 12)
    y = y.select("train", "kind", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), digits(f"o{i}").alias("observed"), digits(f"v{i}").alias("value")) for i, c in enumerate(METRICS)])))
    known = F.col("observed").isNotNull() & F.col("value").isNotNull()
    y = y.groupBy("train", "kind", "metric").agg(F.first("observed").alias("observed"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count_if(known).alias("_n"), F.count_if(known & (F.col("value") >= F.col("observed"))).alias("_high"), F.count_if(known & (F.col("value") <= F.col("observed"))).alias("_low"))
    p = lambda c: F.when(F.col("_n") > 0, (1 + F.col(c)) / (F.col("_n") + 1))
    y = y.withColumns({"p_high": p("_high"), "p_low": p("_low")})
    return y.withColumn("p_two_sided", F.least(F.lit(1.0), 2 * F.least("p_high", "p_low"))).drop("_n", "_high", "_low")
