"""Quality classifier: Bradley-Terry scores learnt from preference pairs, thresholded at a quantile of the scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batches_of, held_out, ranked, small, stored, table, without_clashes

#: Labelled documents of a group, within which pairs are drawn; pairs at least, if each document is taken up to MOST times (LEAST times otherwise).
GROUP, PAIRS, LEAST, MOST = 2_000, 40_000, 2, 40
#: The score that a document at the threshold gets.
CUT = 0.3
PUNCTUATION = np.array([c for c in range(0x21, 0x7F) if not chr(c).isalnum()])
N_FEATURES = 17 + len(PUNCTUATION)


def features(text: bytes | None) -> np.ndarray:
    """Shares and rates of one whole text (UTF-8): classes of characters, single punctuation marks, words, repetition, lines."""
    raw = text or b""
    words, out = raw.split(), np.zeros(N_FEATURES)
    if not words:
        out[0] = 1
        return out
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n, k, lines = c.sum(), len(words), raw.split(b"\n")
    upper, lower, high = c[65:91].sum(), c[97:123].sum(), c[128:].sum()
    letters = max(1.0, upper + lower + high)
    sizes = np.fromiter(map(len, words), np.int64, k)
    out[1:17] = (
        np.log1p(k) / 10,
        letters / n,
        upper / letters,
        c[48:58].sum() / n,
        (n - letters - c[48:58].sum() - c[32] - c[9:14].sum()) / n,
        min(sizes.mean(), 50) / 10,
        min(sizes.std(), 50) / 10,
        (sizes <= 3).mean(),
        sum(map(bytes.isupper, words)) / k,
        sum(map(eq, words, words[1:])) / k,
        len(set(words)) / k,
        sum(not w.isalnum() and w.isascii() and not w.strip(b".,;:'\"()-?!").isalnum() for w in words) / k,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / len(lines)) / 10,
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
        np.sqrt(max(np.unique(sizes, return_counts=True)[1]) / k),
    )
    out[17:] = np.minimum(np.sqrt(c[PUNCTUATION] / n), 0.5)
    return out


def pair_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of differences of features, added up: their number, logistic loss, its gradient and its second derivatives, in one row of numbers."""
    m = np.clip(d @ w, -30, 30)
    p = 1 / (1 + np.exp(m))
    return np.concatenate([[len(d), np.log1p(np.exp(-m)).sum()], -(d.T @ p), (d.T @ (d * (p * (1 - p))[:, None])).ravel()])


def least(sums: Callable[[np.ndarray], np.ndarray], k: int, decay: float, steps: int) -> np.ndarray:
    """The weights that make the mean loss plus decay / 2 times their squares least, by Newton's method; a step that makes it larger is halved."""
    w, step, best = np.zeros(k), np.zeros(k), np.inf
    for _ in range(steps):
        s = sums(w)
        n = max(1.0, s[0])
        loss = s[1] / n + decay / 2 * w @ w
        if loss > best + 1e-12 and np.abs(step).max() > 1e-9:
            step = step / 2
            w = w + step
            continue
        best, gradient = loss, s[2 : 2 + k] / n + decay * w
        step = np.linalg.solve(s[2 + k :].reshape(k, k) / n + decay * np.eye(k), gradient)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_pairs(better: np.ndarray, worse: np.ndarray, n: int = PAIRS, decay: float = 1e-3, steps: int = 300, seed: int = 11) -> np.ndarray:
    """Weights of a Bradley-Terry model: the log-odds that one document is preferred to another are weights @ (difference of their features). Pairs are drawn with a
    seed; the loss is logistic."""
    rng = np.random.default_rng(seed)
    d = better[rng.integers(len(better), size=n)] - worse[rng.integers(len(worse), size=n)]
    return least(lambda w: pair_sums(d, w), d.shape[1], decay, steps)


def _vectors(c: pa.Array) -> np.ndarray:
    return c.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _total(df: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """What of() gives for batches of the vectors x of df, added up: by tasks first, so that a row for each task reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                one = of(_vectors(b.column(0)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    return np.array(df.select("x").mapInArrow(run, "s array<double>").toArrow().column("s").to_pylist()).sum(0)


def grouped(labels: DataFrame, sizes: dict[int, int], label_col: str) -> tuple[DataFrame, int]:
    """((doc_id, label, again, group), groups): labelled documents dealt out to groups of about GROUP by the place of a hash in their class. Each group has both labels: a class with fewer documents than there
    are groups goes round, again from the second time on."""
    n = -(-sum(sizes.values()) // GROUP)
    parts = []
    for label, size in sizes.items():
        own = labels.where(F.col(label_col) == label).select("doc_id", F.lit(label).alias("label"))
        x = ranked(own, F.xxhash64(F.lit(3), "doc_id"), F.col("doc_id"), name="_r")
        at = F.array(F.col("_r") % n) if size >= n else F.sequence(F.col("_r"), F.lit(n - 1).cast("long"), F.lit(size).cast("long"))
        parts.append(x.select("doc_id", "label", F.posexplode(at.cast("array<int>")).alias("again", "group")).withColumn("again", F.col("again") > 0))
    return parts[0].unionByName(parts[1]), n


def pairs(rows: DataFrame, mean: np.ndarray, std: np.ndarray, each: int) -> DataFrame:
    """(x): differences of scaled features, better less worse, of pairs within the groups of rows (group, label, x). Each document of the larger class of a group is in `each` pairs, one of the smaller in as many
    or more; which ones meet depends on the group alone, not on the order of its rows."""

    def close(group: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = np.concatenate([_vectors(b.column(2)) for b in held]), np.concatenate([b.column(1).to_numpy() for b in held])
        order = np.lexsort((*x.T, y))
        z, y = np.clip((x[order] - mean) / std, -5, 5), y[order]
        one, none = z[y == 1], z[y == 0]
        if not len(one) or not len(none):
            return
        rng, most = np.random.default_rng([11, group]), max(len(one), len(none))
        for _ in range(each):
            a, b = (np.resize(rng.permutation(len(v)), most) for v in (one, none))
            yield pa.RecordBatch.from_arrays([_lists(one[a] - none[b])], ["x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            group = b.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]) if len(group) else []
            for i, j in zip(edges, edges[1:], strict=False):
                if held and group[i] != now:
                    yield from close(now, held)
                    held = []
                now = int(group[i])
                held.append(b.slice(int(i), int(j - i)))
        if held:
            yield from close(now, held)

    return rows.select("group", "label", "x").repartition("group").sortWithinPartitions("group").mapInArrow(run, "x array<double>")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "label") -> dict | None:
    """A model from docs (doc_id, text) and labels (doc_id, label 0 or 1; others don't count); None unless there are both labels. All labelled documents count, for scaling, pairs and threshold; only sums over
    tasks, N_FEATURES squared numbers each, and single scores reach the driver.

    The threshold is where the scores pass the quantile that leaves out as many as have label 0: half-way between the quantiles just below and above, so that it stands in a gap if there is one.
    """
    known = labels.where(F.col(label_col).isin(0, 1))
    sizes = {int(r[0]): r[1] for r in known.groupBy(label_col).agg(F.count(F.lit(1))).collect()}
    if len(sizes) < 2:
        return None
    chosen = small(stored(grouped(known, sizes, label_col)[0], "labels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 256):
            x = [features(t).tolist() for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], [*b.schema.names[:-1], "x"])

    some = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    if sum(sizes.values()) <= BROADCAST_ROWS:
        rows = some.join(chosen, "doc_id").select("group", "label", "again", "text").mapInArrow(run, "group int, label int, again boolean, x array<double>")
    else:  # texts aren't shuffled
        rows = some.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>").join(chosen, "doc_id").select("group", "label", "again", "x")
    rows = stored(rows, "quality-features")
    once = rows.where("not again")
    n = {int(r[0]): r[1] for r in once.groupBy("label").agg(F.count(F.lit(1))).collect()}
    if len(n) < 2:
        return None
    total = sum(n.values())
    # rounded, as the weights: sums depend in their last digits on the order of tasks, and the model must not
    mean = np.round(_total(once, lambda x: x.sum(0)) / total, 9)
    std = np.round(np.maximum(np.sqrt(_total(once, lambda x: ((x - mean) ** 2).sum(0)) / total), 1e-2), 9)
    drawn = stored(pairs(rows, mean, std, min(MOST, max(LEAST, -(-PAIRS // total)))), "quality-pairs")
    w = np.round(least(lambda w: _total(drawn, lambda d: pair_sums(d, w)), N_FEATURES, 1e-3, 30), 6)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((_vectors(b.column(0)) - mean) / std, -5, 5) @ w)], ["s"])

    some = once.select("x").mapInArrow(scored, "s double").withColumn("at", F.monotonically_increasing_id())  # copies have one score: their order doesn't matter, but they are spread
    s = stored(ranked(some, F.col("s"), F.col("at"), name="r"), "quality-scores")
    share = n[0] / total
    at = {q: min(total - 1, max(0, int(np.ceil(q * total - 1e-9)) - 1)) for q in (0.95 * share, share + 0.05 * (1 - share), 0.1, 0.9)}
    found = {r["r"]: r["s"] for r in s.where(F.col("r").isin(list(at.values()))).collect()}
    low, high, least_, most = (found[k] for k in at.values())
    return {"mean": mean, "std": std, "w": w, "cut": (low + high) / 2, "unit": max(1e-6, (most - least_) / 8)}


def score(docs: DataFrame, model: dict | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (of its columns only keep, if given) plus score (0 to 1; at the model's threshold 0.3) and predicted (1 if score >= 0.3, else 0), from the whole text alone.

    Null, empty and blank texts share one feature vector of their own and are scored like others. Without a model every score is 0.5. Repeated rows
    get the same score. An empty table gives an empty result; columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    kept = without_clashes(docs.select(*keep) if keep else docs, "score", "predicted", "_raw")
    sent = spark.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches_of(batches, 256):
            rows = b.column(b.num_columns - 1).to_pylist()
            p = np.full(len(rows), 0.5)
            if m and rows:
                z = np.clip((np.stack([features(t) for t in rows]) - m["mean"]) / m["std"], -5, 5)
                p = 1 / (1 + np.exp(-np.clip((z @ m["w"] - m["cut"]) / m["unit"] + np.log(CUT / (1 - CUT)), -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p)], [*b.schema.names[:-1], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    out = docs.select(*kept.columns, F.col(text_col).cast("binary").alias("_raw")).mapInArrow(run, f"{schema}, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    out = score(docs, fit(docs, labels.where(~held_out())), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
