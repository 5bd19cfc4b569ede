"""Language ID by error-correcting output codes over character n-grams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, held_out, kept_by_worker, small, stored, table, without_clashes

#: Features: hashed letter bigrams and trigrams. CHUNK: code points that are looked at at once.
DIMS, CHUNK = 1 << 13, 1 << 18
#: Documents that the classifiers are fitted on, for each language: all if it has fewer, else about so many, chosen by a hash of the id.
TRAIN_DOCS = 800
#: Documents of all languages together that they are fitted on at most (on average); many languages share them.
TRAIN_TOTAL = 4_000
UNDETERMINED = "und"
#: Below this lead of the best codeword's loss over the second's, as a share of their sum, a prediction is flagged as ambiguous.
MARGIN = 0.05


def _letters() -> np.ndarray:
    """For each code point its lower-case form, or 0 if it's no letter."""

    def make() -> np.ndarray:
        out = np.zeros(0x110000, np.uint32)
        for c in itertools.chain(range(0xD800), range(0xE000, 0x110000)):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        return out

    return kept_by_worker("letters", make)


def counts(text: str | None) -> np.ndarray | None:
    """Feature counts of a whole text; None if it has no letter. Letters are lower-cased; all else ends a word and is read as one gap."""
    total, seen, tail = np.zeros(DIMS), False, np.zeros(1, np.uint32)
    for a in range(0, len(text or ""), CHUNK):
        x = np.frombuffer(text[a : a + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([tail, _letters()[x]])
        x = x[np.r_[True, (x[1:] != 0) | (x[:-1] != 0)]]
        if len(x) > 1:
            two = (x[1:] * np.uint32(2654435761)) ^ (x[:-1] * np.uint32(2246822519))
            three = (two[1:] * np.uint32(3266489917)) ^ (x[:-2] * np.uint32(668265263))
            for h in (two[len(tail) - 1 :], three):  # the pair that the last chunk ends with has been counted
                total += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(19), minlength=DIMS)
        seen, tail = seen or bool(x.any()), x[-2:]
    return total if seen else None


def features(text: str | None) -> np.ndarray | None:
    c = counts(text)
    if c is None:
        return None
    x = np.sqrt(c)
    return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """Codewords of +1 and -1, a row for each of n languages: all different splits for up to 5 languages, else the random code, of many tried, whose
    codewords lie furthest apart."""
    if n <= 5:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits or [(1,) * n]).T
    rng, best, apart = np.random.default_rng(seed), None, -1.0
    for _ in range(200):
        code = rng.choice((-1, 1), (n, max(15, int(np.ceil(10 * np.log2(n))))))
        code = code[:, np.abs(code.sum(0)) < n]  # a bit that is the same for all says nothing
        least = ((code.shape[1] - code @ code.T) / 2 + 1e9 * np.eye(n)).min()
        if least > apart:
            best, apart = code, least
    return best


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 300, decay: float = 1e-5) -> np.ndarray:
    """A logistic classifier (weights and, for the last column of x, which is 1, a bias) for each bit, by accelerated gradient steps. Languages weigh alike."""
    share = 1 / np.maximum(np.bincount(y, minlength=len(code)), 1)
    s = (share[y] / share[y].sum()).astype(np.float32)[:, None]
    want = code[y].astype(np.float32)
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    look, rate = w, 2.0
    for k in range(steps):
        p = 1 / (1 + np.exp(np.clip(want * (x @ look), -30, 30)))
        new = look + rate * (x.T @ (s * want * p) - decay * look)
        look, w = new + k / (k + 3) * (new - w), new
    return w


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss-weighted decoding: the codeword with the least sum of logistic losses of the bits' margins. Returns places, scores (the share that the
    chosen codeword has of exp(-loss)), and the leads over the second."""
    loss = np.logaddexp(0, -margins[:, None, :] * code[None, :, :]).sum(2)
    best = loss.argmin(1)
    if code.shape[0] < 2:
        return best, np.ones(len(best)), np.ones(len(best))
    two = np.partition(loss, 1, 1)[:, :2]
    return best, 1 / np.exp(-(loss - loss.min(1, keepdims=True))).sum(1), (two[:, 1] - two[:, 0]) / np.maximum(two.sum(1), 1e-12)


def fit(train: DataFrame, per_lang: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, code, weights) from train (doc_id, text, lang); None without labelled text. The sample holds per_lang documents a language on average (fewer if TRAIN_TOTAL is shared by many),
    and only their feature vectors (at most DIMS numbers each) reach the driver."""
    train = train.where(F.col("lang").isNotNull())
    sizes = stored(train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    per_lang = min(per_lang, TRAIN_TOTAL / max(1, sizes.count()))
    chance = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_000)) < 1_000_000.0 * per_lang / F.col("n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 256, keeps=True):
            got = [(lang, features(t)) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            got = [(lang, x) for lang, x in got if x is not None]
            at = [np.flatnonzero(x) for _, x in got]
            yield pa.RecordBatch.from_arrays([pa.array([lang for lang, _ in got], pa.string()), pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([x[a].astype("<f2").tobytes() for (_, x), a in zip(got, at, strict=True)], pa.binary())], ["lang", "at", "x"])

    rows = train.join(small(sizes), "lang").where(chance).select("lang", "text").mapInArrow(run, "lang string, at binary, x binary").toArrow()
    got = sorted(zip(*(rows.column(c).to_pylist() for c in ("lang", "at", "x")), strict=True))  # the same whatever order the rows came in
    known = sorted({lang for lang, _, _ in got})
    if not known:
        return None
    x = np.zeros((len(got), DIMS + 1), np.float32)
    x[:, DIMS] = 1
    for i, (_, at, v) in enumerate(got):
        x[i, np.frombuffer(at, "<u2")] = np.frombuffer(v, "<f2")
    code = codewords(len(known))
    return known, code, fit_bits(x, np.array([known.index(lang) for lang, _, _ in got]), code)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray] | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (of its columns only keep, if given) plus lang_pred, score (0 to 1) and ambiguous, from the whole text alone.

    Null, empty and letterless texts, and all texts without a model, get und, score 0, and are ambiguous. Repeated rows get the same result.
    An empty table gives an empty result; columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    kept = without_clashes(docs.select(*keep) if keep else docs, "lang_pred", "score", "ambiguous", "_raw")
    sent = spark.sparkContext.broadcast(model)  # languages x bits and DIMS x bits numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches_of(batches, 256, keeps=True):
            found = [features(t) if model else None for t in b.column(b.num_columns - 1).to_pylist()]
            some = [i for i, x in enumerate(found) if x is not None]
            lang, score, unsure = [UNDETERMINED] * len(found), [0.0] * len(found), [True] * len(found)
            if some:
                known, code, w = model
                best, p, lead = decode(np.stack([found[i] for i in some]) @ w[:-1] + w[-1], code)
                for j, i in enumerate(some):
                    lang[i], score[i], unsure[i] = known[best[j]], float(p[j]), bool(lead[j] < MARGIN)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], [*b.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return docs.select(*kept.columns, F.col(text_col).alias("_raw")).mapInArrow(run, f"{schema}, lang_pred string, score double, ambiguous boolean")


def trained(docs: DataFrame):
    return fit(docs.where(~held_out()).select("doc_id", "text", "lang"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, trained(docs), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
