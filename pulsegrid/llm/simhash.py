"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a radius by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, small, stored, table, without_clashes

BITS, SEED, CHUNK = 64, 42, 1 << 16
#: Blocks of bits for the candidate tables. With radius 2, two of eight blocks may differ: 28 tables, and a bucket has at most 2**16 different fingerprints.
BLOCKS = 8


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Bits that are set in over half the hashes of the text's word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()  # of bytes: both know ASCII only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(BITS, np.int64)
    for a in range(0, n, CHUNK):
        part = words[a : a + CHUNK + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of each row, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 256):
            fps = [fingerprint(x, width) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long"), "fingerprints")


class BitSlices:
    """Fingerprints stored by bit: plane b holds bit b of all of them, in blocks of 64 to a machine word."""

    def __init__(self, fps: np.ndarray, bits: list[int]):
        self.n, self.bits, self.fps, self.abandoned, self.scanned = len(fps), bits, fps, 0, 0
        pad = -len(fps) % 64
        self.planes = np.stack([np.packbits(np.pad((fps >> np.uint64(b)) & np.uint64(1), (0, pad)).astype(np.uint8), bitorder="little").view(np.uint64) for b in bits])
        self.valid = np.packbits(np.pad(np.ones(len(fps), np.uint8), (0, pad)), bitorder="little").view(np.uint64)

    def within(self, queries: np.ndarray, radius: int, wanted: np.ndarray | None = None) -> np.ndarray:
        """Bit sets, a row for each query: the fingerprints within radius of it, of those wanted (bits like valid) if given.

        All distances of a block go up together: bit i of a carry-save counter is a word vector, and a counter that passes the radius stays out. A block in which
        all fingerprints are out, for all queries, is abandoned: the planes that are left aren't read for it."""
        width = radius.bit_length()
        wanted = self.valid if wanted is None else wanted & self.valid
        blocks = np.flatnonzero(wanted)  # those that are still looked at
        self.scanned += len(wanted)
        self.abandoned += len(wanted) - len(blocks)
        counter = [np.zeros((len(queries), len(blocks)), np.uint64) for _ in range(width)]
        out = np.repeat(~wanted[None, blocks], len(queries), 0)
        for plane, b in zip(self.planes, self.bits, strict=True):
            flip = np.uint64(0) - ((queries >> np.uint64(b)) & np.uint64(1))
            carry = plane[None, blocks] ^ flip[:, None]
            for c in counter:
                c ^= carry  # the sum's bit
                carry = carry & ~c  # carried where both were 1
            out |= carry
            for value in range(radius + 1, 1 << width):  # values the counter can show beyond the radius
                over = ~np.uint64(0)
                for i, c in enumerate(counter):
                    over = over & (c if value >> i & 1 else ~c)
                out |= over
            alive = np.any(~out, 0)
            if not alive.all():
                self.abandoned += len(alive) - int(alive.sum())
                blocks, out, counter = blocks[alive], out[:, alive], [c[:, alive] for c in counter]
                if not len(blocks):
                    break
        found = np.zeros((len(queries), len(wanted)), np.uint64)
        found[:, blocks] = ~out
        return found


def local_links(fps: np.ndarray, bits: list[int], radius: int) -> list[tuple[int, int]]:
    """(fingerprint, root) for each one that others of the same bucket reach over steps of at most radius bits; the root is reached first. Every
    link of the bucket is inside one of the components, so none is lost and none but these are made. What has been reached isn't looked for again."""
    slices, left, links, step = BitSlices(fps, bits), np.ones(len(fps), bool), [], max(1, (1 << 20) // max(64, len(fps)))
    packed = lambda x: np.packbits(np.pad(x, (0, -len(x) % 64)).astype(np.uint8), bitorder="little").view(np.uint64)
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root], todo = False, np.array([root])
        while len(todo) and left.any():
            wanted = packed(left)
            found = np.zeros_like(slices.valid)
            for a in range(0, len(todo), step):
                found |= np.bitwise_or.reduce(slices.within(fps[todo[a : a + step]], radius, wanted & ~found), 0)
            todo = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")[: len(fps)])
            left[todo] = False
            links += [(int(x), int(fps[root])) for x in fps[todo]]
        if not left.any():
            break
    return links


def links(reps: DataFrame, radius: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): links that join the same fingerprints (column fp, all different) as all pairs within radius do.

    Of any two within radius, at most radius blocks differ; so for each choice of that many blocks, those equal elsewhere share a
    bucket. A bucket's fingerprints differ in the chosen blocks only, which bounds their number.
    """
    cut = [BITS * i // blocks for i in range(blocks + 1)]
    free = [[b for i in c for b in range(cut[i], cut[i + 1])] for c in combinations(range(blocks), radius)]
    keep = [sum(1 << b for b in range(BITS) if b not in set(f)) for f in free]
    masks = F.array(*[F.lit(k - (1 << BITS) if k >> (BITS - 1) else k) for k in keep])
    rows = reps.select("fp", F.posexplode(masks).alias("t", "mask")).select("t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def close(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            t, key, fp = np.concatenate(part, 1) if part else np.zeros((3, 0), np.int64)
            edge = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]), True]) if len(t) else np.zeros(1, int)
            size, made = np.diff(edge), []
            for i in np.flatnonzero(size > 1):
                made += local_links(fp[edge[i] : edge[i + 1]].astype(np.uint64), free[t[edge[i]]], radius)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).astype(np.int64)) for x in zip(*made, strict=True)], ["a", "b"])

        for b in batches:
            got = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            if not got.shape[1]:
                continue
            # the last bucket may go on in the next batch
            last = np.flatnonzero((got[0] != got[0, -1]) | (got[1] != got[1, -1]))
            n = last[-1] + 1 if len(last) else 0
            if n:
                yield from close([*held, got[:, :n]])
                held = []
            elif held and (held[0][0, 0], held[0][1, 0]) != (got[0, 0], got[1, 0]):
                yield from close(held)
                held = []
            held.append(got[:, n:])
        yield from close(held)

    return rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches. In every round a node takes the smallest of its own root's root and those
    of its neighbours, and the table is stored; rounds grow with the logarithm of the longest chain.

    edges is stored before it is turned round: a plan that reads it twice would compute it twice, and links that come in another order then needn't be the same.
    Self-links and repeated links do no harm; without edges the result is empty."""
    edges = stored(edges.distinct(), "links")
    each = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")), F.struct("a", F.col("a").alias("b")), F.struct(F.col("b").alias("a"), "b"))
    both = stored(edges.select(F.explode(each).alias("e")).select("e.*").distinct(), "edges")
    roots, seen = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "roots"), None
    while True:
        state = roots.agg(F.bit_xor(F.xxhash64("node", "root")), F.sum(F.col("root").cast("decimal(38,0)"))).first()
        if state == seen:
            return roots
        seen = state
        up = roots.join(roots.select(F.col("node").alias("root"), F.col("root").alias("above")), "root").select(F.col("node").alias("b"), "above")
        roots = stored(both.join(up, "b").groupBy(F.col("a").alias("node")).agg(F.min("above").alias("root")), "roots")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for each row: documents whose fingerprints link, directly or over others, share root and component_id,
    the smallest doc_id of them.

    Null, empty and blank texts have fingerprint 0 and link like others. Rows with equal fingerprints meet as one before any comparison, so groups
    of copies cost nothing there. A null id never is a component's id unless no other is there (then null). Repeated rows stay. An empty
    table gives an empty result; further columns aren't read.
    """
    docs = fingerprints(docs, id_col, text_col, width)
    reps = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "representatives")
    roots = components(links(reps, radius)).withColumnRenamed("node", "fp")
    rooted = stored(reps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return docs.join(stored(rooted.join(ids, "root").select("fp", "root", "component_id"), "components"), "fp")


def smallest(docs: DataFrame, rooted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row for each root of rooted (doc_id, text_hash, root): that of its smallest id (null ids last, then the smallest text hash)."""
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"))).alias("k"))
    best = stored(best.select("k._id", "k._th"), "kept")
    again = rooted.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stored(again.select("_id", "_th"), "repeated")
    docs = without_clashes(docs, "_hash").withColumn("_hash", F.xxhash64(text_col))
    is_in = lambda keys: docs[id_col].eqNullSafe(keys["_id"]) & (docs["_hash"] == keys["_th"])
    if again.isEmpty():
        return docs.join(small(best), is_in(best), "left_semi").drop("_hash")
    # rows that repeat are shuffled to keep one of each, the others stay where they are
    best = stored(best.join(again.withColumn("many", F.lit(True)), best["_id"].eqNullSafe(again["_id"]) & (best["_th"] == again["_th"]), "left").select(best["_id"], best["_th"], "many"), "kept")
    once, many = best.where("many is null"), best.where("many")
    one = docs.join(small(many), is_in(many), "left_semi").dropDuplicates([id_col, "_hash"])
    return docs.join(small(once), is_in(once), "left_semi").unionByName(one).drop("_hash")


def deduplicated(docs: DataFrame, radius: int = 2, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of its smallest id (null ids last, then the smallest text hash)."""
    return smallest(docs, near_duplicates(docs, radius, width, id_col, text_col), id_col, text_col)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
