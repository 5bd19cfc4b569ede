"""Near copies by the exact similarity of texts: operator 9 and bands of MinHash propose pairs, and each is checked on its texts' word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, small, stored
from .simhash import CHUNK, SEED, components, fingerprint, links, smallest

#: Two texts of similarity s meet in a band with probability s**ROWS: at 0.8 all bands miss them once in 38,000 pairs.
BANDS, ROWS = 20, 4
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Members of a bucket whose pairs are listed one by one; larger buckets are compared in blocks of about so many members or hashes of shingles.
FEW, BLOCK_ROWS, BLOCK_HASHES = 24, 512, 1 << 18
#: Members from which on a bucket's blocks meet pivots before each other, and how many pivots.
BIG, PIVOTS = 8192, 4


def shingles(text: bytes | None, width: int = 5) -> set[bytes]:
    """Runs of width words; all words of a shorter text; nothing for a text without words. ASCII case doesn't count."""
    words = (text or b"").lower().split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def similarity(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def sketch(text: bytes | None, width: int = 5) -> tuple[int, int, list[int]]:
    """(hash of the set of shingles, its size, a key for each band); a text without words has no keys."""
    found = shingles(text, width)
    if not found:
        return 0, 0, []
    h = np.unique(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), np.uint64))
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(h), CHUNK >> 3):
        least = np.minimum(least, (h[None, a : a + (CHUNK >> 3)] * FACTORS[:, None]).min(1))
    keys = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))]
    node, *keys = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED), *keys], np.uint64).view(np.int64).tolist()
    return node, len(found), keys


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, text_hash, fp, node, size, keys) of each row, stored. Equal sets of shingles are one node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 256):
            texts = b.column(2).to_pylist()
            node, size, keys = zip(*(sketch(x, width) for x in texts), strict=True) if texts else ((), (), ())
            columns = [b.column(0), b.column(1), pa.array([fingerprint(x, width) for x in texts], pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "fp", "node", "size", "keys"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).cast("binary").alias("text"))
    return stored(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long, node long, size long, keys array<long>"), "sketches")


def compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """pairs (a, b) of nodes plus their similarity, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, set[bytes]] = (None, set())
        for batch in batches_of(batches, 256):
            out = []
            for a, _, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != last[0]:
                    last = (a, shingles(x, width))
                out.append(similarity(last[1], shingles(y, width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    x = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return stored(x.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, similarity double"), "compared")


def hash_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, h) with the sorted 64-bit hashes of each text's different shingles, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, 64):
            h = [np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles(x, width), repeat(SEED)), np.uint64)).view(np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.list_(pa.int64()))], ["node", "h"])

    return stored(texts.select("node", "text").mapInArrow(run, "node long, h array<long>"), "hash-sets")


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a forest that joins what a symmetric matrix of pairs joins."""
    left, edges = np.ones(len(near), bool), []
    for root in range(len(near)):
        if left[root]:
            left[root], todo = False, np.array([root])
            while len(todo):
                todo = np.flatnonzero(near[todo].any(0) & left)
                left[todo] = False
                edges += [(int(x), root) for x in todo]
    return edges


def shared(nodes: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many hashes any two of the sets (one after the other in hashes) share: products of 0/1 matrices over the hashes that more than one of them has."""
    row = np.repeat(np.arange(len(nodes)), sizes)
    _, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
    common = np.flatnonzero(n > 1)
    place = np.full(len(n), -1)
    place[common] = np.arange(len(common))
    column, both = place[at], np.zeros((len(nodes), len(nodes)), np.float32)
    for a in range(0, len(common), 4096):
        use = (column >= a) & (column < a + 4096)
        part = np.zeros((len(nodes), min(4096, len(common) - a)), np.float32)
        part[row[use], column[use] - a] = 1
        both += part @ part.T  # whole numbers below 2**24
    return both


def in_blocks(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b), stored: links between the members of each row's two blocks (nodes, sizes, h and nodes2, sizes2, h2; the second is null where a block meets itself). Not all
    links, but as many as join the same members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = [np.concatenate([np.asarray(batch.column(f"{n}{k}")[i].values) for k in ("", "2") if batch.column(f"{n}{k}")[i].is_valid]) for n in ("nodes", "sizes", "h")]
                nodes, sizes, _ = held
                both = shared(*held)
                near = both >= least * (sizes[:, None] + sizes[None, :] - both) - 1e-6
                near &= nodes[:, None] != nodes[None, :]
                made = forest(near)
                if made:
                    a, b = np.array(made).T
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    columns = [f"{n}{k}" for k in ("", "2") for n in ("nodes", "sizes", "h")]
    return stored(pairs.select(*columns).mapInArrow(run, "a long, b long"), "block-links")


def blocks_of(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, part, nodes, sizes, h), stored: the members of each bucket (bucket, node, n, hashes, core), dealt into blocks by a hash; those of its core into blocks of their own."""
    parts = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("hashes") / BLOCK_HASHES))
    part = F.pmod(F.xxhash64(F.lit(5), "node"), parts)
    each = members.select("bucket", "node", F.when(F.col("core"), -1 - part).otherwise(part).alias("part")).join(sets, "node")
    one = each.groupBy("bucket", "part").agg(F.collect_list(F.struct("node", F.size("h").cast("long").alias("size"), "h")).alias("x"))
    return stored(one.select("bucket", "part", F.col("x.node").alias("nodes"), F.col("x.size").alias("sizes"), F.flatten("x.h").alias("h")), "blocks")


def linked_in_blocks(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join all members (bucket, node, n, hashes) of each bucket that pairs of at least the similarity join.

    A bucket of many members first meets a few of them, which is linear and finds its core: the members that are joined by then. Core blocks needn't meet each other."""
    links, members = None, members.withColumn("core", F.lit(False))
    second = lambda df: df.select("bucket", F.col("part").alias("part2"), F.col("nodes").alias("nodes2"), F.col("sizes").alias("sizes2"), F.col("h").alias("h2"))
    for k in range(PIVOTS):
        big = members.where(F.col("n") > BIG)
        if big.isEmpty():
            break
        pivots = big.where("not core").groupBy("bucket").agg(F.min_by("node", F.xxhash64(F.lit(k), "node")).alias("node")).join(sets, "node")
        pivots = pivots.select("bucket", F.array("node").alias("nodes2"), F.array(F.size("h").cast("long")).alias("sizes2"), F.col("h").alias("h2"))
        new = in_blocks(blocks_of(big, sets).join(pivots, "bucket"), least)
        links = new if links is None else links.unionByName(new)
        comps = members.drop("core").join(components(links), "node", "left").withColumn("comp", F.coalesce("root", "node"))
        comps = stored(comps.select(*[c for c in members.columns if c != "core"], "comp"), "members")
        core = comps.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("_n")).groupBy("bucket").agg(F.max_by("comp", F.struct("_n", "comp")).alias("_core"))
        members = stored(comps.join(core, "bucket").withColumn("core", (F.col("comp") == F.col("_core")) & (F.col("n") > BIG)).drop("comp", "_core"), "members")
    blocks = blocks_of(members, sets)
    names = blocks.select("bucket", "part")
    names = names.join(names.withColumnRenamed("part", "part2"), "bucket").where("part < part2 and part2 >= 0")
    apart = names.join(blocks, ["bucket", "part"]).join(second(blocks), ["bucket", "part2"]).drop("part2")
    alone = blocks.where("part >= 0").select("*", *[F.lit(None).cast("array<long>").alias(n) for n in ("nodes2", "sizes2", "h2")])
    new = in_blocks(alone.unionByName(apart), least)
    return new if links is None else links.unionByName(new)


def linked(members: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """(node, root) of the nodes that pairs of at least the similarity join, directly or over others, among all pairs that share a bucket (members: bucket,
    node, size, n, hashes). Small buckets list their pairs, each different one is compared on its texts; in large ones blocks of members meet, on hashes of their shingles."""
    few = members.where(F.col("n") <= FEW)
    other = few.select("bucket", F.col("node").alias("_node"), F.col("size").alias("_size"))
    # sizes that differ more can't be so alike
    fits = (F.col("node") < F.col("_node")) & (F.least("size", "_size") >= F.greatest("size", "_size") * (least - 1e-9))
    pairs = few.join(other, "bucket").where(fits).select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct()
    found = compared(pairs, texts, width).where(F.col("similarity") >= least).select("a", "b")
    many = members.where(F.col("n") > FEW).drop("size")
    if not many.isEmpty():
        sets = hash_sets(texts.join(many.select("node").distinct(), "node", "left_semi"), width)
        found = found.unionByName(linked_in_blocks(many, sets, least))
    return components(found)


def near_copies(docs: DataFrame, least: float = 0.8, width: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, root) for each row: documents whose sets of shingles have at least the Jaccard similarity, directly or over others, share root.

    Candidates are operator 9's components and bands of MinHash; no link stands without a comparison. Texts without words are one group."""
    rows = sketches(docs, id_col, text_col, width)
    key = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"))
    nodes = stored(rows.groupBy("node").agg(F.min(key).alias("k"), F.first("size").alias("size"), F.first("keys").alias("keys")), "nodes")
    prints = stored(rows.where("size > 0").select("node", "size", "fp").distinct(), "prints")
    near = components(links(stored(prints.select("fp").distinct(), "representatives"), radius)).select(F.col("node").alias("fp"), "root")
    by_print = prints.join(near, "fp", "left").select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("bucket"), "node", "size")
    every = stored(nodes.select(F.explode("keys").alias("bucket"), "node", "size").unionByName(by_print.distinct()), "buckets")
    sizes = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("hashes")).where("n > 1")
    members = stored(every.join(sizes, "bucket"), "shared-buckets")
    wanted = stored(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "k._id", "k._th"), "wanted")
    d = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).cast("binary").alias("text"))
    texts = stored(d.join(small(wanted), d["_doc"].eqNullSafe(wanted["_id"]) & (d["_hash"] == wanted["_th"])).select("node", "text").dropDuplicates(["node"]), "texts")
    roots = linked(members, texts, least, width)
    return rows.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def deduplicated(docs: DataFrame, least: float = 0.8, width: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: that of its smallest id (null ids last, then the smallest text hash)."""
    return smallest(docs, near_copies(docs, least, width, radius, id_col, text_col), id_col, text_col)
