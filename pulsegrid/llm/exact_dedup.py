"""Exact dedup with an extendible-hash index in shared files.

Tasks read the texts and keep each different one of theirs once: an entry, with the 64-bit hash of the normalised text as its key. The entries' keys fill the buckets of an extendible-hash index: as long as a
bucket holds too many different keys, the directory is doubled and the bucket split by the next bit of the key. Buckets are ranges of keys; owner tasks process them, chain entries of one
key, and compare their bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, batches_of, small, stored, table

#: Different keys that a bucket holds at most, unless it can't be split further, and key ranges that owner tasks take for each shuffle partition.
CAPACITY, RANGES = 256, 4
#: Bytes of texts that a task remembers while it looks for copies, and rows that it takes at once.
REMEMBERED, ROWS = 64 << 20, 1024
#: A row's number: its task's number times this, plus its place there.
TASK = 1 << 36
#: What the index holds of an entry, besides the first entry of the same bytes.
OWNED = ["bucket", "key", "entry", "top_id", "top_at", "n", "sha256"]
FOUND = "entry long, at long, doc_id long, top_id long, top_at long, n long, key long, sha256 string, text binary"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members (entry, at, doc_id) of every row and one entry (entry, the largest id and its row, n, key, sha256, text) for each different text, as long as it is remembered."""
    from pyspark import TaskContext

    schema = pa.schema([("entry", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("top_id", pa.int64()), ("top_at", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("sha256", pa.string()), ("text", pa.binary())])
    at = TaskContext.get().partitionId() * TASK
    chains: dict[int, list[list]] = {}  # key: [entry, text, top id, top row, n] of each text with that key
    held = 0

    def entries() -> Iterator[pa.RecordBatch]:
        some = [(e[0], e[2], e[3], e[4], key, hashlib.sha256(e[1]).hexdigest(), e[1]) for key, chain in chains.items() for e in chain]
        for k in range(0, len(some), ROWS):
            entry, top, top_at, n, key, sha, text = (list(x) for x in zip(*some[k : k + ROWS], strict=True))
            none = [None] * len(entry)
            columns = [entry, none, none, top, top_at, n, key, sha, text]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for b in batches_of(batches, ROWS):
        members = []
        for doc_id, key, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
            chain = chains.setdefault(key, [])
            found = next((e for e in chain if e[1] == text), None)  # bytes
            if found is None:
                found = [at, text, doc_id, at, 0]
                chain.append(found)
                held += len(text) + 200
            found[4] += 1
            if doc_id is not None and (found[2] is None or doc_id >= found[2]):
                found[2], found[3] = doc_id, at
            members.append(found[0])
            at += 1
        n = len(members)
        none = {f.name: pa.nulls(n, f.type) for f in schema}
        columns = none | {"entry": pa.array(members, pa.int64()), "at": pa.array(range(at - n, at), pa.int64()), "doc_id": b.column("doc_id")}
        yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], schema=schema)
        if held > REMEMBERED:
            yield from entries()
            chains, held = {}, 0
    yield from entries()


def directory(keys: DataFrame, n: int, capacity: int = CAPACITY, bits: int | None = None) -> tuple[DataFrame, int]:
    """((slot, depth, bucket) for every slot of the directory that holds a key, bits of a slot) of n different keys.

    A slot is a key's first bits. Of depth 0 all keys are one bucket; each doubling takes one more bit and splits the buckets that hold more than `capacity` keys. So a slot's bucket, named by its first slot, is the
    shortest prefix that holds no more than that. Keys are hashes, so two bits beyond the mean depth leave room enough; a bucket that is still overfull after all of them stays so, and its owner
    reads on. The directory has at most eight slots for each `capacity` keys.
    """
    bits = bits or min(40, max(1, math.ceil(math.log2(max(1, n / capacity))) + 2))
    slots = keys.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("slot")).agg(F.count(F.lit(1)).alias("_n"))
    slots = stored(slots, "slots")
    doubled = slots.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    first = F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)")
    doubled = doubled.withColumn("bucket", first)
    sizes = doubled.groupBy("depth", "bucket").agg(F.sum("_n").alias("_keys"))
    fits = sizes.where((F.col("_keys") <= capacity) | (F.col("depth") == bits)).select("depth", "bucket")
    held = doubled.join(fits, ["depth", "bucket"]).groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("b"))
    return stored(held.select("slot", F.col("b.depth").alias("depth"), F.col("b.bucket").alias("bucket")), "directory"), bits


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, same): same is the first entry of those with the same bytes. Entries come sorted by bucket and key, so a key's chain is all that is held; entries whose key is theirs alone come without text."""
    key, chain = None, []
    for b in batches_of(batches, ROWS):
        out = []
        for k, entry, text in zip(*(b.column(c).to_pylist() for c in ("key", "entry", "text")), strict=True):
            if k != key:
                key, chain = k, []
            same = next((e for e, t in chain if t == text), None)
            if same is None:
                same = entry
                chain.append((entry, text))
            out.append(same)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in OWNED), pa.array(out, pa.int64())], [*OWNED, "same"])


def index(docs: DataFrame, capacity: int = CAPACITY, normalise: Callable = ascii_lower, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(a row for each row of docs: entry, at, doc_id; the index's entries: bucket, key, entry, same, top_id, top_at, n, sha256), both in the shared folder.

    Only texts whose key another entry has as well are shuffled, each once for each task that met it (and for each 64 MB of texts that the task went through); all other entries go as keys.
    """
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    found = stored(rows.mapInArrow(_local, FOUND), "texts")
    entries = found.where("at is null")
    keys = stored(entries.groupBy("key").agg(F.count(F.lit(1)).alias("_entries")), "keys")
    slots, bits = directory(keys, keys.count(), capacity)
    shared = stored(keys.where("_entries > 1").select("key"), "shared-keys")
    chained = entries.join(small(shared), "key", "left_semi")  # no more entries have one key than there are tasks, so none is hot
    alone = entries.withColumn("text", F.lit(None).cast("binary")).join(small(shared), "key", "left_anti")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = max(0, bits - math.ceil(math.log2(n * RANGES)))  # equal ranges of keys, of one slot at least
    both = chained.unionByName(alone).withColumn("slot", F.shiftrightunsigned("key", 64 - bits)).join(small(slots.select("slot", "bucket")), "slot")
    owned = both.withColumn("_owner", F.shiftright("bucket", step)).repartition(n, "_owner").sortWithinPartitions("bucket", "key", "entry").select(*OWNED, "text")
    made = stored(owned.mapInArrow(_chained, "bucket long, key long, entry long, top_id long, top_at long, n long, sha256 string, same long"), "index")
    return found.where("at is not null").select("entry", "at", "doc_id"), made


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, normalise: Callable = ascii_lower, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, keep_id (the largest id of its group of equal texts), group_size, kept (true for one row of the group, with that id) and text_sha256 (of the normalised text).

    Texts are equal when they are after normalise(); a null text is an empty one. Null ids come before all others. Rows that repeat an id and a text count each, and one of them is kept. Very long
    texts are read whole. Further columns aren't read. An empty table gives an empty result.

    However many copies a text has, each task makes one entry of its copies, so no key, join or group holds more rows than there are tasks and rows of a task.
    """
    members, entries = index(docs, capacity, normalise, id_col, text_col)
    top = F.max(F.struct(F.col("top_id").alias("id"), F.col("top_at").alias("at")))
    groups = stored(entries.groupBy("same").agg(top.alias("top"), F.sum("n").alias("group_size")), "groups")
    known = entries.select("entry", "same", F.col("sha256").alias("text_sha256")).join(groups, "same").drop("same")
    return members.join(known, "entry").select("doc_id", F.col("top.id").alias("keep_id"), "group_size", (F.col("at") == F.col("top.at")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, normalise: Callable = ascii_lower, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, that with the largest id; all columns as they were. See exact_groups()."""
    names = [f"_own{i}" for i in range(len(docs.columns))]
    key, text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    rows = stored(docs.toDF(*names).withColumn("_row", F.monotonically_increasing_id()), "rows")
    # the row's number stands for the id: the last of the rows in the order of their ids
    groups = exact_groups(rows.select(F.col("_row").alias("doc_id"), text.alias("text")), normalise=normalise)
    groups = groups.join(rows.select(F.col("_row").alias("doc_id"), key.cast("long").alias("_id")), "doc_id")
    best = groups.groupBy("keep_id").agg(F.max(F.struct("_id", "doc_id")).alias("b")).select(F.col("b.doc_id").alias("_row"))
    return rows.join(small(stored(best, "kept")), "_row", "left_semi").drop("_row").toDF(*docs.columns)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH plain AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), grouped AS (
  SELECT doc_id, text, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) AS k
  FROM plain WINDOW g AS (PARTITION BY text)
)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(text) AS text_sha256 FROM grouped
"""
