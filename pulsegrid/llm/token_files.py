"""Token-ID output: files of independent zstandard frames with a trailing seek table and a checksum for each frame.

A file is: one frame for each document (its ids as little-endian unsigned 32-bit integers), a skippable frame with the documents' ids, and
a skippable frame with the seek table, as in the public zstandard seekable format. Any zstandard program reads such a file as one
stream of ids; SeekableTokens reads the tables at its end and then only the frames asked for.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, kept_by_worker, new_folder, stored, table

#: Fixed values of the zstandard seekable format: magic numbers of the skippable frame and the footer; the flag for checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: The skippable frame that holds the documents' ids.
ID_FRAME = 0x184D2A50
NO_ID = -(1 << 63)
FILE_BYTES = 128 << 20
END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Where a text may be cut besides white space: between a letter or digit and the marks that end its word, which are tokens of their own.
MARKS = r"([A-Za-z0-9])([.,;:!?*#$%&|]+)(\s)"
#: Words that a worker remembers beyond a batch (twice as many at most), and texts in a batch: less of both takes less memory and more time.
KEEP, ROWS = 150_000, 2048
#: Longer words aren't remembered.
LONG_WORD = 64
#: A special token of the vocabulary.
BETWEEN = "<|startoftext|>"


class Encoder:
    """Ids of whole texts, as little-endian 32-bit integers.

    This vocabulary's tokenizer lower-cases, and splits at white space and between letters and marks before it merges; so a batch's words are encoded one by one, each different one once while it is remembered:
    the last batch's new words, and those that came again, about twice `keep` at most. Arrow splits the texts and numbers the different words; numpy puts their ids together.
    """

    def __init__(self, path: str, keep: int = KEEP):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep, self.recent, self.older, self.lately = Tokenizer.from_file(path), keep, {}, {}, {}
        self.between = self.tokenizer.token_to_id(BETWEEN)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """One string of ids for each text; null texts have none."""
        texts = pc.fill_null(texts, "")
        # fewer different words; the tokenizer itself lower-cases what is no special token, so where one may stand it's left to that
        plain = texts if pc.any(pc.match_substring(texts, "<|")).as_py() else pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, MARKS, r"\1 \2\3"))  # ASCII only
        named = words.values.dictionary_encode()
        ids = self.words(named.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, starts, at = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes, named.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = pool[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        cut = (4 * ends[words.offsets.to_numpy()]).tolist()
        del texts, plain, words, named
        pa.default_memory_pool().release_unused()  # else a worker keeps its largest batch's memory through later stages
        return [out[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of different words. A word is remembered for one batch; if it comes again, longer: most words never do."""
        found = list(map(self.recent.get, words))
        lacking = [w for w, x in zip(words, found, strict=True) if x is None]
        if lacking:
            again = {w: x for w in lacking if (x := self.older.get(w, self.lately.get(w))) is not None}
            new = [w for w in lacking if w not in again]
            made: dict[str, bytes] = {}
            for i in range(0, len(new), 5000):
                made.update(self._encode(new[i : i + 5000]))
            found = [again[w] if w in again else made[w] if x is None else x for w, x in zip(words, found, strict=True)]
            self.lately = made if max(map(len, made), default=0) <= LONG_WORD else {w: x for w, x in made.items() if len(w) <= LONG_WORD}
            self.recent |= again
            if len(self.recent) > self.keep:
                self.older, self.recent = self.recent, {}
        return found

    def _encode(self, words: list[str]) -> list[tuple[str, bytes]]:
        """All words as one text. Words of letters alone are parted by spaces, the tokenizer says which word each id is of; others by a special token, and words that could hold one
        themselves go alone."""
        letters = [w for w in words if w.isalpha()]
        if len(letters) > 1:
            coded = self.tokenizer.encode(" ".join(letters), add_special_tokens=False)
            of, raw = np.array(coded.word_ids), np.array(coded.ids, "<u4").tobytes()
            edges = np.flatnonzero(of[1:] != of[:-1]) + 1
            if len(edges) + 1 == len(letters):
                cut = [0, *(4 * edges).tolist(), len(raw)]
                made = list(zip(letters, [raw[a:b] for a, b in itertools.pairwise(cut)], strict=True))
                return made + (self._encode(others) if (others := [w for w in words if not w.isalpha()]) else [])
        alone = [w for w in words if "<|" in w]
        out = [(w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in alone]
        if len(alone) < len(words):
            words = [w for w in words if "<|" not in w]
            ids = np.array(self.tokenizer.encode_batch_fast([BETWEEN.join(words)], add_special_tokens=False)[0].ids, "<u4")
            cut, raw = (4 * np.flatnonzero(ids == self.between)).tolist(), ids.tobytes()
            out += zip(words, [raw[a:b] for a, b in zip([0, *[c + 4 for c in cut]], [*cut, len(raw)], strict=True)], strict=True)
        return out


def worker_encoder(path: str, keep: int = KEEP) -> Encoder:
    """The encoder of this Python worker, which later tasks of the worker find again."""
    return kept_by_worker(f"encoder of {path}, {keep}", lambda: Encoder(path, keep))


class _File:
    def __init__(self, fs: pafs.FileSystem, folder: str, name: str):
        self.fs, self.path, self.temp = fs, f"{folder}/{name}", f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.out, self.size, self.ids, self.entries, self.tokens = fs.open_output_stream(self.temp), 0, [], [], 0

    def add(self, doc_id: int | None, raw: bytes, frame: bytes) -> None:
        self.out.write(frame)
        self.size += len(frame)
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.entries.append(struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.tokens += len(raw) // 4

    def close(self) -> None:
        ids = struct.pack(f"<{len(self.ids)}q", *self.ids)
        self.out.write(struct.pack("<II", ID_FRAME, len(ids)) + ids)
        seek = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(seek)) + seek)
        self.out.close()
        self.fs.move(self.temp, self.path)  # whole files only; a task that runs again puts the same file there


class SeekableTokens:
    """Reads documents of one file by their place in it; decompresses nothing else."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file, size = fs.open_input_file(path), fs.get_file_info(path).size
        self.file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        table_at = size - 9 - 12 * n - 8
        self.file.seek(table_at)
        head, length = struct.unpack("<II", self.file.read(8))
        if head != SKIPPABLE or length != 12 * n + 9:
            raise ValueError(f"{uri}: damaged seek table")
        self.entries = list(struct.iter_unpack("<III", self.file.read(12 * n)))
        self.file.seek(table_at - 8 * n)
        self.doc_ids = [None if x == NO_ID else x for x in struct.unpack(f"<{n}q", self.file.read(8 * n))]
        self.starts, at = [], 0
        for size, _, _ in self.entries:
            self.starts.append(at)
            at += size
        self.unzip = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.entries)

    def raw(self, i: int) -> bytes:
        size, length, check = self.entries[i]
        self.file.seek(self.starts[i])
        raw = self.unzip.decompress(self.file.read(size), max_output_size=length) if length else b""
        if len(raw) != length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return raw

    def ids(self, i: int) -> list[int]:
        raw = self.raw(i)
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP, rows_at_once: int = ROWS) -> DataFrame:
    """Encodes every text, appends end_id, and writes the ids in ascending id order as files under folder (a URI that driver and executors
    share). Returns the stored manifest: (part, seq, uri, docs, tokens), a row for each file, in the order of (part, seq).

    Null and empty texts have end_id alone. Null ids come first. Rows that repeat an id stand beside each other, in the order of a hash of their texts; each
    has a frame of its own. Other columns aren't read. No documents: no files. A range of ids is one task; its file is closed and the next begun
    at 128 MB, and a task never holds more than a batch of texts.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        part, encode, zip_, out, done = TaskContext.get().partitionId(), worker_encoder(path, keep), zstandard.ZstdCompressor(level=1), None, []
        end = struct.pack("<I", end_id)

        def close() -> None:
            out.close()
            done.append((part, len(done), f"{folder}/{part:06d}-{len(done):04d}.zst", len(out.ids), out.tokens))

        for batch in batches_of(batches, rows_at_once, keeps=True):
            for doc_id, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                if out is None:
                    fs.create_dir(root)
                    out = _File(fs, root, f"{part:06d}-{len(done):04d}.zst")
                raw += end
                out.add(doc_id, raw, zip_.compress(raw))
                if out.size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["part", "seq", "uri", "docs", "tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))  # so rows without an id, or with the same, fill several tasks
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_id", "_hash").sortWithinPartitions("_id", "_hash").drop("_hash")
    return stored(rows.mapInArrow(write, "part long, seq long, uri string, docs long, tokens long"), "manifest")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, and its ids if asked for; checks every frame. start counts the ids
    of all documents before it, over all files."""
    spark = manifest.sparkSession
    order = Window.orderBy("part", "seq")  # a row for each file
    files = manifest.withColumn("start", F.sum("tokens").over(order) - F.col("tokens"))
    files = files.select("uri", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uri")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                f = SeekableTokens(uri)
                for a in range(0, len(f), 1000):
                    rows = []
                    for i in range(a, min(a + 1000, len(f))):
                        raw = f.raw(i)
                        rows.append((f.doc_ids[i], start, len(raw) // 4, zlib.crc32(raw), *([struct.unpack(f"<{len(raw) // 4}I", raw)] if with_ids else [])))
                        start += len(raw) // 4
                    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
                    yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def encoded(docs: DataFrame, keep: int = KEEP, rows_at_once: int = ROWS) -> DataFrame:
    """Writes docs as token files in the shared folder and reads them back."""
    return read_token_files(write_token_files(docs, new_folder(docs.sparkSession, "tokens"), keep=keep, rows_at_once=rows_at_once))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
