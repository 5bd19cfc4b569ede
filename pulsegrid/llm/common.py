"""What the operators share: tables, shared storage, checked broadcasts, ASCII case folding."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.sources.shared import new_folder, ranked, shared_dir, stored

__all__ = ["aside", "ascii_lower", "batches_of", "held_out", "kept_by_worker", "new_folder", "ranked", "shared_dir", "small", "stored", "table", "without_clashes"]

#: Rows that a broadcast side may have; such sides are narrow (under 100 bytes a row).
BROADCAST_ROWS = 300_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The white space of the texts' words and lines: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; otherwise as it is, for a shuffled join that AQE can split where it is skewed. df should be stored() already, so that counting it is cheap."""
    return F.broadcast(df) if df.count() <= rows else df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() does just that, and fast, unless there are other letters with a lower case."""
    others = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).when(~others, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def batches_of(batches: Iterator[pa.RecordBatch], rows: int, keeps: bool = False) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many rows, which share the memory of those that Spark sends; without the session's options, which hold for others too. Unless the task keeps something by its
    worker, what earlier stages left there is given back first."""
    if not keeps:
        forget()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        pa.default_memory_pool().release_unused()  # a worker lives on through later stages
    trim()


def _kept() -> dict[str, Any]:
    return sys.modules.setdefault("pulsegrid_worker", types.ModuleType("pulsegrid_worker")).__dict__


def trim() -> None:
    """Gives free memory back to the system, where the allocator can: idle workers stay beside those of later stages."""
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def forget() -> None:
    """Drops what the worker keeps."""
    names = [n for n in _kept() if not n.startswith("__")]
    if names:
        for n in names:
            del _kept()[n]
        gc.collect()
        trim()


def kept_by_worker(name: str, make: Callable[[], Any]) -> Any:
    """What make() gives, made once for each Python worker: later tasks of the worker find it again, until a task keeps something else or nothing. A global of this package doesn't last (measured on PySpark 4.1:
    every task finds it as it was when the package was imported), a module of its own does."""
    kept = _kept()
    if name not in kept:
        forget()
        kept[name] = make()
    return kept[name]


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 0 when divided by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def without_clashes(df: DataFrame, *names: str) -> DataFrame:
    """df without columns named like those that an operator is about to add (whatever their case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def aside(docs: DataFrame, needed: tuple[str, ...] = ("doc_id", "text", "lang", "source")) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(docs with all columns but those needed under names that no operator uses, what gives a result its own columns back). So a column keeps its values even if an
    operator adds one of its name."""
    names = [c if c in needed else f"_aside{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda out: out.select(*names).toDF(*docs.columns)
