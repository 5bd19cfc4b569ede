"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer for every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches_of, stored, table
from .token_files import tokenizer_path, worker_encoder

#: Lengths that one window partition holds at most.
SPAN = 256


def lengths(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """(length,) of each whole text in tokens; 0 for null and empty ones."""
    path = path or tokenizer_path()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder(path)
        for b in batches_of(batches, 2048, keeps=True):
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 for x in encode(b.column(0))], pa.int64())], ["length"])

    return docs.select(text_col).mapInArrow(run, "length long")


def histogram(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """For each encoded length that occurs: length, docs, tokens (all of those documents), docs_at_least and tokens_at_least (of documents that long or longer),
    truncated_tokens (of all documents, each cut to length tokens), total_tokens and quantile (the share of documents that length or shorter).

    Documents are summed by length before anything is shuffled; suffix sums run over spans of 256 lengths and over the spans' own sums, so neither grows
    with the documents. Null and empty texts have length 0; repeated rows count each. An empty table gives an empty result; other columns aren't read.
    """
    counts = lengths(docs, path, text_col).groupBy("length").agg(F.count(F.lit(1)).alias("docs"))
    counts = stored(counts.withColumns({"tokens": F.col("length") * F.col("docs"), "_span": F.floor(F.col("length") / SPAN)}), "lengths")
    spans = counts.groupBy("_span").agg(F.sum("docs").alias("_d"), F.sum("tokens").alias("_t"))
    after = Window.orderBy(F.desc("_span"))  # a row for each span of lengths
    everything = Window.partitionBy()
    spans = spans.select("_span", (F.sum("_d").over(after) - F.col("_d")).alias("_d_after"), (F.sum("_t").over(after) - F.col("_t")).alias("_t_after"), F.sum("_d").over(everything).alias("_all"), F.sum("_t").over(everything).alias("total_tokens"))
    within = Window.partitionBy("_span").orderBy(F.desc("length"))
    out = counts.join(spans, "_span")
    out = out.withColumns({"docs_at_least": F.sum("docs").over(within) + F.col("_d_after"), "tokens_at_least": F.sum("tokens").over(within) + F.col("_t_after")})
    cut = F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    below = F.col("_all") - F.col("docs_at_least") + F.col("docs")
    return out.withColumns({"truncated_tokens": cut, "quantile": below / F.col("_all")}).select("length", "docs", "tokens", "docs_at_least", "tokens_at_least", "truncated_tokens", "total_tokens", "quantile")


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_over, truncated_tokens) for any limits, from the suffix sums alone: those of the least length over a limit say all about longer documents. One pass over the histogram,
    whatever the limits; without documents all numbers are 0."""
    sums = F.struct("length", "docs_at_least", "tokens_at_least")
    found = hist.agg(F.max("total_tokens").alias("total"), *[F.min(F.when(F.col("length") > x, sums)).alias(f"over{i}") for i, x in enumerate(limits)])
    zero = F.lit(0).cast("long")

    def at(i: int, x: int):
        over, total = F.col(f"over{i}"), F.coalesce("total", zero)
        cut = F.when(over.isNull(), total).otherwise(total - over["tokens_at_least"] + F.lit(x).cast("long") * over["docs_at_least"])
        return F.struct(F.lit(x).cast("long").alias("context_limit"), F.coalesce(over["docs_at_least"], zero).alias("docs_over"), cut.alias("truncated_tokens"))

    return found.select(F.inline(F.array(*[at(i, x) for i, x in enumerate(limits)])))


def quantile(hist: DataFrame, q: float) -> int | None:
    """The least length that at least the share q of the documents don't exceed; None without documents."""
    return hist.where(F.col("quantile") >= q).agg(F.min("length")).first()[0]


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(table(spark, sf_dir, "documents"))
