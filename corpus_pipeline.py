"""The corpus pipeline: five stages, each on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import decontamination, langid, mixing, near_copies, token_files
from pulsegrid.llm.common import aside, new_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no language (null, empty and letterless texts). The model is learnt from the stage's own input. Repeated rows and null ids stay; an empty table stays empty."""
    rows, back = aside(docs)
    return back(langid.identify(rows, langid.trained(rows)).where(f"lang_pred <> '{langid.UNDETERMINED}'"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: five-word similarity of at least 0.8, checked on the texts. Null ids come last, of repeated rows one stays, texts without words are
    one group; an empty table stays empty."""
    rows, back = aside(docs)
    return back(near_copies.deduplicated(rows, least=0.8, width=5))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item's window occurs. Null and empty texts and items have no windows; repeated rows share their fate; without items all stay."""
    rows, back = aside(docs)
    return back(decontamination.decontaminated(rows, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that the sources' words come near their targets. A null source is one of its own; rows that repeat an id share their fate; an empty table stays empty."""
    rows, back = aside(docs)
    return back(mixing.repeated(mixing.mix(rows), rows.columns))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and returns what stands in them: a row for each document, repeated ones and those without an id too; null and empty texts are an end id alone."""
    return token_files.encoded(docs, keep=40_000, rows_at_once=1024)  # workers and their JVM come from four stages before: less memory, more time


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", token_output),
]
#: SQL can express neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
