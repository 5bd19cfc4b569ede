"""Line dedup: lines that stand in many documents are dropped from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, small, stored, table, without_clashes


#: Line numbers, four bytes each, that the broadcast side may hold in all.
BROADCAST_POSITIONS = 2_000_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hash(line: Column, min_chars: int) -> Column:
    """MD5, 16 bytes, of the line's key; null if the key is too short."""
    key = ascii_lower(F.btrim(line, F.lit(SPACES)))
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key.cast("binary"))))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs plus n_lines, n_dropped and kept (the text without the dropped lines).

    A line's key is the line without white space at its ends, with A-Z lower-cased. Keys of at least min_chars code points that stand in at
    least min_docs documents (each counts once, however often it repeats the line) lose all their lines.

    A null text is one empty line, as is an empty one. A null id is an id like any other. Rows that repeat both id and text are one document when
    documents are counted, and each is cleaned. If all lines go, kept is empty. Columns of docs named like the new ones are replaced. An empty table
    gives an empty result.

    Texts are read twice, to hash the lines and to put the rest together; only hashes and positions are shuffled, and texts only if
    the positions to drop are too many to be broadcast. A line that stands everywhere is one row a document, spread over all partitions by its documents;
    counting it is a sum of partial counts.
    """
    docs = without_clashes(docs, "n_lines", "n_dropped", "kept", "_row", "_at")
    text = F.col(text_col)
    row = F.unhex(F.md5(F.concat_ws("\x00", F.col(id_col).isNull().cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary")))
    lines = docs.select(row.alias("_row"), F.posexplode(_lines(text)).alias("_at", "_line")).select("_row", "_at", _hash(F.col("_line"), min_chars).alias("_hash"))
    lines = stored(lines.where("_hash is not null").groupBy("_hash", "_row").agg(F.collect_list("_at").alias("_at")), "lines")
    common = stored(lines.groupBy("_hash").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") >= min_docs).select("_hash"), "common-lines")
    dropped = lines.join(small(common), "_hash").groupBy("_row").agg(F.sort_array(F.flatten(F.collect_list("_at"))).alias("_at"))
    dropped = stored(dropped, "dropped-lines")
    positions = dropped.agg(F.coalesce(F.sum(F.size("_at")), F.lit(0))).first()[0]
    dropped = small(dropped) if positions <= BROADCAST_POSITIONS else dropped
    lines, n = _lines(text), F.size(_lines(text))
    ends = F.concat(F.array(F.lit(-1)), F.col("_at"), F.array(n))
    runs = F.transform(F.sequence(F.lit(0), F.size("_at")), lambda i: F.slice(F.col("_lines"), F.get(F.col("_ends"), i) + 2, F.get(F.col("_ends"), i + 1) - F.get(F.col("_ends"), i) - 1))
    return (
        docs.withColumn("_row", row)
        .join(dropped, "_row", "left")
        .withColumns({"_lines": lines, "_ends": ends})
        .withColumns({
            "n_lines": n.cast("long"),
            "n_dropped": F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.size("_at")).cast("long"),
            "kept": F.when(F.col("_at").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n")),
        })
        .drop("_row", "_at", "_lines", "_ends")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY doc_id
"""
