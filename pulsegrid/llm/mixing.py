"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranked, small, stored, table, without_clashes

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of a document's hash that name its bucket: 4,096 buckets a source.
DIGITS = 3


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(id_col: str, seed: int) -> Column:
    """A document's place in the seeded order of its source."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def water_level(sources: DataFrame, total: float) -> float | None:
    """The level at which sources (weight, cap) give total: each gets weight * level, or its cap if that is less. None: all stand at their caps.

    Sources over their cap are clamped and what they can't take is shared out again by weight, until none is over. A round is one aggregate
    over the sources; the level only rises, so a round needs no more than the last level.
    """
    level, clamped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > F.col("cap")
        n, caps, weights = sources.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if not weights:
            return None
        if n == clamped:
            return level
        clamped, level = n, (total - float(caps)) / float(weights)


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs plus size (its words), source_size, target (of its source, in words), reps (how often the mix takes it) and taken (reps * size).

    Sources in code-point order, null last, get the weights in turn, and together share * all sizes; a target stops at max_epochs times its
    source's size. A source is taken whole as often as fits its target; the rest is the head of its documents in a seeded hash order, cut
    where the words come nearest to the target. The cut is found from sums of 4,096 hash buckets a source, so no task sorts a whole source.

    Null text: size 0. Null source: a source of its own, the last. Null ids hash alike and are taken or left together, as are rows
    that repeat an id. A source without words has target 0 and reps 0. Columns of docs named like the new ones are replaced. An empty
    table gives an empty result. The same rows and seed always give the same result, in any partitioning.
    """
    docs = without_clashes(docs, "size", "source_size", "target", "reps", "taken", "_h", "_whole", "_cut", "_s", "_null")
    sized = stored(docs.select(F.col(source_col).alias("_s"), _size(F.col(text_col)).alias("size"), _hash(id_col, seed).alias("_h")), "sized")
    buckets = stored(sized.groupBy("_s", F.substring("_h", 1, DIGITS).alias("_b")).agg(F.sum("size").alias("words")), "buckets")
    sources = buckets.groupBy("_s").agg(F.sum("words").alias("source_size"))
    sources = ranked(sources, F.col("_s").isNull(), F.col("_s"), name="_rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = stored(sources.withColumns({"weight": F.get(cycle, (F.col("_rank") % len(weights)).cast("int")), "cap": max_epochs * F.col("source_size")}), "sources")
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = water_level(sources, share * words)
    target = F.col("cap").cast("double") if level is None else F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double"))
    has_words = F.col("source_size") > 0
    whole = F.when(has_words, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = sources.withColumn("target", target).withColumn("_whole", whole.cast("int")).withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))
    plan = stored(plan.select("_s", "source_size", "target", "_whole", "_part"), "targets")
    same = lambda a, b: a["_s"].eqNullSafe(b["_s"])

    # the bucket of each source in which its words reach the part that is left
    p, b = plan.select("_s", "_part"), buckets
    sums = b.join(small(p), same(b, p)).select(b["_s"], "_b", "words", "_part")
    sums = sums.withColumn("_before", F.sum("words").over(Window.partitionBy("_s").orderBy("_b")) - F.col("words"))
    edge = stored(sums.where((F.col("_before") <= F.col("_part")) & (F.col("_part") < F.col("_before") + F.col("words"))).select("_s", "_b", "_before", "_part"), "edges")
    inside = sized.withColumn("_b", F.substring("_h", 1, DIGITS))
    inside = inside.join(small(edge), same(inside, edge) & (inside["_b"] == edge["_b"])).select(inside["_s"], "_h", "size", "_before", "_part")
    inside = inside.groupBy("_s", "_h").agg(F.sum("size").alias("size"), F.first("_before").alias("_before"), F.first("_part").alias("_part"))
    run = F.sum("size").over(Window.partitionBy("_s").orderBy("_h"))
    inside = inside.withColumn("_mid", F.col("_before") + run - F.col("size") / 2)
    last = inside.where(F.col("_mid") <= F.col("_part")).groupBy("_s").agg(F.max("_h").alias("_last"))
    e, t = edge.select("_s", "_b"), last
    cuts = e.join(t, same(e, t), "left").select(e["_s"], F.coalesce("_last", "_b").alias("_cut"))
    q = plan
    # no such bucket: nothing is left over, or all of the source fits ("g" is after any hash)
    final = q.join(cuts, same(q, cuts), "left").select(q["_s"], "source_size", "target", "_whole", F.coalesce("_cut", F.when(F.col("_part") > 0, F.lit("g")).otherwise(F.lit(""))).alias("_cut"))
    final = stored(final, "mix")
    mixed = docs.join(small(final), docs[source_col].eqNullSafe(final["_s"])).drop("_s")
    reps = F.when(F.col("source_size") > 0, F.col("_whole") + (_hash(id_col, seed) <= F.col("_cut")).cast("int")).otherwise(0)
    return mixed.withColumn("size", _size(F.col(text_col))).withColumn("reps", F.least(reps, F.lit(max_epochs))).withColumn("taken", F.col("reps") * F.col("size")).drop("_whole", "_cut")


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as often as mix() takes it."""
    return mixed.where(F.col("reps") > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("reps")))).select(*columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17|' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM sources
), filled AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, source) AS k,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights,
         1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total
  FROM weighed
), leveled AS (
  SELECT *, (total - caps::DOUBLE) / weights::DOUBLE AS level FROM filled
), chosen AS (
  SELECT level FROM leveled WHERE w * level <= cap ORDER BY k LIMIT 1
), targets AS (
  SELECT source, source_size, least(w * (SELECT level FROM chosen), cap::DOUBLE) AS target FROM weighed
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), ordered AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY h) - s.size / 2.0 AS mid
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       (size * CASE WHEN source_size = 0 THEN 0 ELSE least(2, whole + CASE WHEN mid <= part THEN 1 ELSE 0 END) END)::BIGINT AS taken
FROM ordered
"""
