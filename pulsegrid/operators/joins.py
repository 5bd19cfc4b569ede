"""Joins on ranges and times, with a bucket as an equality key so that only near rows meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def iou(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Overlap of the ranges a..b and c..d over the length of their hull, ends included."""
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c) + 1) / (F.greatest(b, d) - F.least(a, c) + 1)


def range_join(left: DataFrame, right: DataFrame, keys: list[str], size: int = 32, l: tuple[str, str] = ("start", "end"), r: tuple[str, str] = ("start", "end")) -> DataFrame:
    """Pairs of left (columns l_*) and right (r_*) whose ranges overlap, ends included. Each range stands in every bucket it touches; a pair
    that shares several is kept in its first, so long ranges cost rows in proportion to their length and nothing is doubled."""
    def bucketed(df: DataFrame, side: str, ends: tuple[str, str]) -> DataFrame:
        df = df.select(*[F.col(c).alias(c if c in keys else f"{side}_{c}") for c in df.columns])
        a, b = (F.floor(F.col(f"{side}_{c}") / size) for c in ends)
        return df.withColumn("_bucket", F.explode(F.sequence(a, b)))

    a, b = bucketed(left, "l", l), bucketed(right, "r", r)
    # stored ranges pack to far less than what they are in memory, and Spark goes by the former: it is told not to broadcast them
    both = a.join(b.hint("merge"), [*keys, "_bucket"])
    s, e = F.greatest(f"l_{l[0]}", f"r_{r[0]}"), F.least(f"l_{l[1]}", f"r_{r[1]}")
    return both.where((s <= e) & (F.floor(s / size) == F.col("_bucket"))).drop("_bucket")


def best_overlap(query: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """For each query range (q_id, start, end) the target (t_id, start, end) with the largest IoU, the first on ties; nulls if none overlaps."""
    pairs = range_join(query, target, keys).withColumn("iou", iou(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end")))
    first = F.row_number().over(Window.partitionBy(*keys, "l_q_id").orderBy(F.desc("iou"), "r_t_id"))
    best = pairs.withColumn("_k", first).where("_k = 1").select(*keys, F.col("l_q_id").alias("q_id"), F.col("r_t_id").alias("t_id"), "iou", (F.least("l_end", "r_end") - F.greatest("l_start", "r_start") + 1).alias("overlap"))
    return query.join(best, [*keys, "q_id"], "left")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], l_at: str, r_at: str, before: int, after: int) -> DataFrame:
    """Pairs with -before <= right's time - left's time <= after (integers). A right row stands in one bucket as wide as the band; a left row asks the two that its band meets."""
    size = before + after + 1
    first = F.floor((F.col(l_at) - before) / size)
    a = left.withColumn("_bucket", F.explode(F.array(first, first + 1)))
    b = right.withColumn("_bucket", F.floor(F.col(r_at) / size))
    lag = F.col(r_at) - F.col(l_at)
    return a.join(b, [*keys, "_bucket"]).where((lag >= -before) & (lag <= after)).drop("_bucket")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left plus the value of the latest right row at or before its time (prev), the next at or after it (next), both times, and the linear interpolation, clamped at
    the ends. Both sides go in one sorted timeline; nothing is paired."""
    both = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_v")).unionByName(right.select(key, at, F.lit(0).alias("_side"), F.col(value).cast("double").alias("_v")), allowMissingColumns=True)
    seen = F.when(F.col("_side") == 0, F.struct(F.col(at).alias("at"), F.col("_v").alias("v")))
    up = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(key).orderBy(F.desc(at), "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumns({"_p": F.last(seen, True).over(up), "_n": F.last(seen, True).over(down)}).where("_side = 1")
    share = (F.col(at) - F.col("_p.at")) / (F.col("_n.at") - F.col("_p.at"))
    lerp = F.when(F.col("_p").isNull(), F.col("_n.v")).when(F.col("_n").isNull() | (F.col("_n.at") == F.col("_p.at")), F.col("_p.v")).otherwise(F.col("_p.v") + share * (F.col("_n.v") - F.col("_p.v")))
    return out.withColumns({"prev": F.col("_p.v"), "next": F.col("_n.v"), "prev_at": F.col("_p.at"), "next_at": F.col("_n.at"), "interpolated": lerp}).drop("_side", "_v", "_p", "_n")


def bin_overlap(ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Each range (integer times) once for every bin of the given width that it meets, with the length inside the bin (overlap)."""
    last = F.floor((F.greatest(F.col(end) - 1, F.col(start))) / width)
    out = ranges.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / width), last)))
    return out.withColumn("overlap", F.greatest(F.lit(0), F.least(F.col(end), (F.col("bin") + 1) * width) - F.greatest(F.col(start), F.col("bin") * width)))


def lag_join(counts: DataFrame, pairs: DataFrame, lag: int) -> DataFrame:
    """counts (train, bin, n) of the pairs (a, b) of trains, b's bin taken lag later: a, b, bin, n_a, n_b."""
    a = counts.select(F.col("train").alias("a"), "bin", F.col("n").alias("n_a"))
    b = counts.select(F.col("train").alias("b"), (F.col("bin") - lag).alias("bin"), F.col("n").alias("n_b"))
    return pairs.join(a, "a").join(b, ["b", "bin"])
