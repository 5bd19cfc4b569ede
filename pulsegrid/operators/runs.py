"""Runs of rows and unions of ranges: gaps and islands, windows and order-dependent merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window, WindowSpec

from pulsegrid.functions.stats import array_quantile
from pulsegrid.sources.shared import stored


def in_train() -> WindowSpec:
    return Window.partitionBy("train").orderBy("idx")


def runs(rows: DataFrame, flag: Column, *aggs: Column, least: int = 1) -> DataFrame:
    """Maximal runs of rows where flag is true (null is false): train, start, end, n and aggs of their rows."""
    some = rows.where(F.coalesce(flag, F.lit(False))).withColumn("_run", F.col("idx") - F.row_number().over(in_train()))
    out = some.groupBy("train", "_run").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.count(F.lit(1)).alias("n"), *aggs).drop("_run")
    return out.where(F.col("n") >= least) if least > 1 else out


def run_length(flag: Column, at: Column | None = None) -> Column:
    """How many rows in a row, up to this one, have the flag; at numbers the rows that count (all of them if it isn't given)."""
    at = F.col("idx") if at is None else at
    up = in_train().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(flag, at - F.coalesce(F.max(F.when(~flag, at)).over(up), F.lit(0))).otherwise(0)


def segments(rows: DataFrame, label: Column, *aggs: Column) -> DataFrame:
    """Runs of equal labels: train, label, start, end, n and aggs."""
    some = rows.withColumn("label", label)
    change = F.coalesce((F.col("label") != F.lag("label").over(in_train())).cast("int"), F.lit(1))
    some = some.withColumn("_run", F.sum(change).over(in_train()))
    return some.groupBy("train", "_run", "label").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.count(F.lit(1)).alias("n"), *aggs).drop("_run")


def longest_run(rows: DataFrame, flag: Column) -> DataFrame:
    """Per train (of those in rows): the length of the longest run, 0 if there is none."""
    best = runs(rows, flag).groupBy("train").agg(F.max("n").alias("longest"))
    return rows.select("train").distinct().join(best, "train", "left").select("train", F.coalesce("longest", F.lit(0)).alias("longest"))


def short_runs(rows: DataFrame, max_isi: float | None = None, max_pct: float | None = None, least: int = 2) -> DataFrame:
    """Runs of valid intervals that an absolute or a percentile gate holds (rows with pct); a gate that isn't given doesn't count."""
    gates = [c for c in (F.col("isi") <= max_isi if max_isi is not None else None, F.col("pct") <= max_pct if max_pct is not None else None) if c is not None]
    flag = F.col("valid")
    if gates:
        held = gates[0]
        for g in gates[1:]:
            held = held | g
        flag = flag & held
    return runs(rows, flag, F.avg("isi").alias("mean_isi"), F.max("isi").alias("max_isi"), least=least)


def _q90_ahead(width: int) -> Column:
    """The 90% quantile of the valid ones among this row's interval and the next ones, width rows in all; null without any. Under twelve values it lies between the two
    highest, which plain expressions find."""
    x = [F.lead(F.when(F.col("valid"), F.col("isi")), k).over(in_train()) for k in range(width)]
    if width > 11:
        return array_quantile(F.array(*x), 0.9)
    highest, second, n = x[0], F.lit(None).cast("double"), x[0].isNotNull().cast("int")
    for k in range(1, width):
        so_far = F.greatest(*x[:k]) if k > 1 else x[0]
        second = F.greatest(second, F.when(so_far.isNotNull() & x[k].isNotNull(), F.least(so_far, x[k])))
        n = n + x[k].isNotNull().cast("int")
    highest = F.greatest(*x) if width > 1 else x[0]
    return F.when(n > 1, highest - 0.1 * (n - 1) * (highest - second)).otherwise(highest)


def structure_scan(rows: DataFrame, widths: tuple[int, int] = (2, 8), q90_max: float | None = 0.02, pct_max: float | None = None, edge_min: float = 1.0, edge_geometric: float = 1.0) -> DataFrame:
    """Every window of the given widths that is short, by its 90% quantile or by the highest percentile in it (rows with pct, if pct_max is given), and stands out from
    both flanks: start, end, width, q90, max_pct, and the ratios of the flanks to q90 (least and geometric mean). Invalid intervals in a window don't count; flanks may be invalid."""
    lo, hi = widths
    pct = F.col("pct") if pct_max is not None else F.lit(None).cast("double")
    pre = F.lag("isi").over(in_train())
    some = rows.withColumns({"_pre": pre, **{f"_q{w}": _q90_ahead(w) for w in range(lo, hi + 1)}, **{f"_post{w}": F.lead("isi", w).over(in_train()) for w in range(lo, hi + 1)}})
    some = some.withColumns({f"_p{w}": F.max(pct).over(in_train().rowsBetween(0, w - 1)) for w in range(lo, hi + 1)})
    found = []
    for w in range(lo, hi + 1):
        q90, post, top = F.col(f"_q{w}"), F.col(f"_post{w}"), F.col(f"_p{w}")
        least, geometric = F.least("_pre", post) / q90, F.sqrt(F.col("_pre") * post) / q90
        short = F.lit(False)
        if q90_max is not None:
            short = short | (q90 <= q90_max)
        if pct_max is not None:
            short = short | (top <= pct_max)
        keep = F.col("_pre").isNotNull() & post.isNotNull() & (q90 > 0) & F.coalesce(short, F.lit(False)) & (least >= edge_min) & (geometric >= edge_geometric)
        fields = {"width": F.lit(w), "q90": q90, "max_pct": top, "least": least, "geometric": geometric}
        found.append(F.when(keep, F.struct(*[v.alias(k) for k, v in fields.items()])))
    some = some.select("train", "idx", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("w"))
    return some.select("train", F.col("idx").alias("start"), (F.col("idx") + F.col("w.width") - 1).alias("end"), "w.*")


def unions(ranges: DataFrame, adjacent: bool = True) -> DataFrame:
    """Unions of ranges (train, start, end) that overlap; ranges that only touch are one as well if adjacent."""
    order = Window.partitionBy("train").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > before + (1 if adjacent else 0)).cast("int"), F.lit(1))
    some = ranges.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    return some.groupBy("train", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts")).drop("_run")


def extensions(rows: DataFrame, seeds: DataFrame, bridge: float, most: int = 4) -> DataFrame:
    """Every extension of seeds (train, start, end) by up to `most` valid intervals <= bridge in a row on each side: train, start, end, s, e."""
    near = beside(rows, bridge, most)
    left = near.select("train", F.col("idx").alias("start"), "_l")
    right = near.select("train", F.col("idx").alias("end"), "_r")
    return extended(seeds.join(left, ["train", "start"]).join(right, ["train", "end"]))


def runs_beside(rows: DataFrame, flag: Column, bridge: float | Column, most: int = 4) -> DataFrame:
    """Runs of rows with the flag, as runs() gives them, and what extended() needs of their sides (_l, _r). What lies beside a run is known in its first and last row, so nothing is joined."""
    return runs(beside(rows, bridge, most), flag, F.min_by("_l", "idx").alias("_l"), F.max_by("_r", "idx").alias("_r"))


def beside(rows: DataFrame, bridge: float | Column, most: int) -> DataFrame:
    """rows plus _l and _r: how many valid intervals <= bridge stand in a row right before and right after each, most at most."""
    x = rows.withColumn("_ok", F.coalesce(F.col("valid") & (F.col("isi") <= bridge), F.lit(False)))
    left = right = F.lit(0)
    for k in range(most, 0, -1):
        left, right = (F.when(F.coalesce(f("_ok", k).over(in_train()), F.lit(False)), 1 + n).otherwise(0) for f, n in ((F.lag, left), (F.lead, right)))
    return x.withColumns({"_l": left, "_r": right}).drop("_ok")


def extended(out: DataFrame) -> DataFrame:
    """Every extension (s, e) of runs by up to _l and _r intervals on their sides."""
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(0), "_l"))).withColumn("_j", F.explode(F.sequence(F.lit(0), "_r")))
    return out.withColumns({"s": F.col("start") - F.col("_i"), "e": F.col("end") + F.col("_j")}).drop("_i", "_j", "_l", "_r")


def merged_blocks(blocks: DataFrame, may_join: Callable[[int, int, int, int], bool]) -> DataFrame:
    """Blocks (train, start, end) merged from left to right: the growing block takes in the next if may_join(start, end of the block, start, end of the next).
    The predicate sees the block as it has grown, so this is a fold over a train's blocks."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list[int]] = []
        for a, b in pdf.sort_values(["start", "end"])[["start", "end"]].itertuples(index=False):
            if out and may_join(out[-1][0], out[-1][1], a, b):
                out[-1][1], out[-1][2] = max(out[-1][1], b), out[-1][2] + 1
            else:
                out.append([a, b, 1])
        return pd.DataFrame([[pdf["train"].iloc[0], *x] for x in out], columns=["train", "start", "end", "parts"])

    return blocks.groupBy("train").applyInPandas(fold, f"train {blocks.schema['train'].dataType.simpleString()}, start long, end long, parts long")


def folded(blocks: DataFrame, columns: list[str], begin: Callable[[tuple], list], take: Callable[[list, tuple], list | None], schema: str) -> DataFrame:
    """One pass over each train's blocks in order of the columns (the first are train and start): begin(row) starts a block, take(block, row) gives it grown by the next row, or None if it ends before that
    row. What has grown so far decides, so this is a scan; it goes on over Arrow batches and holds one block, however long a train is."""

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        table = lambda done: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), kind, strict=True)], schema=kind)
        for b in batches:
            done = []
            for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                grown = take(now, row) if now is not None and now[0] == row[0] else None
                if grown is None:
                    if now is not None:
                        done.append(now)
                    grown = begin(row)
                now = grown
            if done:
                yield table(done)
        if now is not None:
            yield table([now])

    return blocks.select(*columns).repartition("train").sortWithinPartitions(*columns).mapInArrow(run, schema)


def support_runs(
    rows: DataFrame, support: Column, tolerated: float | Column, hard_break: float | Column, most: int | Column = 3, least: int = 1, transparent: Column | None = None, short_side: str | None = None
) -> DataFrame:
    """Runs of supporting intervals, merged across at most `most` others in a row, all of them at most tolerated and shorter than hard_break. One scan: an interval
    belongs if it supports or stands in such a gap between two that do.

    transparent intervals (no valid ones) may stand in a gap too; across such a gap a run goes on only as long as it has at most short_side (a column of rows) intervals so far."""
    back = in_train().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("train").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # frames up to a train's end cost its length for each row
    no = lambda c: F.coalesce(c, F.lit(False))
    some = rows.withColumn("_s", no(support & F.col("valid")))
    clear = ~F.col("_s") & (no(transparent) if transparent is not None else F.lit(False))
    blocks = (~F.col("_s")) & ~clear & ~no(F.col("valid") & (F.col("isi") <= tolerated) & (F.col("isi") < hard_break))
    at = F.col("idx")
    places = {"": F.col("_s"), "_block": blocks, **({"_clear": clear} if transparent is not None else {})}
    some = some.withColumns({f"_prev{k}": F.max(F.when(v, at)).over(back) for k, v in places.items()} | {f"_next{k}": F.min(F.when(v, at)).over(ahead) for k, v in places.items()})
    gap = (F.col("_next") - F.col("_prev") - 1 <= most) & (F.coalesce("_prev_block", F.lit(0)) < F.col("_prev")) & (F.coalesce("_next_block", F.lit(1 << 40)) > F.col("_next"))
    gap = no(gap & ~F.col("_s"))
    aggs = [F.count_if("_s").alias("support"), F.max("isi").alias("max_isi"), F.sum("isi").alias("duration")]
    if transparent is None:
        return runs(some, F.col("_s") | gap, *aggs, least=least)
    doubtful = gap & (no(F.col("_prev_clear") > F.col("_prev")) | no(F.col("_next_clear") < F.col("_next")))
    some = some.withColumns({"_gap": gap, "_doubt": doubtful})
    found = stored(runs(some, F.col("_s") | (F.col("_gap") & ~F.col("_doubt")), *aggs), "support-runs")
    links = some.where("_doubt").groupBy("train", F.col("_next").alias("start")).agg(F.max(short_side).alias("side"), F.max("isi").alias("gap_max"), F.sum("isi").alias("gap_sum"))
    links = stored(links, "doubtful-gaps")
    linked = found.join(links.select("train").distinct(), "train", "left_semi").join(links, ["train", "start"], "left")
    names = ["train", "start", "end", "n", "support", "max_isi", "duration", "side", "gap_max", "gap_sum"]

    def take(now: list, row: tuple) -> list | None:
        _, start, end, n, support_, longest, duration, side, gap_max, gap_sum = row
        if side is None or now[2] - now[1] + 1 > side:
            return None
        return [now[0], now[1], end, end - now[1] + 1, now[4] + support_, max(now[5], longest, gap_max), now[6] + duration + gap_sum]

    train = f"train {rows.schema['train'].dataType.simpleString()}"
    grown = folded(linked, names, lambda row: list(row[:7]), take, f"{train}, start long, end long, n long, support long, max_isi double, duration double")
    rest = found.join(links.select("train").distinct(), "train", "left_anti")
    out = rest.select(*names[:7]).unionByName(grown)
    return out.where(F.col("n") >= least) if least > 1 else out


def tiles(blocks: DataFrame, most: int = 8) -> DataFrame:
    """Blocks (train, start, end) cut into tiles of at most `most` rows."""
    out = blocks.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("end") - F.col("start")) / most))))
    return out.select("train", F.col("start").alias("block"), (F.col("start") + F.col("_k") * most).alias("start"), F.least(F.col("start") + (F.col("_k") + 1) * most - 1, F.col("end")).alias("end"))


def recurrence_lines(points: DataFrame, diagonal: bool = True, least: int = 2) -> DataFrame:
    """Lines of a recurrence matrix (train, i, j): runs along diagonals, or along columns if not diagonal."""
    key, at = (F.col("j") - F.col("i"), "i") if diagonal else (F.col("i"), "j")
    some = points.where(F.col("i") != F.col("j")).withColumn("_key", key)
    some = some.withColumn("_run", F.col(at) - F.row_number().over(Window.partitionBy("train", "_key").orderBy(at)))
    return some.groupBy("train", "_key", "_run").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") >= least).select("train", F.col("_key").alias("line"), "length")

