"""Order-based steps that never put one whole group into one task.

A plain ``Window.partitionBy(keys).orderBy(...)`` sends every row of a key to
one task, so a project with a third of all rows would be sorted by one core.
Here each key is cut into bounded, ordered *slices*; a window runs inside a
slice, and what crosses the slice border is carried over a summary table with
one row per (key, slice).

Slices come from either
* ``slice_by_position``: an integer that is unique within the key (a plan
  position).  Its quotient bounds a slice to ``width`` rows; no extra job.
* ``slice_by_sort``: any order.  A range partitioning on (keys, order) is
  written once, so that slice numbers stay the same for every later use.  Its
  splitters are sampled by Spark; how many there are follows from the row count.

A step reads its input twice: rows and summary.  Where the input is itself
the result of such a step, ``base`` names the sliced table it came from, and
the summary is taken from there instead of running the earlier step again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changewright.session import cut

SLICE = "_slice"
AT = "_at"
WIDTH = 1 << 17
#: Rows that a sorted slice holds, about; ten times 10^10 rows are 50,000 slices.
SORT_WIDTH = 1 << 21


def slice_by_position(df: DataFrame, pos: str, width: int = WIDTH) -> DataFrame:
    return df.withColumn(SLICE, F.floor(F.col(pos) / F.lit(width))).withColumn(AT, F.col(pos).cast("long"))


def slice_by_sort(df: DataFrame, keys: Sequence[str], order: Sequence[Column], width: int = SORT_WIDTH) -> DataFrame:
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // width))
    by = [F.col(k) for k in keys] + list(order)
    placed = df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    numbered = cut(placed.withColumn(AT, F.monotonically_increasing_id()))
    return numbered.withColumn(SLICE, F.shiftright(AT, 33))


def unsliced(df: DataFrame) -> DataFrame:
    return df.drop(SLICE, AT)


def _summary(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys, SLICE).agg(*aggs)


def _across(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(SLICE)


def _inside(keys: Sequence[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(AT)


def number(df: DataFrame, keys: Sequence[str], name: str, base: DataFrame | None = None) -> DataFrame:
    """``row_number`` (from 1) within the key; ``df`` is sliced."""
    before = F.coalesce(F.sum("_o_n").over(_across(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = _summary(df if base is None else base, keys, F.count(F.lit(1)).alias("_o_n")).withColumn("_o_before", before).drop("_o_n")
    ranked = df.withColumn("_o_rank", F.row_number().over(_inside(keys)))
    return (
        ranked.join(counts, [*keys, SLICE])
        .withColumn(name, (F.col("_o_before") + F.col("_o_rank")).cast("long"))
        .drop("_o_before", "_o_rank")
    )


def neighbour(
    df: DataFrame, keys: Sequence[str], value: Column, name: str, step: int, base: DataFrame | None = None
) -> DataFrame:
    """``lag`` (step -1) or ``lead`` (step 1) of ``value`` within the key."""
    pick = F.max_by if step < 0 else F.min_by
    shift = F.lag if step < 0 else F.lead
    boxed = F.struct(value.alias("v"))
    edge = _summary(df if base is None else base, keys, pick(boxed, F.col(AT)).alias("_o_edge"))
    edge = edge.withColumn("_o_carry", shift("_o_edge").over(_across(keys))).drop("_o_edge")
    local = df.withColumn("_o_box", boxed).withColumn("_o_near", shift("_o_box").over(_inside(keys)))
    joined = local.join(edge, [*keys, SLICE])
    return joined.withColumn(name, F.coalesce("_o_near", "_o_carry")["v"]).drop("_o_box", "_o_near", "_o_carry")


def running_max(df: DataFrame, keys: Sequence[str], value: Column, name: str, base: DataFrame | None = None, own: bool = True) -> DataFrame:
    """Largest non-null ``value`` up to each row, the row's own one included if ``own``."""
    edge = _summary(df if base is None else base, keys, F.max(value).alias("_o_top"))
    edge = edge.withColumn("_o_carry", F.max("_o_top").over(_across(keys).rowsBetween(Window.unboundedPreceding, -1))).drop("_o_top")
    near = F.max("_o_value").over(_inside(keys).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    joined = df.withColumn("_o_value", value).withColumn("_o_near", near).join(edge, [*keys, SLICE])
    return joined.withColumn(name, F.greatest("_o_near", "_o_carry")).drop("_o_value", "_o_near", "_o_carry")


def fill_down(df: DataFrame, keys: Sequence[str], value: Column, name: str, base: DataFrame | None = None) -> DataFrame:
    """Latest non-null ``value`` at or before each row."""
    return _fill(df, keys, value, name, True, base)


def fill_up(df: DataFrame, keys: Sequence[str], value: Column, name: str, base: DataFrame | None = None) -> DataFrame:
    """Nearest non-null ``value`` at or after each row."""
    return _fill(df, keys, value, name, False, base)


def _fill(df: DataFrame, keys: Sequence[str], value: Column, name: str, down: bool, base: DataFrame | None) -> DataFrame:
    # Upwards is the same walk in reverse order: a frame that grows from the
    # start costs one step per row, one that ends at the last row costs all.
    pick = F.max_by if down else F.min_by

    def walk(by: str, *group: str):
        return Window.partitionBy(*keys, *group).orderBy(F.col(by).asc() if down else F.col(by).desc())

    edge = _summary(df if base is None else base, keys, pick(value, F.when(value.isNotNull(), F.col(AT))).alias("_o_edge"))
    carry = F.last("_o_edge", ignorenulls=True).over(walk(SLICE).rowsBetween(Window.unboundedPreceding, -1))
    edge = edge.withColumn("_o_carry", carry).drop("_o_edge")
    near = F.last("_o_value", ignorenulls=True).over(walk(AT, SLICE).rowsBetween(Window.unboundedPreceding, 0))
    joined = df.withColumn("_o_value", value).withColumn("_o_near", near).join(edge, [*keys, SLICE])
    return joined.withColumn(name, F.coalesce("_o_near", "_o_carry")).drop("_o_value", "_o_near", "_o_carry")


def number_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``row_number`` for an arbitrary total order.

    Row ids of the written sort are consecutive inside a slice, so the rank is
    an offset: no second sort, only a join with one row per (key, slice).
    """
    sliced = slice_by_sort(df, keys, order)
    before = F.coalesce(F.sum("_o_n").over(_across(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = _summary(sliced, keys, F.count(F.lit(1)).alias("_o_n"), F.min(AT).alias("_o_first"))
    start = start.select(*keys, SLICE, (before - F.col("_o_first") + 1).alias("_o_shift"))
    return unsliced(sliced.join(start, [*keys, SLICE]).withColumn(name, F.col(AT) + F.col("_o_shift")).drop("_o_shift"))


def asof(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_at: str,
    right_at: str,
    value: Column,
    name: str,
) -> DataFrame:
    """Latest ``value`` of ``right`` at or before each left row, null if none.

    Both sides are stacked, sorted once and filled down: no left x right pairs,
    also when one key holds most rows of both sides.  ``right`` must have one
    row per (on, right_at).
    """
    return asof_all(left, on, left_at, [(right, right_at, value, name)])


def asof_all(left: DataFrame, on: Sequence[str], left_at: str, rights: Sequence[tuple[DataFrame, str, Column, str]]) -> DataFrame:
    """``asof`` with several tables (table, its time column, value, name of the result) in one sort."""
    lrow = F.struct(*[F.col(c) for c in left.columns])
    rows = left.select(*on, F.col(left_at).alias("_o_ts"), F.lit(1).alias("_o_side"), lrow.alias("_o_row"))
    for i, (right, at, value, _) in enumerate(rights):
        points = right.select(*on, F.col(at).alias("_o_ts"), F.lit(0).alias("_o_side"), F.struct(value.alias("v")).alias(f"_o_point{i}"))
        rows = rows.unionByName(points, allowMissingColumns=True)
    # the hash deals rows of one key and time over many slices
    sliced = filled = slice_by_sort(rows, on, [F.col("_o_ts"), F.col("_o_side"), F.xxhash64("_o_row")])
    for i in range(len(rights)):
        filled = fill_down(filled, on, F.col(f"_o_point{i}"), f"_o_found{i}", base=sliced)
    return filled.where("_o_side = 1").select("_o_row.*", *[F.col(f"_o_found{i}")["v"].alias(name) for i, (*_, name) in enumerate(rights)])
