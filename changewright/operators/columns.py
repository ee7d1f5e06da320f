"""Expand/contract: change a column while old and new readers both work."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewright.operators import ordered

# Allowed steps of a column change.
PHASE_STEPS = (("expanding", "expanded"), ("expanded", "contracting"), ("contracting", "completed"))
_GONE = 4  # ``apply_changes``: no row
DELETABLE_PHASES = ("expanding", "completed")


@dataclass(frozen=True)
class ColumnChange:
    """An old column, a new column and the way between them.

    ``forward`` and ``reverse`` are SQL text over the row's columns; without
    them the value is cast to the other column's type.
    """

    old: str
    new: str
    old_type: str
    new_type: str
    forward: str | None = None
    reverse: str | None = None
    new_default: str | None = None
    old_default: str | None = None


def fwd_expr(c: ColumnChange) -> Column:
    return _sync(c.forward or f"`{c.old}`", c.new_default).cast(c.new_type)


def rev_expr(c: ColumnChange) -> Column:
    return _sync(c.reverse or f"`{c.new}`", c.old_default).cast(c.old_type)


def _sync(base: str, default: str | None) -> Column:
    return F.expr(base) if default is None else F.coalesce(F.expr(base), F.expr(default))


def expand(df: DataFrame, c: ColumnChange) -> DataFrame:
    """Add the new column, filled from the old one."""
    return df.withColumn(c.new, fwd_expr(c))


def expand_revert(df: DataFrame, c: ColumnChange) -> DataFrame:
    return df.drop(c.new)


def sync_insert(df: DataFrame, c: ColumnChange) -> DataFrame:
    """Inserted rows: fill the new column from the old, then the old from the new."""
    filled = df.withColumn(c.new, F.when(F.col(c.new).isNull(), fwd_expr(c)).otherwise(F.col(c.new)))
    need_old = F.col(c.old).isNull() & F.col(c.new).isNotNull()
    return filled.withColumn(c.old, F.when(need_old, rev_expr(c)).otherwise(F.col(c.old)))


def _sync_changed(df: DataFrame, c: ColumnChange, old_before: Column, new_before: Column) -> DataFrame:
    """The old column wins when both changed."""
    old_moved = ~F.col(c.old).eqNullSafe(old_before)
    new_moved = ~F.col(c.new).eqNullSafe(new_before)
    marked = df.withColumn("_move", F.when(old_moved, 1).when(new_moved, 2).otherwise(0))
    forward = F.when(F.col("_move") == 1, fwd_expr(c)).otherwise(F.col(c.new))
    backward = F.when(F.col("_move") == 2, rev_expr(c)).otherwise(F.col(c.old))
    return marked.withColumns({c.new: forward, c.old: backward}).drop("_move")


def sync_update(before: DataFrame, after: DataFrame, keys: Sequence[str], c: ColumnChange) -> DataFrame:
    """Updated rows: the column that changed sets the other one."""
    images = before.select(*keys, F.col(c.old).alias("_old"), F.col(c.new).alias("_new"))
    both = after.join(images, list(keys))
    return _sync_changed(both, c, F.col("_old"), F.col("_new")).select(*after.columns)


def latest_changes(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last change of each key; partial aggregation folds a hot key before the shuffle."""
    rest = [x for x in changes.columns if x not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_l"))
    return last.select(*keys, "_l.*")


def apply_changes(
    table: DataFrame, changes: DataFrame, keys: Sequence[str], c: ColumnChange, order: Sequence[str]
) -> DataFrame:
    """New table after a batch of ``op`` = insert / update / delete rows.

    ``changes`` holds full row images, ``op`` and the order columns, unique per key.  Images of a key are applied one
    by one, each compared with the row that the one before left, so any split into batches gives the same table.  An
    update of a missing row inserts it, an insert of a present row updates it.

    A row's image can only end in four ways: old moved, new moved, neither, inserted.  Which one follows from which
    is a small map per image; maps compose, so they are folded inside bounded slices of the order and then across
    slices, and a key with any share of all changes stays in bounded steps.  Only keys with several images are ordered.
    """
    cols = [x for x in table.columns if x not in keys]
    counted = changes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rest = table.join(counted, list(keys), "left_anti")
    several = counted.where("_n > 1").select(*keys)
    once = _apply_single(table, changes.join(counted.where("_n = 1").select(*keys), list(keys), "left_semi"), keys, c, cols)
    stored = table.join(several, list(keys), "left_semi").select(*table.columns, F.lit("stored").alias("op"), F.lit(0).alias("_late"))
    images = changes.join(several, list(keys), "left_semi").select(*keys, *cols, "op", F.lit(1).alias("_late"), *[F.col(x).alias(f"_by{i}") for i, x in enumerate(order)])
    log = _with_ends(stored.unionByName(images, allowMissingColumns=True), c)

    by = [F.col("_late"), *[F.col(f"_by{i}") for i in range(len(order))]]
    sliced = ordered.neighbour(ordered.slice_by_sort(log, keys, by), keys, F.col("_ends"), "_before", -1)
    image = F.col("_ends")[2]

    def after(p: int) -> Column:
        was = F.get("_before", F.lit(p))
        moved = F.when(~image["old"].eqNullSafe(was["old"]), 0).when(~image["new"].eqNullSafe(was["new"]), 1).otherwise(2)
        return F.when(F.col("op") == "delete", _GONE).when(F.col("op") == "stored", 2).otherwise(moved)

    missing = F.when(F.col("op") == "delete", _GONE).when(F.col("op") == "stored", 2).otherwise(3)
    step = F.array(*[after(p) for p in range(4)], missing)

    def fold(maps: Column) -> Column:
        start = F.array(*[F.lit(p) for p in range(_GONE + 1)])
        return F.aggregate(F.array_sort(maps), start, lambda acc, m: F.transform(acc, lambda s: m["m"][s]))

    row = F.struct(*cols, "_ends")
    part = sliced.groupBy(*keys, ordered.SLICE).agg(
        fold(F.collect_list(F.struct(F.col(ordered.AT).alias("at"), step.alias("m")))).alias("m"), F.max_by(row, ordered.AT).alias("r"))
    whole = part.groupBy(*keys).agg(fold(F.collect_list(F.struct(F.col(ordered.SLICE).alias("at"), F.col("m").alias("m"))))[_GONE].alias("end"), F.max_by("r", ordered.SLICE).alias("r"))
    last = F.get(F.col("r._ends"), F.col("end"))
    value = {c.old: last["old"], c.new: last["new"]}
    kept = whole.where(F.col("end") < _GONE).select(*keys, *[value.get(x, F.col(f"r.`{x}`")).cast(table.schema[x].dataType).alias(x) for x in cols])
    return rest.unionByName(kept.select(*table.columns)).unionByName(once.select(*table.columns))


def _with_ends(log: DataFrame, c: ColumnChange) -> DataFrame:
    """Adds ``_ends``, the (old, new) pairs of the four ways a row's image can end."""
    def pair(old: Column, new: Column) -> Column:
        return F.struct(old.cast(c.old_type).alias("old"), new.cast(c.new_type).alias("new"))

    old, new = F.col(c.old), F.col(c.new)
    ends = F.array(pair(old, fwd_expr(c)), pair(rev_expr(c), new), pair(old, new))
    log = log.withColumn("_ends", ends)
    log = log.withColumn("_new", F.when(new.isNull(), fwd_expr(c)).otherwise(new)).withColumn("_image_new", new)
    refilled = log.drop(c.new).withColumnRenamed("_new", c.new)
    inserted = F.when(F.col(c.old).isNull() & F.col(c.new).isNotNull(), rev_expr(c)).otherwise(F.col(c.old))
    return refilled.withColumn("_ends", F.concat("_ends", F.array(pair(inserted, F.col(c.new))))).drop(c.new).withColumnRenamed("_image_new", c.new)


def _apply_single(table: DataFrame, changes: DataFrame, keys: Sequence[str], c: ColumnChange, cols: Sequence[str]) -> DataFrame:
    """Rows after the only image of their key: no order is needed, just the stored row."""
    was = F.struct(F.col(c.old).cast(c.old_type).alias("old"), F.col(c.new).cast(c.new_type).alias("new"))
    rows = _with_ends(changes.select(*keys, *cols, "op"), c).join(table.select(*keys, was.alias("_was")), list(keys), "left")
    image = F.col("_ends")[2]
    moved = F.when(~image["old"].eqNullSafe(F.col("_was.old")), 0).when(~image["new"].eqNullSafe(F.col("_was.new")), 1).otherwise(2)
    last = F.get("_ends", F.when(F.col("_was").isNull(), 3).otherwise(moved))
    value = {c.old: last["old"], c.new: last["new"]}
    return rows.where("op <> 'delete'").select(*keys, *[value.get(x, F.col(x)).cast(table.schema[x].dataType).alias(x) for x in cols])


def backfill_status(df: DataFrame, new: str, source_filter: Column | None = None) -> DataFrame:
    rows = df if source_filter is None else df.where(source_filter)
    out = rows.agg(F.count(F.lit(1)).alias("total_rows"), F.count(new).alias("backfilled_rows"))
    return out.withColumn("is_complete", F.col("total_rows") == F.col("backfilled_rows"))


def unsynced(df: DataFrame, c: ColumnChange) -> DataFrame:
    return df.where(F.col(c.old).isNotNull() & F.col(c.new).isNull())


def contract(df: DataFrame, c: ColumnChange) -> DataFrame:
    """Drop the old column; refused while any row is not synced."""
    if not unsynced(df, c).isEmpty():
        raise ValueError(f"rows with {c.old} set and {c.new} null: backfill first")
    return df.drop(c.old)


def contract_revert(df: DataFrame, c: ColumnChange) -> DataFrame:
    """Bring the old column back from the new one."""
    return df.withColumn(c.old, F.when(F.col(c.new).isNotNull(), rev_expr(c)))


def phase_transitions(log: DataFrame, backfill: DataFrame | None = None, keys: Sequence[str] = ("operation_id",)) -> DataFrame:
    """Each step of a column change with its legality.

    ``log`` has the keys, a step number ``step_no`` (unique and dense per
    operation) and ``phase``.  The step before is found by an equi-join, so an
    operation with very many steps is spread.  Entering ``contracting`` also
    needs a complete backfill.
    """
    before = log.select(*keys, (F.col("step_no") + 1).alias("step_no"), F.col("phase").alias("from_phase"))
    steps = log.join(before, [*keys, "step_no"], "left")
    legal = F.coalesce(F.struct("from_phase", "phase").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in PHASE_STEPS]), F.lit(False))
    first = F.col("from_phase").isNull() & (F.col("phase") == "expanding")
    problem = F.when(~(first | (F.col("from_phase").isNotNull() & legal)), "illegal step")
    if backfill is not None:
        steps = steps.join(backfill.select(*keys, "is_complete"), list(keys), "left")
        unfilled = (F.col("phase") == "contracting") & ~F.coalesce("is_complete", F.lit(False))
        problem = F.coalesce(problem, F.when(unfilled, "backfill not complete"))
    return steps.select(*keys, "step_no", "from_phase", "phase", problem.isNull().alias("legal"), problem.alias("problem"))


def list_operations(state: DataFrame, project: str | None = None, phase: str | None = None, active: bool = False) -> DataFrame:
    """Column changes, newest first; ``active`` leaves out completed ones."""
    rows = state
    if project is not None:
        rows = rows.where(F.col("project") == project)
    if phase is not None:
        rows = rows.where(F.col("phase") == phase)
    if active:
        rows = rows.where(F.col("phase") != "completed")
    return rows.orderBy(F.col("started_at").desc(), F.col("id").desc())


def deletable(state: DataFrame) -> DataFrame:
    return state.withColumn("deletable", F.col("phase").isin(*DELETABLE_PHASES))


def duplicate_active(state: DataFrame, keys: Sequence[str] = ("project", "change_name")) -> DataFrame:
    """Names with more than one operation that is not completed."""
    return state.where("phase <> 'completed'").groupBy(*keys).agg(F.count(F.lit(1)).alias("operations")).where("operations > 1")
