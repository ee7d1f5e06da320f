"""Data prechecks: the rows a constraint, cast or statement would hit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls per column in one pass; a NOT NULL constraint passes only at 0."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])).alias("r"))
    return rows.select("r.*").withColumn("passes", F.col("nulls") == 0)


def add_column(
    df: DataFrame,
    name: str,
    type_: str,
    default: Column | None = None,
    nullable: bool = True,
    seed_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Add a column.

    NOT NULL without a default is refused on a non-empty table.  With
    ``seed_keys`` the default is a volatile one: a value in [0, 1) drawn per
    row from the key's hash, the same on every re-read.
    """
    if seed_keys is not None:
        default = F.pmod(F.xxhash64(*seed_keys), F.lit(1 << 53)).cast("double") / float(1 << 53)
    if default is None:
        if not nullable and not df.isEmpty():
            raise ValueError(f"column {name} is NOT NULL without a default on a table with rows")
        default = F.lit(None)
    return df.withColumn(name, default.cast(type_))


def cast_check(df: DataFrame, col: str, type_: str) -> DataFrame:
    """Rows whose cast fails (``fails``) or loses information (``lossy``)."""
    source = df.schema[col].dataType
    cast = F.col(col).try_cast(type_)
    failed = F.col(col).isNotNull() & cast.isNull()
    back = F.col(col).eqNullSafe(cast.try_cast(source))
    problem = F.when(failed, "fails").when(~back, "lossy")
    return df.withColumn("problem", problem).where("problem is not null")


def drop_impact(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, non-null values and distinct values that dropping each column loses.

    Columns are stacked as rows first, so the exact distinct count is a plain
    two-step aggregation instead of one pass per column.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("r"))
    per_value = long.select("r.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    present = F.col("value").isNotNull()
    return per_value.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("non_null"),
        F.count_if(present).alias("distinct_values"),
    )


def truncate_impact(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table; Parquet answers from file footers."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def fk_orphans(child: DataFrame, parent: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Child rows without a parent; a null in any key column passes."""
    present = reduce(Column.__and__, [F.col(c).isNotNull() for c in cols])
    keys = parent.select(*[F.col(p).alias(c) for c, p in cols.items()])
    return child.where(present).join(keys, list(cols), "left_anti")


def dml_impact(df: DataFrame, predicate: Column, threshold: int = 10_000) -> DataFrame:
    """Rows an UPDATE or DELETE with this predicate hits."""
    out = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(predicate).alias("rows_hit"))
    share = F.coalesce(F.try_divide(F.col("rows_hit").cast("decimal(20,0)"), F.col("total_rows")), F.lit(0))
    return out.withColumn("fraction", share.cast("decimal(9,6)")).withColumn("large", F.col("rows_hit") > threshold)


def sequence_check(df: DataFrame, col: str, restart: int) -> DataFrame:
    """Largest value and the rows a sequence restarted there would collide with."""
    return df.agg(F.max(col).alias("max_value"), F.count_if(F.col(col) >= restart).alias("rows_at_or_above"))


def rename_view(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Old and new names side by side while callers move over."""
    return df.select("*", *[F.col(old).alias(new) for old, new in mapping.items()])


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """Rows where the check is false; null passes."""
    return df.where(~condition)


def pk_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Key values that stop a primary key: duplicates and nulls, with their row count."""
    has_null = reduce(Column.__or__, [F.col(c).isNull() for c in cols])
    counted = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("rows")).withColumn("has_null", has_null)
    return counted.where((F.col("rows") > 1) | F.col("has_null"))


@dataclass(frozen=True)
class Check:
    """A named row check: ``bad`` marks offending rows; without it the check is skipped."""

    name: str
    bad: Column | None = None


def run_checks(df: DataFrame, suite: Sequence[Check]) -> DataFrame:
    """One row per check; all row checks share one pass over the table."""
    aggs = [F.count_if(F.coalesce(c.bad, F.lit(False))).alias(f"_{i}") for i, c in enumerate(suite) if c.bad is not None]
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs)

    def outcome(i: int, c: Check) -> Column:
        bad = F.col(f"_{i}") if c.bad is not None else F.lit(0).cast("long")
        return F.struct(
            F.lit(c.name).alias("name"),
            (bad == 0).alias("pass"),
            F.lit(c.bad is None).alias("skipped"),
            bad.alias("bad_rows"),
        )

    rows = counted.select(F.explode(F.array(*[outcome(i, c) for i, c in enumerate(suite)])).alias("r"))
    return rows.select("r.*")


def verify_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("pass") & ~F.col("skipped")).alias("passed"),
        F.count_if(~F.col("pass")).alias("failed"),
        F.count_if(F.col("skipped")).alias("skipped"),
    )
