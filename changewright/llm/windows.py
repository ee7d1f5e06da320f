"""Repeated runs of consecutive text units (lines or sentences), found over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewright.llm.common import KEY

NAME = ["_h", "_g"]


def runs_of(docs: DataFrame, units: Column, size: int) -> DataFrame:
    """One row per run of ``size`` units: key, start ``pos`` and its name of 96 bits (``_h``, ``_g``).

    A document of fewer units has no run; a run of empty units only is none.
    """
    named = docs.select(*KEY, F.transform(units, lambda u: F.struct(F.xxhash64(u).alias("h"), F.hash(u).alias("g"))).alias("u"))
    last = F.size("u") - size
    run = F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("pos"),
        F.xxhash64(*[F.get("u", i + j)["h"] for j in range(size)]).alias("h"),
        F.hash(*[F.get("u", i + j)["g"] for j in range(size)]).alias("g"),
    )))
    rows = named.where(last >= 0).select(*KEY, run.alias("r")).select(*KEY, "r.pos", F.col("r.h").alias("_h"), F.col("r.g").alias("_g"))
    blank = F.xxhash64(F.lit(""))
    return rows.where(F.col("_h") != F.xxhash64(*[blank] * size))


def covered_units(runs: DataFrame, size: int) -> DataFrame:
    """Key and ``covered``: the sorted positions inside any repeated run but its first.

    First is the least (id, text hash, position); a null id comes before all others.  Repeated rows share a key and
    so are one document here.  Counting and the least start are folded on the map side, so a run that a third of
    all documents hold moves as one row per task; the join back is a plain equi-join that AQE may split.
    """
    start = F.struct(*KEY, "pos")
    first = runs.groupBy(*NAME).agg(F.min(start).alias("first"), F.max(start).alias("last"))
    repeated = first.where("first <> last").select(*NAME, "first")
    later = runs.join(repeated, NAME).where(start != F.col("first")).select(*KEY, "pos")
    spans = later.groupBy(*KEY).agg(F.collect_set("pos").alias("p"))
    every = F.flatten(F.transform("p", lambda p: F.sequence(p, p + (size - 1))))
    return spans.select(*KEY, F.array_sort(F.array_distinct(every)).alias("covered"))


def kept_units(units: str, covered: str) -> Column:
    """``units`` without the positions in the sorted array ``covered`` (null: none), as slices between them."""
    before = F.concat(F.array(F.lit(-1)), F.col(covered))
    after = F.concat(F.col(covered), F.array(F.size(units)))
    gaps = F.filter(F.zip_with(before, after, lambda a, b: F.struct((a + 2).alias("at"), (b - a - 1).alias("n"))), lambda g: g["n"] > 0)
    return F.when(F.col(covered).isNull(), F.col(units)).otherwise(F.flatten(F.transform(gaps, lambda g: F.slice(units, g["at"], g["n"]))))
