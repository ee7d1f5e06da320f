"""Dependency and change-name helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(dep: Column) -> Column:
    """Dependency without its ``@tag``; a ``project:`` prefix stays."""
    return F.substring_index(dep, "@", 1)


def phase_of(name: Column) -> Column:
    return F.when(F.endswith(name, F.lit("_expand")), "expand").when(F.endswith(name, F.lit("_contract")), "contract")


def pair_base(name: Column) -> Column:
    """Common name of an expand/contract pair, null for other changes."""
    return F.when(phase_of(name).isNotNull(), F.regexp_replace(name, "_(expand|contract)$", ""))


def parse_deps(text: Column) -> Column:
    """``[a !b proj:c]`` to a struct of two arrays, ``requires`` and ``conflicts``."""
    inner = F.trim(F.regexp_replace(text, r"^\s*\[|\]\s*$", ""))
    words = F.filter(F.split(inner, r"\s+"), lambda w: w != "")
    return F.struct(
        F.filter(words, lambda w: ~w.startswith("!")).alias("requires"),
        F.transform(F.filter(words, lambda w: w.startswith("!")), lambda w: F.substring(w, 2, 1 << 30)).alias("conflicts"),
    )
