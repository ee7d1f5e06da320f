"""Report formats for findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewright.functions.ids import fingerprint

# How a severity is called by each consumer.
ANNOTATION_LEVELS = {"error": "error", "warn": "warning", "info": "notice"}
QUALITY_LEVELS = {"error": "critical", "warn": "major", "info": "minor"}


def _level(names: dict[str, str]) -> Column:
    out = F.when(F.lit(False), "")
    for severity, name in names.items():
        out = out.when(F.col("severity") == severity, name)
    return out


def _with_hint(text: Column) -> Column:
    return F.when(F.col("suggestion").isNotNull(), F.concat(text, F.lit(" — "), F.col("suggestion"))).otherwise(text)


def report_json(findings: DataFrame, by: Sequence[str] = ("path",), **metadata: str) -> DataFrame:
    """One JSON document per group (default: script) with version, metadata, findings and summary.

    A script's findings are bounded by its own text.  Null suggestions have no key.
    """
    def entry(x: Column) -> Column:
        location = F.struct(x["path"].alias("file"), x["line"].alias("line"), x["column"].alias("column"))
        return F.struct(x["rule"].alias("ruleId"), x["severity"].alias("severity"), x["message"].alias("message"), location.alias("location"), x["suggestion"].alias("suggestion"))

    # each field travels once, in the order that sorts the list
    listed = F.transform(F.array_sort(F.collect_list(F.struct("line", "column", "rule", "message", "severity", "path", "suggestion"))), entry)
    counts = [F.count_if(F.col("severity") == s).alias(n) for n, s in (("errors", "error"), ("warnings", "warn"), ("info", "info"))]
    grouped = findings.groupBy(*by).agg(listed.alias("findings"), F.struct(*counts).alias("summary"))
    meta = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]) if metadata else F.struct(F.lit("").alias("source"))
    document = F.struct(F.lit(1).alias("version"), meta.alias("metadata"), "findings", "summary")
    return grouped.select(*by, F.to_json(document).alias("json"))


def report_annotations(findings: DataFrame) -> DataFrame:
    """``::level file=..,line=..,col=..::RULE: message`` lines; write with ``.write.text``."""
    place = F.format_string(" file=%s,line=%d,col=%d::", "path", "line", "column")
    text = _with_hint(F.concat_ws(": ", "rule", "message"))
    return findings.select(F.concat(F.lit("::"), _level(ANNOTATION_LEVELS), place, text).alias("value"))


def report_code_quality(findings: DataFrame) -> DataFrame:
    """Entries with a stable fingerprint; write with ``.write.json``."""
    return findings.select(
        _with_hint(F.col("message")).alias("description"),
        F.col("rule").alias("check_name"),
        fingerprint(F.col("rule"), F.col("path"), F.col("line")).alias("fingerprint"),
        _level(QUALITY_LEVELS).alias("severity"),
        F.struct(F.col("path").alias("path"), F.struct(F.col("line").alias("begin")).alias("lines")).alias("location"),
    )
