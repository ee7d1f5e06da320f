"""Line dedup: overlapping windows of three lines, repeated ones found globally, later occurrences removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewright.llm.common import KEY, key_columns, unpack, with_row
from changewright.llm.windows import covered_units, kept_units, runs_of

SIZE = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_decisions(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``_row`` (the whole row), n_lines, n_removed, n_spans, kept (text or null).

    A line goes if any window of ``size`` lines over it has an earlier occurrence, in the same document or another
    (order: id, null first, then position).  Kept lines are joined by newline.  A null text has 0 lines and stays
    null, an empty one is one empty line, a text of fewer lines than ``size`` keeps all.  Windows of empty lines do
    not count.  Repeated rows (same id and text) share the result of the first.
    """
    covered = covered_units(runs_of(docs.select(*key_columns(id_col, text_col), _lines(F.col(text_col)).alias("l")), F.col("l"), size), size)
    rows = with_row(docs, id_col, text_col).join(covered, KEY, "left")
    rows = rows.select("_row", F.col("_row").getField(text_col).alias("t"), "covered")
    split = rows.select("_row", "t", "covered", F.when(F.col("covered").isNotNull(), _lines(F.col("t"))).alias("l"))
    n_lines = F.when(F.col("t").isNull(), 0).when(F.col("covered").isNotNull(), F.size("l")).otherwise(F.length("t") - F.length(F.replace("t", F.lit("\n"))) + 1)
    ends = F.filter("covered", lambda p, i: (i == 0) | (p != F.get("covered", i - 1) + 1))
    return split.select(
        "_row", n_lines.cast("long").alias("n_lines"),
        F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed"),
        F.when(F.col("covered").isNull(), 0).otherwise(F.size(ends)).cast("long").alias("n_spans"),
        F.when(F.col("covered").isNull(), F.col("t")).otherwise(F.array_join(kept_units("l", "covered"), "\n")).alias("kept"),
    )


def line_dedup(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated lines removed from its texts and ``chars_col``, if there, counted anew.

    Rows that lose every line go; all others stay, null and empty texts too.
    """
    done = line_decisions(docs, size, id_col, text_col).where("n_removed = 0 or n_removed < n_lines")
    out = done.select(F.col("_row").withField(f"`{text_col}`", F.col("kept")).alias("_row"), "n_removed")
    if chars_col in docs.columns:
        recounted = F.col("_row").withField(f"`{chars_col}`", F.length(F.col("_row").getField(text_col)).cast(docs.schema[chars_col].dataType))
        out = out.select(F.when(F.col("n_removed") > 0, recounted).otherwise(F.col("_row")).alias("_row"))
    return unpack(out, docs.columns)
