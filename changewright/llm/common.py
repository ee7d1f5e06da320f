"""Steps shared by the operators: row keys, text columns, shared-folder tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changewright import session

KEY = ["_id", "_t", "_s"]
NO_ID = -(2**63)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``session.cut`` that also frees the step's shuffle files at its end: the table stands for them."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        return session.cut(df)
    finally:
        conf.set(_CLEAN, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_columns(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Names a row by id and text.  Never null; equal for repeated rows, which so share every decision.

    The text stands as two hashes of 64 bits with different seeds, since any share of the rows may have one id.
    """
    text = [F.isnull(text_col), F.col(text_col)]
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(*text).alias("_t"), F.xxhash64(F.lit(1), *text).alias("_s")]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key, id and text only, so that no other column of ``docs`` can clash."""
    return docs.select(*key_columns(id_col, text_col), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def with_row(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key columns and the whole row as one struct ``_row``, for operators that hand rows on."""
    return docs.select(*key_columns(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unpack(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``_row`` under their own names."""
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; plain ``lower`` where a text has no other letters."""
    az = "abcdefghijklmnopqrstuvwxyz"
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, az.upper(), az)).otherwise(F.lower(text))


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table that ``cut`` wrote."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


__all__ = ["KEY", "NO_ID", "cut", "drop_table", "key_columns", "keyed", "lower_ascii", "table", "unpack", "with_row"]
