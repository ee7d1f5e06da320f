"""Session helpers: where intermediate tables go and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    ``spark.checkpoint.dir`` decides.  Only a local session may fall back to a
    temporary folder; a cluster without the setting is refused, because a
    machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            configured = tempfile.mkdtemp(prefix="changewright-")
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return current


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as a table under the checkpoint folder and read it back, in folders by the columns ``by`` if any.

    This ends the lineage and survives executor loss.  Parquet rather than
    ``checkpoint()``: later steps then prune columns and know the real size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table that ``cut`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """The Parquet table at ``path``, or null if nothing was written there yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


#: Rows of a partition that ``spread`` makes, about: some seconds of heavy work.
SPREAD = 1 << 16


def spread(df: DataFrame, width: int = SPREAD) -> DataFrame:
    """Use all cores for heavy work on narrow rows, in tasks whose length does not follow the input.

    One small file is one partition, and a narrow table of millions of rows only a few.  The row count (of a Parquet
    table it is read from the footers) decides; input that has as many partitions is returned as it is: no shuffle.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // width))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df
