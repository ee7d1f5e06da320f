"""SQL script corpora as DataFrames."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changewright.functions.ids import script_hash


def read_scripts(spark: SparkSession, folder: str, kind: str = "deploy") -> DataFrame:
    """``.sql`` files of one folder: path, kind, name, whole text."""
    files = spark.read.option("pathGlobFilter", "*.sql").text(folder, wholetext=True)
    return _named(files.select(F.col("_metadata.file_path").alias("path"), F.lit(kind).alias("kind"), F.col("value").alias("sql")))


def write_scripts(lines: DataFrame, folder: str, by: str = "name") -> None:
    """Rows (name, line) as files ``name.sql`` of a shared folder, lines in order; a row without name is left out.

    ``by`` is the name or a column that decides it.  The tasks write the files, each under its name once it is whole: the
    driver handles no file, and a repeated task writes the same.  The folder is on a file system that Arrow opens.
    """
    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    fs.FileSystem.from_uri(uri)
    placed = lines.where("name is not null").repartition(by).sortWithinPartitions("name", "line").select("name", "line")
    placed.mapInArrow(lambda batches: _write_files(batches, uri), "name string").write.format("noop").mode("overwrite").save()


def _write_files(batches: Iterable[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(uri)
    store.create_dir(root, recursive=True)
    draft, name, out = f"{root}/.{uuid.uuid4().hex}", None, None

    def done() -> None:
        out.close()
        store.move(draft, f"{root}/{name}.sql")

    for batch in batches:
        for own, line in zip(batch.column("name").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if own != name:
                if out is not None:
                    done()
                name, out = own, store.open_output_stream(draft)
            out.write(f"{line or ''}\n".encode())
    if out is not None:
        done()
    yield pa.RecordBatch.from_pydict({"name": pa.array([], pa.string())})


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("name", F.regexp_extract("path", r"([^/]+)\.sql$", 1))


def read_script_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Path, name and sha1 of the raw bytes of each ``.sql`` file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sql").load(folder)
    return _named(files.select("path", script_hash(F.col("content")).alias("script_hash")))


def scripts_in_plan(scripts: DataFrame, plan: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Scripts that some planned change names."""
    return scripts.join(plan.select(*keys, "name"), [*keys, "name"], "left_semi")


def changed_scripts(scripts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Scripts that are new or differ from the ``(path, script_hash)`` manifest."""
    return scripts.join(manifest.select("path", "script_hash"), ["path", "script_hash"], "left_anti")
