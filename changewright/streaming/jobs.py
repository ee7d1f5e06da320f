"""Streaming twins: history fold, heartbeat watch, script audit, column sync.

Each sink names its output by batch id and overwrites it, so a batch that runs
again after a failure changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from changewright.operators import columns as X
from changewright.operators import lint as L
from changewright.schemas import SCRIPTS
from changewright.session import cut

KEYS = ("target", "project")


def _put(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


# -- history -----------------------------------------------------------------


def history_stream(events: DataFrame, path: str, keys: Sequence[str] = KEYS) -> DataStreamWriter:
    """Fold the deploy/revert log continuously.

    A batch only adds its own maxima per change; ``history_state`` combines them.  Maxima are associative and
    idempotent, so no event is ever too late, repeated events change nothing and nothing needs to be remembered.
    """
    def last(kind: str):
        return F.max(F.when(F.col("event") == kind, F.col("committed_at")))

    def fold(batch: DataFrame, batch_id: int) -> None:
        part = batch.where("event in ('deploy', 'revert')").groupBy(*keys, "change_id", "name")
        part = part.agg(last("deploy").alias("deployed_at"), last("revert").alias("reverted_at"))
        _put(part.withColumn("batch_id", F.lit(batch_id)), path, "batch_id")

    return events.writeStream.foreachBatch(fold).outputMode("append")


def compact_history(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> None:
    """Fold all batches but the newest, and earlier folds, into one new fold and delete what it stands for.

    The stream may not have committed its newest batch and may write it again, so that one is neither folded nor
    deleted.  Folds have negative ids, which no batch has, and never overwrite each other.  The fold is written before
    anything is deleted, and a maximum read twice is the same maximum, so a compaction that stops half-way may be
    repeated.
    """
    parts = spark.read.parquet(path)
    ids = sorted(r[0] for r in parts.select("batch_id").distinct().collect())  # one per batch
    old = ids[:-1]
    if len(old) < 2:
        return
    folded = cut(parts.where(F.col("batch_id") < ids[-1]).groupBy(*keys, "change_id", "name").agg(F.max("deployed_at").alias("deployed_at"), F.max("reverted_at").alias("reverted_at")))
    _put(folded.withColumn("batch_id", F.lit(min(ids[0], 0) - 1)), path, "batch_id")
    for batch_id in old:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def history_state(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Deployed changes according to everything ``history_stream`` has written."""
    parts = spark.read.parquet(path).groupBy(*keys, "change_id", "name")
    state = parts.agg(F.max("deployed_at").alias("committed_at"), F.max("reverted_at").alias("_r"))
    return state.where("committed_at is not null and (_r is null or committed_at > _r)").drop("_r")


# -- heartbeats --------------------------------------------------------------


def heartbeat_stream(beats: DataFrame, limit_ms: int = 300_000, lateness: str = "1 minute") -> DataFrame:
    """Every silence of a job that lasts the limit or longer: job_id and the last heartbeat before it.

    ``beats``: job_id, at.  A silence is the end of a session window with the limit as its gap, told once the
    watermark (the newest beat less ``lateness``) has passed it.  Sessions live in Spark's state, with map-side
    merging, so the answer does not depend on how beats fall into batches.
    """
    timed = beats.select("job_id", "at").withWatermark("at", lateness)
    sessions = timed.groupBy("job_id", F.session_window("at", f"{limit_ms} milliseconds")).agg(F.max("at").alias("last_heartbeat"))
    return sessions.select("job_id", "last_heartbeat")


# -- scripts -----------------------------------------------------------------


def script_stream(spark: SparkSession, folder: str, kind: str = "deploy") -> DataFrame:
    """New ``.sql`` files of a folder as a stream of scripts."""
    files = spark.readStream.option("pathGlobFilter", "*.sql").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.lit(kind).alias("kind"), F.col("value").alias("sql"))


def lint_stream(scripts: DataFrame, config: L.LintConfig = L.LintConfig()) -> DataFrame:
    """Audit of arriving scripts: the batch audit is stateless, so it runs on the stream as it is."""
    return L.lint(scripts.select(*SCRIPTS.names), config)


# -- column sync -------------------------------------------------------------
#
# A synced table is base files and change files, both by version and bucket, and a manifest:
#   meta                             one row: keys, order, column change, columns, number of buckets
#   base/version=v/bucket=b          rows of a bucket as of compaction v
#   changes/version=n/bucket=b       the changes of stream batch n - 1, as they came
#   manifest/version=v               (bucket, upto): base v of the bucket holds all changes up to version ``upto``
# A batch only adds change files, so what it writes follows the batch; readers merge.


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, version: int, path: str, keys: Sequence[str], buckets: int) -> None:
    """Rows by bucket; a bucket with very many rows is split over tasks."""
    placed = rows.withColumns({"version": F.lit(version).cast("long"), "bucket": _bucket(keys, buckets)})
    _put(placed.hint("rebalance", "bucket"), path, "version", "bucket")


def start_sync(table: DataFrame, path: str, keys: Sequence[str], change: X.ColumnChange, order: Sequence[str], buckets: int = 200) -> None:
    """Base version 0 of a synced table, and what every later step needs to know about it."""
    spark = table.sparkSession
    meta = [(json.dumps({"keys": list(keys), "order": list(order), "change": asdict(change), "buckets": buckets}), table.schema.json())]
    spark.createDataFrame(meta, "settings string, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    _write_buckets(table, 0, f"{path}/base", keys, buckets)
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("version"))
    _put(every.coalesce(1), f"{path}/manifest", "version")


def _settings(spark: SparkSession, path: str) -> tuple[list[str], list[str], X.ColumnChange, int, StructType]:
    row = spark.read.parquet(f"{path}/meta").first()
    known = json.loads(row["settings"])
    return known["keys"], known["order"], X.ColumnChange(**known["change"]), known["buckets"], StructType.fromJson(json.loads(row["columns"]))


def sync_stream(changes: DataFrame, path: str) -> DataStreamWriter:
    """Take in a change stream for two-way column sync; a batch is written as the change files of version batch + 1.

    A batch that runs again overwrites its own files.  ``synced_table`` applies the changes in the order of the
    batches and, inside one, in the order of the order columns.
    """
    keys, _, _, buckets, _ = _settings(changes.sparkSession, path)

    def add(batch: DataFrame, batch_id: int) -> None:
        _write_buckets(batch, batch_id + 1, f"{path}/changes", keys, buckets)

    return changes.writeStream.foreachBatch(add).outputMode("update")


def _current(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, version, upto) of the newest base of each bucket."""
    log = spark.read.schema("bucket int, upto long, version long").parquet(f"{path}/manifest")
    return log.groupBy("bucket").agg(F.max(F.struct("version", "upto")).alias("m")).select("bucket", "m.version", "m.upto")


def _change_files(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Versions of change files and the buckets of each, from the names of the folders."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/changes")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for v in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/changes/version=*/bucket=*")) or ():
        at = v.getPath()
        found.setdefault(int(at.getParent().getName().partition("=")[2]), []).append(int(at.getName().partition("=")[2]))
    return found


def _merged(spark: SparkSession, path: str, buckets: list[int] | None = None, upto: int | None = None) -> DataFrame:
    """Base rows with the changes that they do not hold yet (up to version ``upto``), of some or all buckets."""
    keys, order, change, _, columns = _settings(spark, path)
    now = _current(spark, path)
    if buckets is not None:
        now = now.where(F.col("bucket").isin(buckets))
    placed = StructType([*columns.fields, StructField("version", LongType()), StructField("bucket", IntegerType())])
    base = spark.read.schema(placed).parquet(f"{path}/base").join(now.select("version", "bucket"), ["version", "bucket"], "left_semi").select(*columns.names)
    if not _change_files(spark, path):
        return base
    log = spark.read.option("mergeSchema", "true").parquet(f"{path}/changes").withColumn("version", F.col("version").cast("long"))
    if upto is not None:
        log = log.where(F.col("version") <= upto)
    new = log.join(now.select("bucket", F.col("upto")), "bucket").where("version > upto").drop("bucket", "upto").withColumnRenamed("version", "_version")
    return X.apply_changes(base, new, keys, change, ["_version", *order])


def synced_table(spark: SparkSession, path: str) -> DataFrame:
    """The synced table as of all batches that were written."""
    return _merged(spark, path)


def compact_sync(spark: SparkSession, path: str, least_versions: int = 1) -> int:
    """Fold change files into new base files for buckets that have at least ``least_versions`` unfolded versions.

    The newest version is left alone: the stream may not have committed it and may write it again.  The manifest is
    written last, so a compaction that stops half-way changes nothing.  Returns the number of buckets folded.
    """
    keys, _, _, buckets, columns = _settings(spark, path)
    files = _change_files(spark, path)
    upto = max(files, default=0) - 1
    now = {r["bucket"]: r for r in _current(spark, path).collect()}  # one row per bucket
    waiting = {b: sum(now[b]["upto"] < v <= upto for v, bs in files.items() if b in bs) for b in now}
    chosen = sorted(b for b, n in waiting.items() if n >= max(least_versions, 1))
    if not chosen:
        return 0
    version = max(r["version"] for r in now.values()) + 1
    _write_buckets(_merged(spark, path, chosen, upto).select(*columns.names), version, f"{path}/base", keys, buckets)
    entry = spark.createDataFrame([(b, upto, version) for b in chosen], "bucket int, upto long, version long")
    _put(entry.coalesce(1), f"{path}/manifest", "version")
    return len(chosen)


def vacuum_sync(spark: SparkSession, path: str) -> int:
    """Delete base files that the manifest no longer names and change files that every base holds; returns their number.

    For times without readers of an older state.
    """
    now = {r["bucket"]: r for r in _current(spark, path).collect()}
    made = spark._jvm.org.apache.hadoop.fs.Path
    fs = made(path).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for at in [x.getPath() for x in fs.globStatus(made(f"{path}/base/version=*/bucket=*")) or ()]:
        if int(at.getParent().getName().partition("=")[2]) != now[int(at.getName().partition("=")[2])]["version"]:
            gone.append(at)
    for v, bs in _change_files(spark, path).items():
        gone += [made(f"{path}/changes/version={v}/bucket={b}") for b in bs if v <= now[b]["upto"]]
    for at in gone:
        fs.delete(at, True)
    return len(gone)
