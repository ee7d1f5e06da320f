"""Streaming jobs over files written from the driver tables, run to the end of the input."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from changewright.catalog.audit import LINTED
from changewright.catalog.columns import APPLIED, CHANGE, _images, change_rows
from changewright.catalog.corpus import scripts
from changewright.catalog.history import E
from changewright.catalog.registry import query
from changewright.fixtures import change_events, micros, table
from changewright.session import checkpoint_dir
from changewright.streaming import jobs as J


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


def _drain(writer: DataStreamWriter, folder: str) -> None:
    run = writer.option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    run.awaitTermination()


def _stream_of(df: DataFrame, path: str, parts: Column | None = None, count: int = 1) -> DataFrame:
    """The rows as a stream of ``count`` batches, dealt by ``parts`` (0, 1, ...).

    Each batch is as many files as the rows have tasks, the same number for all, so a batch is read by many tasks too.
    """
    spark = df.sparkSession
    files = max(1, spark.sparkContext.defaultParallelism)
    for k in range(count):
        # names in order of the batches: the source takes files by time of change, then all of a batch at once
        part = df if parts is None else df.where(parts == k)
        part.repartition(files).write.option("maxRecordsPerFile", 0).mode("append").parquet(path)
        time.sleep(0.01)
    written = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-written // count))).parquet(path)


@query("history_stream", f"{E} SELECT target, project, change_id, name, epoch_us(committed_at) AS committed_us FROM deployed")
def history_stream(s, d):
    folder = _folder(s)
    log = change_events(s, d).select("target", "project", "event", "change_id", "name", F.col("committed_at").cast("timestamp").alias("committed_at"))
    again = log.unionByName(log.where("event = 'deploy'"))
    dealt = F.pmod(F.xxhash64("change_id", "committed_at"), F.lit(3))  # event times in no order
    _drain(J.history_stream(_stream_of(again, f"{folder}/in", dealt, 3), f"{folder}/out"), folder)
    J.compact_history(s, f"{folder}/out")
    out = J.history_state(s, f"{folder}/out")
    return out.select("target", "project", "change_id", "name", micros(F.col("committed_at")).alias("committed_us"))


LIMIT_MS, LATE_MS = 4 * 3600 * 1000, 3600 * 1000


@query("heartbeat_stream", f"""WITH b AS (SELECT user_id AS job_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type IN ('view', 'click')),
n AS (SELECT *, lead(ms) OVER (PARTITION BY job_id ORDER BY ms) AS next FROM b)
SELECT job_id, ms AS last_ms FROM n WHERE (next IS NULL OR next >= ms + {LIMIT_MS}) AND ms + {LIMIT_MS} <= (SELECT max(ms) FROM b) - {LATE_MS}""")
def heartbeat_stream(s, d):
    folder = _folder(s)
    beats = table(s, d, "events").where("event_type in ('view', 'click')").select(F.col("user_id").alias("job_id"), F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at"))
    span = beats.agg(F.min(F.unix_millis("at")), F.max(F.unix_millis("at"))).first()
    third = F.least(F.floor((F.unix_millis("at") - (span[0] or 0)) * 3 / F.lit(((span[1] or 0) - (span[0] or 0)) + 1)), F.lit(2))
    silent = J.heartbeat_stream(_stream_of(beats, f"{folder}/in", third, 3), LIMIT_MS, f"{LATE_MS} milliseconds")
    _drain(silent.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    out = s.read.schema("job_id long, last_heartbeat timestamp").parquet(f"{folder}/out")
    return out.select("job_id", F.unix_millis("last_heartbeat").alias("last_ms"))


@query("lint_stream", f"{LINTED} SELECT path, rule, severity, line, col FROM linted")
def lint_stream(s, d):
    folder = _folder(s)
    found = J.lint_stream(_stream_of(scripts(s, d), f"{folder}/in"))
    _drain(found.writeStream.format("parquet").option("path", f"{folder}/out"), folder)
    out = s.read.schema(found.schema).parquet(f"{folder}/out")
    return out.select("path", "rule", "severity", "line", F.col("column").alias("col"))


@query("sync_stream", APPLIED)
def sync_stream(s, d):
    """The changes of ``apply_changes`` in three batches, two of them folded into the base: same statement, same result."""
    folder = _folder(s)
    before, _ = _images(s, d)
    J.start_sync(before, f"{folder}/table", ["c_custkey"], CHANGE, ["seq"], buckets=8)
    stream = _stream_of(change_rows(s, d), f"{folder}/in", F.col("seq") - 1, 3)
    _drain(J.sync_stream(stream, f"{folder}/table"), folder)
    J.compact_sync(s, f"{folder}/table")
    J.vacuum_sync(s, f"{folder}/table")
    return J.synced_table(s, f"{folder}/table")
