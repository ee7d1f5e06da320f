"""Inputs derived from the driver tables, so that every query grows with them.

Each table is a projection or one equi-join of ``orders``, ``lineitem``,
``customer`` and ``events``.  ``SQL`` states the same derivations for the
oracles, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970; both engines agree on this form."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def plan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One planned change per order.

    About four changes of a project share a name (reworks).  A change requires
    the name at half its number, some also a ghost or a later name; 55 (target,
    project) pairs.
    """
    o = table(spark, sf_dir, "orders")
    slot = F.floor(F.col("o_orderkey") / 200)
    none = F.array().cast("array<string>")

    def chg(n: Column) -> Column:
        return F.concat(F.lit("chg_"), n.cast("string"))

    requires = F.concat(
        F.when(slot >= 2, F.array(chg(F.floor(slot / 2)))).otherwise(none),
        F.when(F.col("o_orderkey") % 97 == 0, F.array(F.concat(F.lit("ghost_"), F.col("o_orderkey").cast("string")))).otherwise(none),
        F.when((slot % 4 == 3) & (F.col("o_orderstatus") == "P"), F.array(chg(slot + 1))).otherwise(none),
    )
    conflicts = F.when(F.col("o_orderkey") % 31 == 0, F.array(chg(slot + 7))).otherwise(none)
    return o.select(
        F.concat(F.lit("db"), (F.col("o_custkey") % 5).cast("string")).alias("target"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 11).cast("string")).alias("project"),
        (F.col("o_orderkey") + 1).alias("pos"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("change_id"),
        chg(slot).alias("name"),
        F.col("o_orderdate").alias("planned_at"),
        F.sha1(F.concat_ws("-", "o_orderstatus", F.col("o_orderkey").cast("string")).cast("binary")).alias("script_hash"),
        requires.alias("requires"),
        conflicts.alias("conflicts"),
        "o_orderkey",
        "o_orderpriority",
    )


def plan_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release tags on every tenth order, a candidate tag on every fiftieth."""
    rows = plan_changes(spark, sf_dir).where("o_orderkey % 10 = 0")
    key = F.col("o_orderkey")
    release = F.concat(F.lit("v"), F.floor(key / 500).cast("string"))
    candidate = F.when(key % 50 == 0, F.concat(F.lit("rc"), key.cast("string")))
    names = F.array_compact(F.array(release, candidate))
    return rows.select("target", "project", "pos", "change_id", F.explode(names).alias("tag"))


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four log events per change, oldest orders first."""
    e = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 4).alias("o_orderkey"),
        F.when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "revert").otherwise("deploy").alias("event"),
        F.col("ts").alias("committed_at"),
        "event_id",
    )
    p = plan_changes(spark, sf_dir).select("target", "project", "change_id", "name", "script_hash", "planned_at", "o_orderkey")
    return e.join(p, "o_orderkey").drop("o_orderkey")


PLAN_SQL = """
plan_changes AS (
  SELECT 'db' || (o_custkey % 5) AS target, 'p' || (o_custkey % 11) AS project, o_orderkey + 1 AS pos,
         'c' || o_orderkey AS change_id, 'chg_' || (o_orderkey // 200) AS name, o_orderdate AS planned_at,
         sha1(o_orderstatus || '-' || o_orderkey) AS script_hash,
         (CASE WHEN o_orderkey // 200 >= 2 THEN ['chg_' || (o_orderkey // 400)] ELSE CAST([] AS VARCHAR[]) END
          || CASE WHEN o_orderkey % 97 = 0 THEN ['ghost_' || o_orderkey] ELSE CAST([] AS VARCHAR[]) END
          || CASE WHEN (o_orderkey // 200) % 4 = 3 AND o_orderstatus = 'P' THEN ['chg_' || (o_orderkey // 200 + 1)]
                  ELSE CAST([] AS VARCHAR[]) END) AS requires,
         CASE WHEN o_orderkey % 31 = 0 THEN ['chg_' || (o_orderkey // 200 + 7)] ELSE CAST([] AS VARCHAR[]) END AS conflicts,
         o_orderkey, o_orderpriority
  FROM orders),
plan_tags AS (
  SELECT target, project, pos, change_id, 'v' || (o_orderkey // 500) AS tag FROM plan_changes WHERE o_orderkey % 10 = 0
  UNION ALL SELECT target, project, pos, change_id, 'rc' || o_orderkey FROM plan_changes WHERE o_orderkey % 50 = 0)"""

EVENTS_SQL = PLAN_SQL + """,
change_events AS (
  SELECT CASE e.event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'revert' ELSE 'deploy' END AS event,
         p.target, p.project, p.change_id, p.name, p.script_hash, p.planned_at, e.ts AS committed_at, e.event_id
  FROM events e JOIN plan_changes p ON p.o_orderkey = e.event_id // 4),
deployed AS (
  SELECT target, project, change_id, name, committed_at FROM (
    SELECT *, row_number() OVER (PARTITION BY target, project, change_id ORDER BY committed_at DESC, event_id DESC) AS rn
    FROM change_events WHERE event IN ('deploy', 'revert'))
  WHERE rn = 1 AND event = 'deploy')"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of backfill jobs, one job per user."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    step = (
        F.when(kind == "signup", "created").when(kind == "view", "start").when(kind == "click", "heartbeat")
        .when(kind == "purchase", "done").otherwise("failed")
    )
    return e.select(F.col("user_id").alias("job_id"), "event_id", F.col("ts").alias("at"), step.alias("step"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows, one per order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = F.get(F.array(*[F.lit(s) for s in ("pending", "running", "paused", "done", "failed", "dead", "cancelled")]), (k % 7).cast("int"))
    return o.select(
        k.alias("id"), F.concat(F.lit("job_"), F.col("o_custkey").cast("string")).alias("name"), status.alias("status"),
        (k % 3).cast("int").alias("partition_id"), (F.col("o_custkey") % 5).cast("int").alias("attempt"), F.lit(3).alias("max_retries"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("heartbeat_at"), F.col("o_orderdate").alias("created_at"),
    )


def deployed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from changewright.operators.history import current_state

    return current_state(change_events(spark, sf_dir))


JOB_EVENTS_SQL = """
job_events AS (
  SELECT user_id AS job_id, event_id, ts,
         CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'start' WHEN 'click' THEN 'heartbeat'
                         WHEN 'purchase' THEN 'done' ELSE 'failed' END AS step
  FROM events)"""

JOBS_SQL = """
jobs AS (
  SELECT o_orderkey AS id, 'job_' || o_custkey AS name,
         ['pending', 'running', 'paused', 'done', 'failed', 'dead', 'cancelled'][o_orderkey % 7 + 1] AS status,
         CAST(o_orderkey % 3 AS INTEGER) AS partition_id, CAST(o_custkey % 5 AS INTEGER) AS attempt, 3 AS max_retries,
         CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS heartbeat_at, o_orderdate AS created_at
  FROM orders)"""
