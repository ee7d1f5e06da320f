"""Queries over batched backfills and their job log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from changewright.catalog.registry import query
from changewright.fixtures import JOB_EVENTS_SQL, JOBS_SQL, job_events, jobs, micros, table
from changewright.functions import values as V
from changewright.operators import backfill as B
from changewright.session import checkpoint_dir

J, JE = "WITH " + JOBS_SQL, "WITH " + JOB_EVENTS_SQL
NOW = "1999-06-01 00:00:00"


def _now():
    return F.expr(f"timestamp_ntz'{NOW}'")


@query("plan_batches", """SELECT (rn - 1) // 500 + 1 AS batch_no, min(o_orderkey) AS min_pk, max(o_orderkey) AS max_pk, count(*) AS rows
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderkey > 120) GROUP BY 1""")
def plan_batches(s, d):
    return B.plan_batches(table(s, d, "orders"), "o_orderkey", 500, last_pk=120)


@query("batch_totals", """SELECT l_suppkey AS job_id, count(*) AS batches, CAST(sum(l_quantity) AS BIGINT) AS rows, max(l_partkey) AS last_pk FROM lineitem GROUP BY 1""")
def batch_totals(s, d):
    l = table(s, d, "lineitem")
    return B.batch_totals(l.select(F.col("l_suppkey").alias("job_id"), F.col("l_quantity").cast("long").alias("rows"), F.col("l_partkey").alias("last_pk")))


@query("count_by_status", f"{J} SELECT partition_id, " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in B.STATUSES) + " FROM jobs GROUP BY 1")
def count_by_status(s, d):
    return B.count_by_status(jobs(s, d))


@query("latest_job", f"{J} SELECT name, arg_max(id, (created_at, id)) AS id, arg_max(status, (created_at, id)) AS status FROM jobs GROUP BY 1")
def latest_job(s, d):
    return B.latest_job(jobs(s, d)).select("name", "id", "status")


@query("list_jobs", f"{J} SELECT id, name, attempt FROM jobs WHERE status = 'failed' AND partition_id = 1")
def list_jobs(s, d):
    return B.list_jobs(jobs(s, d), "failed", 1).select("id", "name", "attempt")


@query("next_job", f"{J} SELECT partition_id, min(id) AS id FROM jobs WHERE status = 'pending' GROUP BY 1")
def next_job(s, d):
    return B.next_job(jobs(s, d))


@query("job_state", f"""{JE} SELECT job_id, CASE arg_max(step, (ts, event_id)) FILTER (step <> 'heartbeat') WHEN 'created' THEN 'pending' WHEN 'start' THEN 'running'
    WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' END AS status,
  count(*) FILTER (step = 'start') AS attempt, epoch_us(max(ts) FILTER (step IN ('start', 'heartbeat'))) AS heartbeat_us FROM job_events GROUP BY 1""")
def job_state(s, d):
    out = B.job_state(job_events(s, d))
    return out.select("job_id", "status", "attempt", micros(F.col("heartbeat_at")).alias("heartbeat_us"))


def _states(s, d):
    e = job_events(s, d).where("step <> 'heartbeat'")
    return e.withColumn("status", F.when(F.col("step") == "created", "pending").when(F.col("step") == "start", "running").otherwise(F.col("step")))


@query("bad_transitions", f"""{JE}, st AS (SELECT job_id, ts, event_id, CASE step WHEN 'created' THEN 'pending' WHEN 'start' THEN 'running' ELSE step END AS status FROM job_events WHERE step <> 'heartbeat'),
l AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS from_status FROM st)
SELECT job_id, event_id, from_status, status FROM l WHERE from_status IS NOT NULL AND (from_status, status) NOT IN (
  ('pending', 'running'), ('pending', 'cancelled'), ('running', 'done'), ('running', 'failed'), ('running', 'dead'), ('running', 'paused'), ('running', 'cancelled'),
  ('paused', 'running'), ('paused', 'cancelled'), ('failed', 'running'), ('failed', 'dead'), ('dead', 'running'))""")
def bad_transitions(s, d):
    return B.bad_transitions(_states(s, d)).select("job_id", "event_id", "from_status", "status")


@query("fail_outcome", f"{J} SELECT id, CASE WHEN attempt >= max_retries THEN 'dead' ELSE 'failed' END AS outcome FROM jobs WHERE status = 'running'")
def fail_outcome(s, d):
    return B.fail_outcome(jobs(s, d).where("status = 'running'")).select("id", "outcome")


@query("stale_jobs", f"""{J} SELECT id, CASE WHEN attempt >= max_retries THEN 'dead' ELSE 'failed' END AS outcome FROM jobs
WHERE status = 'running' AND heartbeat_at < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE""")
def stale_jobs(s, d):
    return B.stale_jobs(jobs(s, d), _now()).select("id", "outcome")


@query("stale_report", f"""{J} SELECT id, epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(heartbeat_at) AS age_ms FROM jobs
WHERE status = 'running' AND (heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE)""")
def stale_report(s, d):
    return B.stale_report(jobs(s, d), _now()).select("id", "age_ms")


@query("retire_drained", f"{J} SELECT id, partition_id FROM jobs WHERE partition_id <> (1 + 2) % 3")
def retire_drained(s, d):
    return B.retire_drained(jobs(s, d), 1).select("id", "partition_id")


@query("progress", """WITH p AS (SELECT o_orderkey AS id, o_custkey * 3 AS rows_done, o_orderkey % 4000 AS rows_total, CAST(floor(o_totalprice) AS BIGINT) % 90000 AS elapsed_ms FROM orders),
h AS (SELECT *, CAST(rows_done AS HUGEINT) AS dn, CAST(rows_total AS HUGEINT) AS tt, CAST(elapsed_ms AS HUGEINT) AS el, rows_total > 0 AND elapsed_ms > 0 AND rows_done > 0 AS mv FROM p)
SELECT id, CAST(CASE WHEN tt > 0 THEN least(dn, tt) ELSE dn END AS BIGINT) AS rows_done, rows_total,
  CASE WHEN tt > 0 THEN CAST((least(dn, tt) * 20000 + tt) // (2 * tt) AS BIGINT) ELSE 10000 END AS percent_100,
  CASE WHEN mv THEN CAST((dn * 200000 + el) // (2 * el) AS BIGINT) ELSE 0 END AS rate_100,
  CASE WHEN mv THEN CAST(((tt - least(dn, tt)) * el * 2 + dn) // (2 * dn) AS BIGINT) END AS eta_ms FROM h""")
def progress(s, d):
    o = table(s, d, "orders")
    rows = o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 3).alias("rows_done"), (F.col("o_orderkey") % 4000).alias("rows_total"),
        (F.floor("o_totalprice") % 90000).alias("elapsed_ms"),
    )
    out = B.progress(rows)
    return out.select("id", "rows_done", "rows_total", (F.col("percentage") * 100).cast("long").alias("percent_100"), (F.col("rows_per_second") * 100).cast("long").alias("rate_100"), "eta_ms")


LAG_SQL = "CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN (event_id % 3) || ' days 01:02:03' WHEN user_id % 5 = 2 THEN '00:00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || '.25' WHEN user_id % 5 = 3 THEN event_id || 'x' ELSE 'soon' END"
LAG_SECONDS = "CASE WHEN user_id % 5 = 1 THEN (event_id % 3) * 86400 + 3723 WHEN user_id % 5 = 2 THEN event_id % 60 + 0.25 WHEN user_id % 5 = 3 THEN event_id ELSE 0 END"


def _lag():
    u, e = F.col("user_id") % 5, F.col("event_id")
    return (
        F.when(u == 0, None).when(u == 1, F.concat((e % 3).cast("string"), F.lit(" days 01:02:03")))
        .when(u == 2, F.concat(F.lit("00:00:"), F.lpad((e % 60).cast("string"), 2, "0"), F.lit(".25")))
        .when(u == 3, F.concat(e.cast("string"), F.lit("x"))).otherwise("soon")
    )


@query("interval_seconds", f"SELECT event_id, CAST(({LAG_SECONDS}) * 1000 AS BIGINT) AS millis FROM events")
def interval_seconds(s, d):
    return table(s, d, "events").select("event_id", (V.interval_seconds(_lag()) * 1000).cast("long").alias("millis"))


@query("max_lag", f"""SELECT CAST(1000 * max({LAG_SECONDS}) FILTER (({LAG_SQL}) IS NOT NULL) AS BIGINT) AS lag_ms, max({LAG_SECONDS}) > 10 AS exceeds FROM events""")
def max_lag(s, d):
    rows = table(s, d, "events").select(_lag().alias("replay_lag"), F.col("event_id").cast("string").alias("replica"))
    return B.max_lag(rows).select((F.col("lag_seconds") * 1000).cast("long").alias("lag_ms"), "exceeds")


STATS_SQL = """st AS (SELECT l_suppkey AS table_no, count(*) FILTER (l_returnflag <> 'R') AS live_rows, count(*) FILTER (l_returnflag = 'R' AND l_tax > 0.05) AS dead_rows,
  max(l_linenumber + l_quantity) / 4 AS lag_seconds FROM lineitem GROUP BY 1)"""


def _stats(s, d):
    l = table(s, d, "lineitem")
    dead = (F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.05)
    return l.groupBy(F.col("l_suppkey").alias("table_no")).agg(
        F.count_if(F.col("l_returnflag") != "R").alias("live_rows"), F.count_if(dead).alias("dead_rows"),
        (F.max(F.col("l_linenumber") + F.col("l_quantity")) / 4).alias("lag_seconds"),
    )


@query("dead_ratio", f"""WITH {STATS_SQL} SELECT table_no, CASE WHEN live_rows + dead_rows = 0 THEN 0 ELSE (dead_rows * 20000 + live_rows + dead_rows) // (2 * (live_rows + dead_rows)) END AS ratio_10000,
  dead_rows * 10 > live_rows + dead_rows AS exceeds FROM st""")
def dead_ratio(s, d):
    return B.dead_ratio(_stats(s, d)).select("table_no", (F.col("dead_ratio") * 10000).cast("long").alias("ratio_10000"), "exceeds")


@query("pause_reason", f"""WITH {STATS_SQL} SELECT table_no, CASE WHEN lag_seconds > 13 THEN 'lag' WHEN dead_rows * 10 > live_rows + dead_rows THEN 'dead' END AS cause,
  CASE WHEN lag_seconds > 13 THEN 'replica lag ' || printf('%.1f', floor(lag_seconds * 10 + 0.5) / 10) || ' s above 13 s (replica r' || table_no || ')' END AS lag_text FROM st""")
def pause_reason(s, d):
    health = B.dead_ratio(_stats(s, d)).withColumn("replica", F.concat(F.lit("r"), F.col("table_no").cast("string")))
    out = B.pause_reason(health.withColumn("table_name", F.lit("public.t")), lag_limit_s=13)
    lag = F.col("reason").startswith("replica lag")
    cause = F.when(lag, "lag").when(F.col("reason").startswith("dead rows"), "dead")
    return out.select("table_no", cause.alias("cause"), F.when(lag, F.col("reason")).alias("lag_text"))


@query("active_queries", f"""SELECT o_orderkey AS pid, coalesce((epoch_us(TIMESTAMP '2002-01-01 00:00:00') - epoch_us(qs) + 500000) // 1000000 * 1000, 0) AS duration_ms
FROM (SELECT o_orderkey, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS qs, o_orderstatus FROM orders) WHERE o_orderstatus = 'F' AND o_orderkey <> 7""")
def active_queries(s, d):
    o = table(s, d, "orders")
    app = F.when(F.col("o_orderstatus") == "F", "tool/batch").otherwise("toolbox")
    rows = o.select(F.col("o_orderkey").alias("pid"), app.alias("application_name"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate")).alias("query_start"))
    return B.active_queries(rows, F.expr("timestamp_ntz'2002-01-01 00:00:00'"), "tool", own_pid=7).select("pid", "duration_ms")


@query("duration_ms", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN event_id * 1000 ELSE event_id * 1000 + 500 END AS millis FROM events""")
def duration_ms(s, d):
    e = F.col("event_id").cast("string")
    unit = F.col("event_id") % 4
    text = F.when(unit == 0, e).when(unit == 1, F.concat(F.lit(" "), e, F.lit(" MS"))).when(unit == 2, F.concat(e, F.lit("s"))).otherwise(F.concat(e, F.lit(".5sec")))
    return table(s, d, "events").select("event_id", V.duration_ms(text).alias("millis"))


@query("backoff_ms", "SELECT event_id, least(1000 * power(2, user_id % 9), 30000)::BIGINT AS wait_ms FROM events")
def backoff_ms(s, d):
    return table(s, d, "events").select("event_id", V.backoff_ms(F.col("user_id") % 9).alias("wait_ms"))


@query("lock_timeouts", """SELECT event_id, event_type IN ('view', 'click', 'error') AS is_lock_timeout FROM events""")
def lock_timeouts(s, d):
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", "ERROR:  Canceling statement due to lock timeout").when(kind == "click", "could not obtain lock on row")
        .when(kind == "error", "55P03 LOCK_NOT_AVAILABLE").otherwise("deadlock detected")
    )
    return table(s, d, "events").select("event_id", V.is_lock_timeout(F.concat(text, F.lit(" "), "props")).alias("is_lock_timeout"))


@query("error_logs", """SELECT event_id, CASE WHEN event_type <> 'signup' THEN CASE event_type WHEN 'view' THEN 'ERROR' WHEN 'click' THEN 'FATAL' WHEN 'error' THEN 'PANIC' ELSE 'ERROR' END END AS severity,
  CASE WHEN event_type = 'view' THEN 'deploy/c' || event_id || '.sql:' || user_id END AS location,
  CASE WHEN event_type <> 'signup' THEN 'relation r' || user_id || ' does not exist' END AS message,
  CASE WHEN event_type = 'view' THEN 'check r' || user_id END AS hint FROM events""")
def error_logs(s, d):
    kind, user, key = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    body = F.concat(F.lit("relation r"), user, F.lit(" does not exist\nLINE 1: SELECT\n"))
    log = (
        F.when(kind == "view", F.concat(F.lit("NOTICE:  start\npsql:deploy/c"), key, F.lit(".sql:"), user, F.lit(": ERROR:  "), body, F.lit("HINT:  check r"), user))
        .when(kind == "click", F.concat(F.lit("FATAL:  "), body)).when(kind == "error", F.concat(F.lit("PANIC:  "), body, F.lit("ERROR:  later one")))
        .when(kind == "purchase", F.concat(F.lit("\nERROR:  "), body)).otherwise("all done")
    )
    return table(s, d, "events").select("event_id", V.parse_error_log(log).alias("e")).select("event_id", "e.severity", "e.location", "e.message", "e.hint")


@query("mask_uri", """SELECT event_id, CASE event_type WHEN 'view' THEN 'postgres://u' || user_id || ':***@db' || event_id || '/x' WHEN 'click' THEN 'db:pg://u' || user_id || ':***@h/y'
  ELSE 'postgres://u' || user_id || '@h/z' END AS masked FROM events""")
def mask_uri(s, d):
    kind, user, key = F.col("event_type"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.col("event_id").cast("string")
    uri = (
        F.when(kind == "view", F.concat(F.lit("postgres://"), user, F.lit(":pw"), key, F.lit("@db"), key, F.lit("/x")))
        .when(kind == "click", F.concat(F.lit("db:pg://"), user, F.lit(":p@ss@"), key, F.lit(":w@h/y")))
        .otherwise(F.concat(F.lit("postgres://"), user, F.lit("@h/z")))
    )
    return table(s, d, "events").select("event_id", V.mask_uri(uri).alias("masked"))


@query("run_backfill", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def run_backfill(s, d):
    """Runs whose ranges overlap in every way, which together must write each row once.

    A quarter in large batches, one small batch inside them, a stretch across the quarter's end, half of the table by
    ``last_pk``, then all of it in batches of another size, and once more.
    """
    folder = f"{checkpoint_dir(s)}/{uuid.uuid4().hex}"
    orders = table(s, d, "orders").select("o_orderkey", "o_totalprice")
    quarter, half = orders.agg(F.percentile_approx("o_orderkey", F.array(F.lit(0.25), F.lit(0.5)))).first()[0] or (None, None)

    def run(rows, batches):
        def doubled(x):
            return x.select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"), "commit_no")

        B.run_backfill(rows, "o_orderkey", doubled, batches, f"{folder}/out", f"{folder}/log", batches_per_commit=7)

    if half is not None:
        key = F.col("o_orderkey")
        run(orders, B.plan_batches(orders.where(key <= quarter), "o_orderkey", 1000))
        small = B.plan_batches(orders, "o_orderkey", 100)
        run(orders, small.where("batch_no = 5"))
        run(orders, small.where((F.col("max_pk") > quarter) & (F.col("min_pk") <= half) & (F.col("batch_no") % 3 > 0)))
        run(orders, B.plan_batches(orders, "o_orderkey", 700, last_pk=half))
        run(orders, small)
        run(orders, B.plan_batches(orders, "o_orderkey", 300))
    return B.backfilled(s, f"{folder}/out", f"{folder}/log")


@query("merge_ranges", """WITH r AS (SELECT o_orderkey AS lo, o_orderkey + CAST(floor(o_totalprice) AS BIGINT) % 7 AS hi FROM orders WHERE o_orderkey % 5 < 3),
m AS (SELECT *, max(hi) OVER (ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS no FROM m)
SELECT min(lo) AS min_pk, max(hi) AS "end" FROM g GROUP BY no""")
def merge_ranges(s, d):
    key = F.col("o_orderkey")
    ranges = table(s, d, "orders").where(key % 5 < 3).select(key.alias("min_pk"), (key + F.floor("o_totalprice").cast("long") % 7).alias("max_pk"))
    return B.merge_ranges(ranges)
