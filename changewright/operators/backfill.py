"""Batched backfills: planning, resumable runs, job log, progress and pressure."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changewright.functions.values import interval_seconds
from changewright.operators import ordered
from changewright.session import cut, read_table

# Job states and the steps allowed between them.
STATUSES = ("pending", "running", "paused", "done", "failed", "dead", "cancelled")
JOB_STEPS = (
    ("pending", "running"), ("pending", "cancelled"),
    ("running", "done"), ("running", "failed"), ("running", "dead"), ("running", "paused"), ("running", "cancelled"),
    ("paused", "running"), ("paused", "cancelled"),
    ("failed", "running"), ("failed", "dead"),
    ("dead", "running"),
)
STALE_MS = 300_000
PARTITIONS = 3
LAG_LIMIT_S = 10
DEAD_LIMIT = 0.10
BATCH_SIZE = 1000


# -- batches -----------------------------------------------------------------


def assign_batches(df: DataFrame, pk: str, size: int = BATCH_SIZE, last_pk=None) -> DataFrame:
    """Rows after ``last_pk`` with the batch each belongs to, in key order."""
    rows = df if last_pk is None else df.where(F.col(pk) > F.lit(last_pk))
    numbered = ordered.number_by(rows, [], [F.col(pk)], "_seq")
    return numbered.withColumn("batch_no", F.floor((F.col("_seq") - 1) / size) + 1).drop("_seq")


def plan_batches(df: DataFrame, pk: str, size: int = BATCH_SIZE, last_pk=None) -> DataFrame:
    """Batches of ``size`` keys: number, first and last key, rows.

    Keys are range-sorted across all tasks; only the per-slice counts are
    combined to give global numbers.
    """
    rows = assign_batches(df.select(pk), pk, size, last_pk)
    return rows.groupBy("batch_no").agg(F.min(pk).alias("min_pk"), F.max(pk).alias("max_pk"), F.count(F.lit(1)).alias("rows"))


def merge_ranges(ranges: DataFrame, low: str = "min_pk", high: str = "max_pk") -> DataFrame:
    """Union of the closed key ranges: (min_pk, end) of each stretch that they cover without a gap between them.

    A range opens a new stretch if it starts behind everything that earlier starts have reached.
    """
    starts = ranges.groupBy(F.col(low).alias("_low")).agg(F.max(high).alias("_high"))
    sliced = ordered.slice_by_sort(starts, [], [F.col("_low")])
    reached = ordered.running_max(sliced, [], F.col("_high"), "_reach", own=False)
    opens = F.when(F.col("_reach").isNull() | (F.col("_low") > F.col("_reach")), F.col("_low"))
    stretches = ordered.fill_down(reached, [], opens, "min_pk")
    return stretches.groupBy("min_pk").agg(F.max("_high").alias("end"))


def run_backfill(
    df: DataFrame,
    pk: str,
    transform: Callable[[DataFrame], DataFrame],
    batches: DataFrame,
    out: str,
    log: str,
    batches_per_commit: int = 1000,
) -> DataFrame:
    """Write every unfinished batch through ``transform``; returns the log.

    A batch is its key range.  What is done is the union of all logged ranges, whatever plans they came from: batches
    inside it are left out before any row is read, and rows inside it are left out of the others, so any mix of
    sizes, subsets and repeated runs gives what one full run gives.  A logged range has the rows that were written
    for it; ranges without any are not logged.  Batches may overlap: a row belongs to the one that reaches furthest.
    ``batches_per_commit`` batches share an output directory under the id of this run; output counts only if the log
    names it (``backfilled``), so a failed run leaves nothing behind that is read.  ``pk`` is unique in ``df``.
    Rows are sorted by key once; only keys between the first and the last open batch are read.
    """
    spark = df.sparkSession
    run = uuid.uuid4().hex
    todo = batches.withColumn("commit_no", F.floor((F.col("batch_no") - 1) / batches_per_commit))
    done = read_table(spark, log)
    points = []
    if done is not None:
        stretches = cut(merge_ranges(done, "min_pk", "last_pk").withColumn("_all", F.lit(0)))
        points.append((stretches, "min_pk", F.col("end"), "_end"))
        todo = ordered.asof_all(todo.withColumn("_all", F.lit(0)), ["_all"], "min_pk", points).where("_end is null or _end < max_pk").drop("_end", "_all")
    todo = cut(todo)
    first, last = todo.agg(F.min("min_pk"), F.max("max_pk")).first()
    if first is None:
        return done
    batch = F.struct("max_pk", "batch_no", "commit_no")
    starts = todo.groupBy("min_pk").agg(F.max(batch).alias("_b"))
    furthest = ordered.running_max(ordered.slice_by_sort(starts, [], [F.col("min_pk")]), [], F.col("_b"), "_far")
    points.append((furthest.withColumn("_all", F.lit(0)), "min_pk", F.col("_far"), "_b"))
    rows = df.where(F.col(pk).between(F.lit(first), F.lit(last))).withColumn("_all", F.lit(0))
    rows = ordered.asof_all(rows, ["_all"], pk, points).drop("_all").where(F.col("_b").isNotNull() & (F.col(pk) <= F.col("_b.max_pk")))
    if done is not None:
        rows = rows.where(F.col("_end").isNull() | (F.col(pk) > F.col("_end"))).drop("_end")
    placed = rows.withColumns({"batch_no": F.col("_b.batch_no"), "commit_no": F.col("_b.commit_no")}).drop("_b")
    transform(placed).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run", "commit_no").parquet(out)
    written = placed.groupBy("batch_no").agg(F.count(F.lit(1)).alias("rows"))
    entry = todo.drop("rows").join(written, "batch_no").select(F.lit(run).alias("run"), "commit_no", "batch_no", "min_pk", F.col("max_pk").alias("last_pk"), "rows")
    if not entry.isEmpty():
        entry.write.mode("append").parquet(log)
    return read_table(spark, log)


def backfilled(spark: SparkSession, out: str, log: str) -> DataFrame:
    """Output of all finished runs."""
    runs = spark.read.parquet(log).select("run").distinct()
    return spark.read.parquet(out).join(runs, "run", "left_semi").drop("run", "commit_no")


def batch_totals(batches: DataFrame, job: str = "job_id") -> DataFrame:
    return batches.groupBy(job).agg(
        F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), F.max("last_pk").alias("last_pk")
    )


# -- jobs --------------------------------------------------------------------


def count_by_status(jobs: DataFrame, by: Sequence[str] = ("partition_id",)) -> DataFrame:
    """Jobs per status, zero-filled for all seven."""
    return jobs.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def latest_job(jobs: DataFrame, name: str | None = None) -> DataFrame:
    """Newest job of each name (or of one name); the larger id breaks ties."""
    rows = jobs if name is None else jobs.where(F.col("name") == name)
    rest = [c for c in jobs.columns if c != "name"]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("_j")
    return rows.groupBy("name").agg(newest).select("name", "_j.*")


def list_jobs(jobs: DataFrame, status: str | None = None, partition_id: int | None = None) -> DataFrame:
    rows = jobs
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if partition_id is not None:
        rows = rows.where(F.col("partition_id") == partition_id)
    return rows.orderBy("id")


def next_job(jobs: DataFrame, active: int | None = None) -> DataFrame:
    """First pending job per partition, or of the active one."""
    rows = jobs.where("status = 'pending'")
    if active is not None:
        rows = rows.where(F.col("partition_id") == active)
    return rows.groupBy("partition_id").agg(F.min("id").alias("id"))


def job_state(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Latest state per job; ``attempt`` grows on start and retry, not on resume.

    ``events`` has ``step``: created, start, retry, resume, heartbeat, done,
    failed, dead, paused or cancelled; heartbeats do not change the state.
    """
    states = F.create_map(*[F.lit(x) for pair in (
        ("created", "pending"), ("start", "running"), ("retry", "running"), ("resume", "running"),
        ("done", "done"), ("failed", "failed"), ("dead", "dead"), ("paused", "paused"), ("cancelled", "cancelled"),
    ) for x in pair])
    real = F.col("step") != "heartbeat"
    at = F.struct("at", "event_id")
    return events.groupBy(key).agg(
        states[F.max_by("step", F.when(real, at))].alias("status"),
        F.count_if(F.col("step").isin("start", "retry")).alias("attempt"),
        F.max(F.when(F.col("step").isin("start", "retry", "resume", "heartbeat"), F.col("at"))).alias("heartbeat_at"),
    )


def bad_transitions(events: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Steps that the job life cycle does not allow.

    ``events`` has ``at``, ``event_id`` and ``status``; the order is total, so
    a job with very many events is cut into sorted slices.
    """
    rows = events.select(*keys, "at", "event_id", "status")
    sliced = ordered.slice_by_sort(rows, keys, [F.col("at"), F.col("event_id")])
    steps = ordered.unsliced(ordered.neighbour(sliced, keys, F.col("status"), "from_status", -1))
    allowed = F.struct("from_status", "status").isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in JOB_STEPS])
    return steps.where(F.col("from_status").isNotNull() & ~allowed)


def fail_outcome(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("outcome", F.when(F.col("attempt") >= F.col("max_retries"), "dead").otherwise("failed"))


def retire_drained(jobs: DataFrame, active: int) -> DataFrame:
    """Rotate: the partition two after the active one is emptied and becomes active."""
    drain = (active + 2) % PARTITIONS
    return jobs.where(F.col("partition_id") != drain)


def write_rotation(jobs: DataFrame, active: int, path: str) -> int:
    """Persist a rotation as partition directories; returns the new active partition."""
    drain = (active + 2) % PARTITIONS
    kept = retire_drained(jobs, active)
    kept.write.mode("overwrite").partitionBy("partition_id").parquet(path)
    return drain


# -- health ------------------------------------------------------------------


def _age_ms(now: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", F.col("heartbeat_at"), now)


def stale_jobs(jobs: DataFrame, now: Column, limit_ms: int = STALE_MS) -> DataFrame:
    """Running jobs with an old heartbeat and what they become; no heartbeat is not stale here."""
    old = F.timestamp_diff("MICROSECOND", F.col("heartbeat_at"), now) > limit_ms * 1000
    return fail_outcome(jobs.where((F.col("status") == "running") & old))


def stale_report(jobs: DataFrame, now: Column, limit_ms: int = STALE_MS) -> DataFrame:
    """Monitoring view: a running job without any heartbeat is stale, its age unknown."""
    age = _age_ms(now)
    stale = F.col("heartbeat_at").isNull() | (F.timestamp_diff("MICROSECOND", F.col("heartbeat_at"), now) > limit_ms * 1000)
    return jobs.where(F.col("status") == "running").withColumns({"age_ms": age, "is_stale": stale}).where("is_stale")


def progress(jobs: DataFrame) -> DataFrame:
    """Percentage, rate and remaining time from ``rows_done``, ``rows_total``, ``elapsed_ms``.

    Whole-number arithmetic in decimals: two digits, halves up.
    """
    done, total, elapsed = (F.col(c).cast("decimal(18,0)") for c in ("rows_done", "rows_total", "elapsed_ms"))
    known = total > 0
    moving = known & (elapsed > 0) & (done > 0)
    clamped = F.least(done, total)
    percent = F.when(known, F.round(clamped * 100 / F.when(known, total), 2)).otherwise(100)
    rate = F.when(moving, F.round(done * 1000 / F.when(moving, elapsed), 2)).otherwise(0)
    eta = F.when(moving, F.round((total - clamped) * elapsed / F.when(moving, done), 0))
    return jobs.withColumns({
        "rows_done": F.when(known, clamped).otherwise(done).cast("long"),
        "rows_total": F.greatest(total, F.lit(0)).cast("long"),
        "percentage": percent.cast("decimal(5,2)"),
        "rows_per_second": rate.cast("decimal(20,2)"),
        "eta_ms": eta.cast("long"),
    })


def max_lag(replicas: DataFrame, limit_s: float = LAG_LIMIT_S) -> DataFrame:
    """Most lagged replica, unknown lag last; no replica means zero lag."""
    seconds = interval_seconds(F.col("replay_lag"))
    known = F.col("replay_lag").isNotNull()
    top = F.max(F.struct(known.alias("known"), seconds.alias("lag_seconds"), F.col("replica"))).alias("_t")
    lag = F.coalesce("_t.lag_seconds", F.lit(0.0))
    return replicas.agg(top).select(lag.alias("lag_seconds"), F.col("_t.replica").alias("replica"), (lag > limit_s).alias("exceeds"))


def dead_ratio(stats: DataFrame, limit: float = DEAD_LIMIT) -> DataFrame:
    """Share of dead rows: shown to four digits, compared unrounded (as whole numbers)."""
    live, dead = F.col("live_rows").cast("decimal(20,0)"), F.col("dead_rows").cast("decimal(20,0)")
    total = live + dead
    ratio = F.when(total > 0, dead / F.when(total > 0, total)).otherwise(0)
    over = (total > 0) & (dead > total * F.lit(limit).cast("decimal(10,6)"))
    return stats.withColumns({"dead_ratio": F.round(ratio, 4).cast("decimal(5,4)"), "exceeds": over})


def pause_reason(health: DataFrame, lag_limit_s: float = LAG_LIMIT_S, dead_limit: float = DEAD_LIMIT) -> DataFrame:
    """Why a backfill should wait: replica lag first, then dead rows, else null."""
    replica = F.when(F.col("replica").isNotNull(), F.format_string(" (replica %s)", F.col("replica"))).otherwise("")
    lag = F.when(
        F.col("lag_seconds") > lag_limit_s,
        F.concat(F.lit("replica lag "), F.format_string("%.1f", "lag_seconds"), F.lit(f" s above {lag_limit_s:g} s"), replica),
    )
    share = F.col("dead_ratio").cast("double")
    dead = F.when(
        F.col("exceeds"),
        F.concat(F.lit("dead rows "), F.format_string("%.1f", share * 100), F.lit(f" % above {dead_limit * 100:.1f} % on "), F.col("table_name")),
    )
    return health.withColumn("reason", F.coalesce(lag, dead))


def active_queries(sessions: DataFrame, now: Column, prefix: str, own_pid: int | None = None) -> DataFrame:
    """Sessions of the tool (application name ``<prefix>/...``), longest running first."""
    rows = sessions.where(F.startswith(F.col("application_name"), F.lit(prefix + "/")))
    if own_pid is not None:
        rows = rows.where(F.col("pid") != own_pid)
    seconds = F.floor(F.timestamp_diff("MICROSECOND", F.col("query_start"), now) / 1_000_000 + 0.5)
    return rows.withColumn("duration_ms", F.coalesce(seconds * 1000, F.lit(0)).cast("long")).orderBy(F.col("query_start").asc_nulls_last(), "pid")
