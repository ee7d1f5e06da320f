"""Backfill runs, stores, sources, guards and streams on small data."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from changewright.functions import values as V
from changewright.operators import backfill as B
from changewright.operators import checks as D
from changewright.operators import columns as X
from changewright.operators import history as H
from changewright.operators import lint as L
from changewright.sources import history_store as S
from changewright.sources import scripts as C
from changewright.streaming import jobs as J


def test_batches_cover_each_key_once(spark):
    df = spark.range(0, 1003, 3).withColumnRenamed("id", "k")
    rows = B.plan_batches(df, "k", 50, last_pk=30).orderBy("batch_no").collect()
    assert sum(r.rows for r in rows) == df.where("k > 30").count() and all(r.rows == 50 for r in rows[:-1])
    assert all(a.max_pk < b.min_pk for a, b in zip(rows, rows[1:])) and rows[0].min_pk == 33


def test_backfill_resumes(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    df = spark.range(1, 101).withColumnRenamed("id", "k")
    batches = B.plan_batches(df, "k", 10)

    def twice(rows):
        return rows.withColumn("v", F.col("k") * 2)

    B.run_backfill(df, "k", twice, batches.where("batch_no <= 4"), out, log, batches_per_commit=2)
    seen = []

    def counted(rows):
        seen.append(rows.count())
        return twice(rows)

    done = B.run_backfill(df, "k", counted, batches, out, log, batches_per_commit=2)
    assert seen == [60] and done.count() == 10
    got = B.backfilled(spark, out, log)
    assert got.count() == 100 and got.where("v <> k * 2").count() == 0
    assert B.batch_totals(done.withColumn("job_id", F.lit(1))).first().asDict() == {"job_id": 1, "batches": 10, "rows": 100, "last_pk": 100}
    assert B.run_backfill(df, "k", counted, batches, out, log, batches_per_commit=2).count() == 10 and seen == [60]


def test_backfill_of_a_grown_table(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def copy(rows):
        return rows.withColumn("v", F.col("k") * 2)

    small, grown = (spark.range(1, n + 1).withColumnRenamed("id", "k") for n in (1000, 1500))
    B.run_backfill(small, "k", copy, B.plan_batches(small, "k", 100), out, log)
    B.run_backfill(grown, "k", copy, B.plan_batches(grown, "k", 70), out, log)
    assert sorted(r.k for r in B.backfilled(spark, out, log).collect()) == list(range(1, 1501))

    def broken(rows):
        return rows.withColumn("v", F.raise_error(F.lit("no")).cast("long"))

    more = spark.range(1, 1601).withColumnRenamed("id", "k")
    plan = B.plan_batches(more, "k", 50, last_pk=1500)
    with pytest.raises(Exception, match="no"):
        B.run_backfill(more, "k", broken, plan, out, log)
    B.run_backfill(more, "k", copy, plan, out, log)
    assert sorted(r.k for r in B.backfilled(spark, out, log).collect()) == list(range(1, 1601))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_mix_of_backfill_runs_is_one_full_run(spark, tmp_path, seed):
    import random

    rng = random.Random(seed)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    df = spark.range(0, 3000, 3).withColumnRenamed("id", "k")

    def run(batches):
        return B.run_backfill(df, "k", lambda rows: rows.withColumn("v", F.col("k") + 1), batches, out, log, batches_per_commit=rng.choice([1, 3, 1000]))

    run(B.plan_batches(df.where("k < 1500"), "k", 1000))
    assert run(B.plan_batches(df, "k", 100).where("batch_no = 5")).count() == 1  # inside what is done: not logged
    for _ in range(2):
        size, low = rng.choice([7, 40, 130]), rng.randrange(3000)
        run(B.plan_batches(df, "k", size).where((F.col("min_pk") >= low) & (F.col("batch_no") % rng.choice([1, 2, 3]) == 0)))
    # batches of one plan that overlap each other
    run(spark.createDataFrame([(1, 900, 2000, 0), (2, 950, 960, 0), (3, 950, 1900, 0), (4, 1990, 2400, 0), (5, 5000, 6000, 0)], "batch_no long, min_pk long, max_pk long, rows long"))
    done = run(B.plan_batches(df, "k", 100))
    got = [r.k for r in B.backfilled(spark, out, log).collect()]
    assert sorted(got) == list(range(0, 3000, 3))
    assert done.agg(F.sum("rows")).first()[0] == 1000 and done.where("rows = 0").isEmpty()


def test_changes_are_applied_one_by_one(spark):
    change = X.ColumnChange("old", "new", "int", "int")
    table = spark.createDataFrame([(1, 10, 10), (2, 1, 1), (4, 7, 7)], "k int, old int, new int")
    rows = [(1, None, None, "delete", 1), (1, 10, None, "insert", 2), (2, 2, 1, "update", 3), (2, 2, 3, "update", 4), (3, 5, 6, "update", 5), (3, 5, 6, "delete", 6), (5, None, 9, "insert", 7)]
    changes = spark.createDataFrame(rows, "k int, old int, new int, op string, seq int")
    want = [(1, 10, 10), (2, 3, 3), (4, 7, 7), (5, 9, 9)]
    for cuts in ([7], [1, 7], [3, 7], [1, 2, 3, 4, 5, 6, 7]):
        now, low = table, 0
        for high in cuts:
            now = X.apply_changes(now, changes.where(f"seq > {low} and seq <= {high}"), ["k"], change, ["seq"])
            now, low = spark.createDataFrame(now.collect(), table.schema), high
        assert sorted(map(tuple, now.collect())) == want, cuts


def test_rotation(spark, tmp_path):
    jobs = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id long, partition_id int")
    assert B.write_rotation(jobs, 0, str(tmp_path / "q")) == 2
    assert {r.partition_id for r in spark.read.parquet(str(tmp_path / "q")).collect()} == {0, 1}


def test_job_attempts_and_paused(spark):
    steps = ["created", "start", "paused", "resume", "heartbeat", "failed", "retry", "heartbeat"]
    rows = [(1, i, dt.datetime(2024, 1, 1, 0, i), s) for i, s in enumerate(steps)]
    got = B.job_state(spark.createDataFrame(rows, "job_id long, event_id long, at timestamp, step string")).first()
    assert (got.status, got.attempt, got.heartbeat_at) == ("running", 2, dt.datetime(2024, 1, 1, 0, 7))


def test_stale_views_differ_on_missing_heartbeats(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(1, "running", 1, 3, None), (2, "running", 3, 3, now - dt.timedelta(minutes=6)), (3, "running", 0, 3, now - dt.timedelta(minutes=5)), (4, "done", 0, 3, None)]
    jobs = spark.createDataFrame(rows, "id long, status string, attempt int, max_retries int, heartbeat_at timestamp")
    assert [(r.id, r.outcome) for r in B.stale_jobs(jobs, F.lit(now)).collect()] == [(2, "dead")]
    assert {(r.id, r.age_ms) for r in B.stale_report(jobs, F.lit(now)).collect()} == {(1, None), (2, 360_000)}


def test_progress_edges(spark):
    rows = spark.createDataFrame([(50, 200, 1000), (300, 200, 1000), (5, 0, 10), (0, 10, 10), (1, 3, 0)], "rows_done long, rows_total long, elapsed_ms long")
    got = [(float(r.percentage), float(r.rows_per_second), r.eta_ms) for r in B.progress(rows).collect()]
    assert got == [(25.0, 50.0, 3000), (100.0, 300.0, 0), (100.0, 0.0, None), (0.0, 0.0, None), (33.33, 0.0, None)]


def test_no_replica_means_no_lag(spark):
    empty = spark.createDataFrame([], "replay_lag string, replica string")
    assert B.max_lag(empty).first().asDict() == {"lag_seconds": 0.0, "replica": None, "exceeds": False}


def test_durations(spark):
    one = spark.range(1)
    assert one.select(V.duration_ms(F.lit("1.5 s")).alias("d")).first().d == 1500
    with pytest.raises(Exception, match="not a duration"):
        one.select(V.duration_ms(F.lit("soon"))).collect()


def test_guards(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "k int, old double, new decimal(9,2)")
    change = X.ColumnChange("old", "new", "double", "decimal(9,2)")
    with pytest.raises(ValueError):
        X.contract(df, change)
    with pytest.raises(ValueError):
        D.add_column(df, "x", "int", nullable=False)
    assert D.add_column(df.limit(0), "x", "int", nullable=False).columns[-1] == "x"
    once = X.sync_insert(df, change)
    assert once.collect() == X.sync_insert(once, change).collect()


def test_strict_ranges(spark):
    plan = spark.createDataFrame([("t", "p", i, f"c{i}", f"n{i}", [], [], "x") for i in range(5)], "target string, project string, pos long, change_id string, name string, requires array<string>, conflicts array<string>, note string")
    tags = spark.createDataFrame([("t", "p", 1, "c1", "a"), ("t", "p", 3, "c3", "b")], "target string, project string, pos long, change_id string, tag string")
    none = plan.limit(0)
    assert [r.name for r in H.range_diff(plan, tags, "a", "b", none).orderBy("pos").collect()] == ["n2", "n3"]
    for lo, hi in (("b", "a"), ("a", "zzz")):
        with pytest.raises(Exception, match="tag"):
            H.range_diff(plan, tags, lo, hi, none).collect()
    with pytest.raises(Exception, match="not in the plan"):
        H.up_to_target(plan, "zzz").collect()
    assert H.filter_plan(plan, tags, tag="zzz")[0].count() == 0
    done = plan.withColumn("committed_at", F.col("pos"))
    assert H.verify_range(done, "n3", "n1").count() == 0 and H.verify_range(done).count() == 5
    assert [r.name for r in H.revert_set(done, "n2").orderBy("seq").collect()] == ["n4", "n3"]
    with pytest.raises(Exception, match="not deployed"):
        H.verify_range(done, "zzz").collect()


def test_cross_project_dependencies(spark):
    plan = spark.createDataFrame([("t", "p", 1, "1", "a", ["q:b", "q:no"]), ("t", "q", 1, "2", "b", [])], "target string, project string, pos long, change_id string, name string, requires array<string>")
    none = plan.limit(0)
    assert H.missing_dependencies(plan, none).count() == 2
    assert [r.dependency for r in H.missing_dependencies(plan, none, across_projects=True).collect()] == ["q:no"]


def test_history_store(spark, tmp_path):
    rows = spark.createDataFrame([("t", "p", "c1", "h", "n")], "target string, project string, change_id string, script_hash string, name string")
    S.write_history(rows, "changes", str(tmp_path))
    got = S.read_history(spark, "changes", str(tmp_path))
    assert got.first().change_id == "c1" and got.schema == S.HISTORY_TABLES["changes"]
    S.write_history(spark.createDataFrame([(1.5,)], "version float"), "releases", str(tmp_path))
    assert S.read_history(spark, "releases", str(tmp_path)).first().version == 1.5


def test_script_folders(spark, tmp_path):
    (tmp_path / "a.sql").write_text("SELECT 1;\nSELECT 2;")
    (tmp_path / "b.sql").write_bytes(b"x\x00y")
    (tmp_path / "note.txt").write_text("no")
    got = C.read_scripts(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.kind) for r in got] == [("a", "deploy"), ("b", "deploy")] and got[0].sql.endswith("2;")
    hashes = {r.name: r.script_hash for r in C.read_script_hashes(spark, str(tmp_path)).collect()}
    import hashlib

    assert hashes["b"] == hashlib.sha1(b"x\x00y").hexdigest()


def test_lint_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "sql"
    folder.mkdir()
    (folder / "a.sql").write_text("DROP TABLE t;")
    found = J.lint_stream(J.script_stream(spark, str(folder)))

    def run():
        writer = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()

    run()
    time.sleep(0.01)
    (folder / "b.sql").write_text("UPDATE t SET a = 1; -- x:disable SA010\nTRUNCATE t")
    run()
    got = sorted(map(tuple, spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()), key=repr)
    want = sorted(map(tuple, L.lint(C.read_scripts(spark, str(folder)).select("path", "kind", "sql")).collect()), key=repr)
    assert got == want and len(got) == 4


def test_synced_bucket_may_become_empty(spark, tmp_path):
    change = X.ColumnChange("old", "new", "int", "string")
    table = spark.createDataFrame([(1, 5, "5"), (2, 6, "6")], "k int, old int, new string")
    path = str(tmp_path / "t")
    J.start_sync(table, path, ["k"], change, ["seq"], buckets=16)
    schema = "k int, old int, new string, op string, seq int"

    def send(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        writer = J.sync_stream(stream, path).option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()

    send((1, 5, "5", "delete", 1), (3, 9, None, "insert", 1))
    send((2, 6, "7", "update", 2))
    assert sorted(map(tuple, J.synced_table(spark, path).collect())) == [(2, 7, "7"), (3, 9, "9")]


def test_sync_writes_follow_the_batch(spark, tmp_path):
    import os

    change = X.ColumnChange("old", "new", "int", "string")

    def size(folder):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))

    written = {}
    for n in (200, 20_000):
        path = str(tmp_path / f"t{n}")
        J.start_sync(spark.range(n).select(F.col("id").cast("int").alias("k"), F.col("id").cast("int").alias("old"), F.col("id").cast("string").alias("new")), path, ["k"], change, ["seq"], buckets=4)
        base = size(path)
        rows = [(k, k + 1, str(k), "update", 1) for k in range(20)] + [(5, 7, "6", "update", 2), (6, None, None, "delete", 3), (n, 4, None, "insert", 4)]
        batches = [rows[:10], rows[10:21], rows[21:], [(n, 4, "9", "update", 1)]]
        for b, part in enumerate(batches):
            df = spark.createDataFrame(part, "k int, old int, new string, op string, seq int")
            J._write_buckets(df, b + 1, f"{path}/changes", ["k"], 4)
        written[n] = size(path) - base

        def state():
            got = {r.k: (r.old, r.new) for r in J.synced_table(spark, path).collect()}
            assert len(got) == n and 6 not in got and got[5] == (7, "7") and got[3] == (4, "4") and got[n] == (9, "9") and got[n - 1] == (n - 1, str(n - 1))

        state()
        assert J.vacuum_sync(spark, path) == 0
        assert J.compact_sync(spark, path) > 0  # all but the newest version
        state()
        assert J.vacuum_sync(spark, path) > 0
        state()
        assert J.compact_sync(spark, path) == 0
    assert written[20_000] < 1.2 * written[200]
