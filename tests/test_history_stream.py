"""Compaction of a history whose stream stopped before it committed its newest batch."""

import datetime as dt

from changewright.streaming import jobs as J

SCHEMA = "target string, project string, event string, change_id string, name string, committed_at timestamp"


def test_replay_after_compaction_keeps_history(spark, tmp_path):
    source, out, offsets = (str(tmp_path / x) for x in ("in", "out", "offsets"))
    for k in range(4):
        rows = [("t", "p", "deploy", f"c{k}", f"n{k}", dt.datetime(2024, 1, 1 + k))]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def drain():
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        J.history_stream(events, out).option("checkpointLocation", offsets).trigger(availableNow=True).start().awaitTermination()

    def deployed():
        return sorted(r["change_id"] for r in J.history_state(spark, out).collect())

    drain()
    every = deployed()
    assert every == ["c0", "c1", "c2", "c3"]
    newest = max(int(f.name) for f in (tmp_path / "offsets" / "commits").iterdir() if f.name.isdigit())
    for f in (str(newest), f".{newest}.crc"):
        (tmp_path / "offsets" / "commits" / f).unlink(missing_ok=True)
    J.compact_history(spark, out)
    assert deployed() == every
    drain()
    assert deployed() == every
    J.compact_history(spark, out)
    J.compact_history(spark, out)
    assert deployed() == every
    assert len([f for f in (tmp_path / "out").iterdir() if f.name.startswith("batch_id=")]) == 2
