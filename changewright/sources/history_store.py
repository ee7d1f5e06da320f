"""The six history tables on disk and the step from one state to the next."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from changewright.schemas import HISTORY_TABLES
from changewright.session import cut, read_table

KEYS = ("target", "project")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns and types of a history table; missing columns become null."""
    fields = HISTORY_TABLES[table].fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def write_history(df: DataFrame, table: str, path: str) -> None:
    writer = conform(df, table).write.mode("overwrite")
    if "project" in HISTORY_TABLES[table].names:
        writer = writer.partitionBy("project")
    writer.parquet(f"{path}/{table}")


def read_history(spark: SparkSession, table: str, path: str) -> DataFrame:
    schema = HISTORY_TABLES[table]
    return spark.read.schema(schema).parquet(f"{path}/{table}").select(*schema.names)


def apply_history(
    state: Mapping[str, DataFrame], batch: DataFrame, dependencies: DataFrame, keys: Sequence[str] = KEYS
) -> dict[str, DataFrame]:
    """State after a batch of deploy / revert / fail events.

    The batch holds at most one deploy or revert per change.  Deploys add the
    change and its dependencies, reverts remove change, dependencies and tags,
    fails are only logged.  This is the step alone, over whole tables;
    ``commit_history`` runs it for the projects that a batch touches.
    """
    deploys, reverts = batch.where("event = 'deploy'"), batch.where("event = 'revert'")
    gone = reverts.select(*keys, "change_id")
    again = deploys.select(*keys, "change_id")
    on = [*keys, "change_id"]

    def without(table: str, rows: DataFrame) -> DataFrame:
        return state[table].join(rows, on, "left_anti")

    replaced = gone.unionByName(again)
    added = dependencies.join(again, on, "left_semi")
    return {
        **state,
        "events": conform(state["events"], "events").unionByName(conform(batch, "events")),
        "changes": conform(without("changes", replaced), "changes").unionByName(conform(deploys, "changes")),
        "dependencies": conform(without("dependencies", replaced), "dependencies").unionByName(conform(added, "dependencies")),
        "tags": conform(without("tags", gone), "tags"),
    }


# A store on disk, one version per batch:
#   events/version=v                            the events of batch v, never written again
#   changes|dependencies|tags/version=v/target=t/project=p   state of the projects that batch v touched
#   manifest/version=v                          (target, project) of those, written last: a version without it does not count
STATE = ("changes", "dependencies", "tags")


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    return read_table(spark, f"{path}/manifest", "target string, project string, version long")


def stored_history(spark: SparkSession, path: str, table: str, touched: DataFrame | None = None) -> DataFrame:
    """A history table of the store: all events, or of each project (or the ``touched`` ones) the newest state."""
    schema = HISTORY_TABLES[table]
    log = _versions(spark, path)
    rows = None if log is None else read_table(spark, f"{path}/{table}", StructType([*schema.fields, StructField("version", LongType())]))
    if rows is None:
        return spark.createDataFrame([], schema)
    if table == "events":
        return rows.join(log.select("version").distinct(), "version", "left_semi").select(*schema.names)
    now = log.groupBy(*KEYS).agg(F.max("version").alias("version"))
    if touched is not None:
        now = now.join(touched, list(KEYS), "left_semi")
    return rows.join(now, ["version", *KEYS], "left_semi").select(*schema.names)


def commit_history(spark: SparkSession, path: str, batch: DataFrame, dependencies: DataFrame, tags: DataFrame | None = None, version: int | None = None) -> int:
    """Take a batch of events into the store; returns its version.

    Writes the batch as a segment of the log and the state of the projects it touches; no older event and no other
    project is read or written.  ``tags`` are added for changes that are deployed after the batch.  The manifest comes
    last, so a commit that stops half-way does not count; with the same ``version`` it may be run again.
    """
    if version is None:
        log = _versions(spark, path)
        version = (-1 if log is None else log.agg(F.max("version")).first()[0]) + 1
    batch = cut(conform(batch, "events"))
    touched = cut(batch.select(*KEYS).distinct())
    state = {t: stored_history(spark, path, t, touched) for t in STATE}
    after = apply_history(state | {"events": batch.limit(0)}, batch, dependencies)
    if tags is not None:
        fresh = conform(tags.join(after["changes"].select(*KEYS, "change_id"), [*KEYS, "change_id"], "left_semi").join(touched, list(KEYS), "left_semi"), "tags")
        kept = after["tags"].join(fresh, [*KEYS, "change_id", "tag"], "left_anti")
        after["tags"] = conform(kept, "tags").unionByName(fresh)

    def put(df: DataFrame, table: str, *by: str) -> None:
        placed = df.withColumn("version", F.lit(version).cast("long"))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", *by).parquet(f"{path}/{table}")

    put(batch, "events")
    for t in STATE:
        put(after[t].hint("rebalance", *KEYS), t, *KEYS)
    put(touched, "manifest")
    return version


def upsert_projects(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Projects by name; a row that exists wins."""
    fresh = incoming.join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)
