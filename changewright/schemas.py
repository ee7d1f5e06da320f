"""Declared schemas of the history, job and audit tables (never inferred)."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _fields(text: str) -> list[StructField]:
    kinds = {
        "string": StringType(),
        "long": LongType(),
        "int": IntegerType(),
        "short": ShortType(),
        "float": FloatType(),
        "bool": BooleanType(),
        "timestamp": TimestampType(),
        "strings": ArrayType(StringType()),
    }
    parts = (item.split(":") for item in text.split())
    return [StructField(name, kinds[kind], True) for name, kind in parts]


_PEOPLE = "committed_at:timestamp committer_name:string committer_email:string "
_PLANNED = "planned_at:timestamp planner_name:string planner_email:string"

PROJECTS = StructType(
    _fields("target:string project:string uri:string created_at:timestamp creator_name:string creator_email:string")
)
RELEASES = StructType(_fields("version:float installed_at:timestamp installer_name:string installer_email:string"))
CHANGES = StructType(
    _fields("target:string project:string change_id:string script_hash:string name:string note:string " + _PEOPLE + _PLANNED)
)
TAGS = StructType(
    _fields("target:string project:string tag_id:string tag:string change_id:string note:string " + _PEOPLE + _PLANNED)
)
DEPENDENCIES = StructType(
    _fields("target:string project:string change_id:string type:string dependency:string dependency_id:string")
)
EVENTS = StructType(
    _fields(
        "target:string project:string event:string change_id:string name:string note:string "
        "requires:strings conflicts:strings tags:strings " + _PEOPLE + _PLANNED
    )
)
HISTORY_TABLES = {
    "projects": PROJECTS,
    "releases": RELEASES,
    "changes": CHANGES,
    "tags": TAGS,
    "dependencies": DEPENDENCIES,
    "events": EVENTS,
}

JOBS = StructType(
    _fields(
        "id:long name:string status:string partition_id:short table_name:string batch_size:int sleep_ms:int "
        "last_pk:string attempt:int max_retries:int error_message:string heartbeat_at:timestamp "
        "created_at:timestamp updated_at:timestamp"
    )
)
COLUMN_CHANGES = StructType(
    _fields(
        "id:long change_name:string project:string phase:string table_schema:string table_name:string "
        "started_at:timestamp updated_at:timestamp started_by:string"
    )
)
SCRIPTS = StructType(_fields("path:string kind:string sql:string"))
HEARTBEATS = StructType(_fields("job_id:long at:timestamp"))
