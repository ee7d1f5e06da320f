"""What a script does: operations, locks, tables, risk.  Inside the row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changewright.functions import sqltext as T
from changewright.operators.rules import parsed

# Lock of an operation, whether it blocks reads, whether it blocks writes.
LOCKS = {
    "CREATE TABLE": ("AccessExclusiveLock", False, False),
    "DROP TABLE": ("AccessExclusiveLock", True, True),
    "ALTER TABLE": ("AccessExclusiveLock", True, True),
    "CREATE INDEX": ("ShareLock", False, True),
    "CREATE INDEX CONCURRENTLY": ("ShareUpdateExclusiveLock", False, False),
    "DROP INDEX": ("AccessExclusiveLock", True, True),
    "CREATE FUNCTION": ("none", False, False),
    "CREATE VIEW": ("none", False, False),
    "CREATE TRIGGER": ("ShareRowExclusiveLock", False, True),
    "DROP TRIGGER": ("AccessExclusiveLock", True, True),
    "CREATE SEQUENCE": ("none", False, False),
    "CREATE TYPE": ("none", False, False),
    "CREATE SCHEMA": ("none", False, False),
    "ADD CONSTRAINT": ("AccessExclusiveLock", True, True),
    "VALIDATE CONSTRAINT": ("ShareUpdateExclusiveLock", False, False),
}

# Text in an operation or action, its risk level; the factor text is ours.
RISKS = (
    ("DROP TABLE", "critical", "drops a table"),
    ("DROP COLUMN", "high", "drops a column"),
    ("ALTER COLUMN TYPE", "high", "changes a column type, may rewrite the table"),
    ("NOT NULL", "medium", "touches a NOT NULL constraint, may scan the table"),
    ("CREATE INDEX", "medium", "creates an index, blocks writes unless concurrent"),
    ("CONCURRENTLY", "low", "works concurrently, slower but not blocking"),
    ("ADD COLUMN", "low", "adds a column"),
)
LEVELS = ("low", "medium", "high", "critical")
NO_RISK = "no risk factor found"
UNPARSED = "the script cannot be parsed, review it by hand"

_N = T.NAME
_OBJECTS = (
    ("CREATE TABLE", rf"(?i)^CREATE (?:(?:GLOBAL |LOCAL )?TEMP(?:ORARY)? |UNLOGGED )?TABLE (?:IF NOT EXISTS )?({_N})(?! ?(?:\([^)]*\) ?)?AS )"),
    ("ALTER TABLE", rf"(?i)^ALTER TABLE (?:IF EXISTS )?(?:ONLY )?({_N})(?!.* ?(?:RENAME|SET SCHEMA) )"),
    ("CREATE FUNCTION", rf"(?i)^CREATE (?:OR REPLACE )?(?:FUNCTION|PROCEDURE) ({_N})"),
    ("CREATE VIEW", rf"(?i)^CREATE (?:OR REPLACE )?(?:TEMP(?:ORARY)? )?(?:RECURSIVE )?VIEW ({_N})"),
    ("CREATE SEQUENCE", rf"(?i)^CREATE (?:TEMP(?:ORARY)? |UNLOGGED )?SEQUENCE (?:IF NOT EXISTS )?({_N})"),
    ("CREATE SCHEMA", rf"(?i)^CREATE SCHEMA (?:IF NOT EXISTS )?(?!AUTHORIZATION )({_N})"),
    ("CREATE TYPE", rf"(?i)^CREATE TYPE ({_N}) AS (?:ENUM ?)?\("),
)
_INDEX = rf"(?i)^CREATE (?:UNIQUE )?INDEX (CONCURRENTLY )?(?:IF NOT EXISTS )?(?:({_N}) )?ON (?:ONLY )?({_N})"
_TRIGGER = rf"(?i)^CREATE (?:OR REPLACE )?(?:CONSTRAINT )?TRIGGER ({_N}) .*? ON ({_N})"
_DROP = r"(?i)^DROP (TABLE|INDEX) (?:CONCURRENTLY )?(?:IF EXISTS )?(.+?)(?: (?:CASCADE|RESTRICT))?$"

# Named kinds of ALTER TABLE actions; other actions keep their first two words.
_ACTIONS = (
    ("DROP CONSTRAINT", r"(?i)^DROP CONSTRAINT "),
    ("VALIDATE CONSTRAINT", r"(?i)^VALIDATE CONSTRAINT "),
    ("ADD CONSTRAINT", r"(?i)^ADD (?:CONSTRAINT |PRIMARY KEY|UNIQUE|FOREIGN KEY|CHECK|EXCLUDE)"),
)
_COLUMN_ACTIONS = (
    ("ADD COLUMN", rf"(?i)^ADD (?:COLUMN )?(?:IF NOT EXISTS )?({_N})"),
    ("DROP COLUMN", rf"(?i)^DROP (?:COLUMN )?(?:IF EXISTS )?({_N})"),
    ("ALTER COLUMN TYPE", rf"(?i)^ALTER (?:COLUMN )?({_N}) (?:SET DATA )?TYPE "),
    ("SET NOT NULL", rf"(?i)^ALTER (?:COLUMN )?({_N}) SET NOT NULL"),
    ("DROP NOT NULL", rf"(?i)^ALTER (?:COLUMN )?({_N}) DROP NOT NULL"),
    ("COLUMN DEFAULT", rf"(?i)^ALTER (?:COLUMN )?({_N}) (?:SET|DROP) DEFAULT"),
)


def action_kind(action: Column) -> Column:
    out = F.when(F.lit(False), "")
    for kind, pattern in _ACTIONS:
        out = out.when(action.rlike(pattern), kind)
    for kind, pattern in _COLUMN_ACTIONS:
        named = F.concat(F.lit(f'{kind} "'), T.last_name(F.regexp_extract(action, pattern, 1)), F.lit('"'))
        out = out.when(action.rlike(pattern), named)
    return out.otherwise(F.upper(F.regexp_extract(action, r"^(\S+(?: \S+)?)", 1)))


def _operation(s: Column) -> Column:
    """Struct of one operation; null type for statements that are none."""
    stmt, verb = s["stmt"], s["verb"]
    # every pattern begins with its word, so each is tried on the statements of that word only
    create = verb == "CREATE"
    index, trigger, drop = create & stmt.rlike(_INDEX), create & stmt.rlike(_TRIGGER), (verb == "DROP") & stmt.rlike(_DROP)
    concurrent = F.regexp_extract(stmt, _INDEX, 1) != ""
    type_ = (
        F.when(index & concurrent, "CREATE INDEX CONCURRENTLY")
        .when(index, "CREATE INDEX")
        .when(trigger, "CREATE TRIGGER")
        .when(drop, F.concat(F.lit("DROP "), F.upper(F.regexp_extract(stmt, _DROP, 1))))
    )

    def on(pattern: str, name: int, table: int) -> Column:
        own = T.full_name(F.regexp_extract(stmt, pattern, name))
        return F.concat(F.when(own == "", "unnamed").otherwise(own), F.lit(" ON "), T.full_name(F.regexp_extract(stmt, pattern, table)))

    name = F.when(index, on(_INDEX, 2, 3)).when(trigger, on(_TRIGGER, 1, 2)).when(drop, T.name_list(F.regexp_extract(stmt, _DROP, 2)))
    for kind, pattern in _OBJECTS:
        fits = (verb == kind.split(" ")[0]) & stmt.rlike(pattern)
        type_ = type_.when(fits, kind)
        name = name.when(fits, T.full_name(F.regexp_extract(stmt, pattern, 1)))
    return F.struct(type_.alias("type"), name.alias("object_name"), F.transform(s["actions"], action_kind).alias("actions"))


def operations_column(statements: Column) -> Column:
    words = F.filter(F.transform(statements, parsed), lambda s: s["verb"].isin("CREATE", "ALTER", "DROP"))
    return F.filter(F.transform(words, _operation), lambda o: o["type"].isNotNull())


def lock_of(op: Column) -> Column:
    """Lock, blocks reads, blocks writes; an ALTER that only validates is weaker."""

    def info(lock: str, reads: bool, writes: bool) -> Column:
        return F.struct(F.lit(lock).alias("lock"), F.lit(reads).alias("blocks_reads"), F.lit(writes).alias("blocks_writes"))

    weaker = (op["type"] == "ALTER TABLE") & F.array_contains(op["actions"], "VALIDATE CONSTRAINT")
    out = F.when(weaker, info(*LOCKS["VALIDATE CONSTRAINT"]))
    for kind, values in LOCKS.items():
        out = out.when(op["type"] == kind, info(*values))
    return out.otherwise(info("unknown", False, False))


def tables_column(ops: Column) -> Column:
    """Distinct tables in order of appearance; ``x ON t`` counts as ``t``."""
    own = F.filter(ops, lambda o: o["object_name"].contains(" ON ") | o["type"].isin("CREATE TABLE", "ALTER TABLE", "DROP TABLE"))
    return F.array_distinct(F.transform(own, lambda o: F.trim(F.regexp_replace(o["object_name"], r"^.*? ON ", ""))))


def risk_column(ops: Column) -> Column:
    """Highest level and the distinct factors found."""
    table = F.array(*[
        F.struct(F.lit(p).alias("pattern"), F.lit(LEVELS.index(level)).alias("rank"), F.lit(factor).alias("factor"))
        for p, level, factor in RISKS
    ])

    def hits(o: Column) -> Column:
        def matches(r: Column) -> Column:
            return o["type"].contains(r["pattern"]) | F.exists(o["actions"], lambda a: a.contains(r["pattern"]))

        return F.filter(table, matches)

    found = F.flatten(F.transform(ops, hits))
    rank = F.coalesce(F.array_max(F.transform(found, lambda r: r["rank"])), F.lit(0))
    factors = F.array_distinct(F.transform(found, lambda r: r["factor"]))
    level = F.get(F.array(*[F.lit(x) for x in LEVELS]), rank)
    return F.struct(level.alias("risk"), F.when(F.size(factors) > 0, factors).otherwise(F.array(F.lit(NO_RISK))).alias("factors"))


def _with_ops(scripts: DataFrame) -> DataFrame:
    rows = scripts.withColumn("_masked", T.mask(F.col("sql"))).withColumn("_split", T.split_statements(F.col("_masked")))
    rows = rows.withColumn("_broken", T.is_unparsable(F.col("_masked"), F.col("_split")))
    none = F.array().cast("array<struct<type:string,object_name:string,actions:array<string>>>")
    return rows.withColumn("_ops", F.when(F.col("_broken"), none).otherwise(operations_column(F.col("_split"))))


def operations(scripts: DataFrame) -> DataFrame:
    """One row per operation with its lock."""
    rows = _with_ops(scripts).select("path", F.posexplode_outer("_ops").alias("i", "o")).where("o is not null")
    return rows.select("path", (F.col("i") + 1).alias("op_no"), "o.*", lock_of(F.col("o")).alias("l")).select("*", "l.*").drop("l")


def tables_affected(ops: DataFrame) -> DataFrame:
    """(path, table) rows of an operation table, each once."""
    named = F.col("object_name").contains(" ON ") | F.col("type").isin("CREATE TABLE", "ALTER TABLE", "DROP TABLE")
    return ops.where(named).select("path", F.trim(F.regexp_replace("object_name", r"^.*? ON ", "")).alias("table")).distinct()


def script_context(scripts: DataFrame) -> DataFrame:
    """Operations, locks, tables and risk of each script."""
    rows = _with_ops(scripts).withColumn("_risk", risk_column(F.col("_ops")))
    return rows.select(
        "path",
        F.col("_ops").alias("operations"),
        F.transform("_ops", lock_of).alias("locks"),
        tables_column(F.col("_ops")).alias("tables"),
        F.when(F.col("_broken"), "medium").otherwise(F.col("_risk.risk")).alias("risk"),
        F.when(F.col("_broken"), F.array(F.lit(UNPARSED))).otherwise(F.col("_risk.factors")).alias("factors"),
    )


def script_risk(scripts: DataFrame) -> DataFrame:
    return script_context(scripts).select("path", "risk", "factors")
