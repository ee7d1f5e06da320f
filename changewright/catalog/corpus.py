"""A script corpus derived from ``orders``: 24 script shapes with what they must raise.

``{k}`` is the order key.  The expected rows are written by hand, so the SQL
statements of the audit queries need no parser of their own.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changewright.fixtures import table
from changewright.session import spread

T = "SET lock_timeout = '5s';\n"


@dataclass(frozen=True)
class Shape:
    """``found``: (rule, severity, line, column).  ``stmts``: (line, column).  ``ops``: (type, object, lock)."""

    sql: str
    found: tuple = ()
    stmts: tuple = ((1, 1), (2, 1))
    ops: tuple = ()
    risk: str = "low"
    broken: bool = False
    actions: tuple = ()
    raw: tuple = field(default=None)

    @property
    def findings(self) -> tuple:
        """Before suppression; the same as ``found`` unless given."""
        return self.found if self.raw is None else self.raw


ALTER = (("ALTER TABLE", "t_{k}", "AccessExclusiveLock"),)

SHAPES = (
    Shape(T + "ALTER TABLE t_{k} ADD COLUMN a int NOT NULL;", (("SA001", "error", 2, 1),), ops=ALTER, actions=("ADD COLUMN a int NOT NULL",)),
    Shape(
        T + "ALTER TABLE s.t_{k}\n  ADD COLUMN u uuid DEFAULT gen_random_uuid(),\n  ADD COLUMN v numeric(10, 2);", (("SA002", "error", 2, 1),),
        ops=(("ALTER TABLE", "s.t_{k}", "AccessExclusiveLock"),), actions=("ADD COLUMN u uuid DEFAULT gen_random_uuid()", "ADD COLUMN v numeric(10, 2)"),
    ),
    Shape(T + "ALTER TABLE t_{k} ADD COLUMN b int DEFAULT 0 NOT NULL;", ops=ALTER, actions=("ADD COLUMN b int DEFAULT 0 NOT NULL",)),
    Shape(T + "ALTER TABLE t_{k} ALTER COLUMN c TYPE bigint USING c::bigint;", (("SA003", "error", 2, 1),), ops=ALTER, risk="high", actions=("ALTER COLUMN c TYPE bigint USING c::bigint",)),
    Shape(T + "CREATE INDEX i_{k} ON t_{k} (a);", (("SA004", "warn", 2, 1),), ops=(("CREATE INDEX", "i_{k} ON t_{k}", "ShareLock"),), risk="medium"),
    Shape(T + "DROP INDEX i_{k};", (("SA005", "warn", 2, 1),), ops=(("DROP INDEX", "i_{k}", "AccessExclusiveLock"),)),
    Shape(T + "ALTER TABLE t_{k} DROP COLUMN d;", (("SA006", "warn", 2, 1),), ops=ALTER, risk="high", actions=("DROP COLUMN d",)),
    Shape(T + "DROP TABLE IF EXISTS T_{k} CASCADE;", (("SA007", "error", 2, 1),), ops=(("DROP TABLE", "t_{k}", "AccessExclusiveLock"),), risk="critical"),
    Shape(T + "TRUNCATE t_{k}, t2;", (("SA008", "warn", 2, 1),)),
    Shape(
        T + "ALTER TABLE t_{k} ADD CONSTRAINT fk FOREIGN KEY (a, b) REFERENCES p (a, b);", (("SA009", "warn", 2, 1),), ops=ALTER,
        actions=("ADD CONSTRAINT fk FOREIGN KEY (a, b) REFERENCES p (a, b)",),
    ),
    Shape(
        "UPDATE t_{k} SET a = (SELECT max(a) FROM x WHERE x.b > 1);\nSELECT 1;  DELETE FROM t_{k};\n", (("SA010", "warn", 1, 1), ("SA010", "warn", 2, 12)),
        stmts=((1, 1), (2, 1), (2, 12)),
    ),
    Shape("ALTER SEQUENCE q_{k} RESTART WITH 1;", (("SA012", "info", 1, 1),), stmts=((1, 1),)),
    Shape(
        "ALTER TABLE t_{k} ADD COLUMN e int;\nSET lock_timeout = '1s';\nDROP INDEX CONCURRENTLY IF EXISTS j;", (("SA013", "warn", 1, 1), ("SA020", "error", 3, 1)),
        stmts=((1, 1), (2, 1), (3, 1)), ops=ALTER + (("DROP INDEX", "j", "AccessExclusiveLock"),), actions=("ADD COLUMN e int",),
    ),
    Shape(T + "VACUUM FULL t_{k};\nCLUSTER t_{k} USING i;", (("SA014", "warn", 2, 1), ("SA014", "warn", 3, 1)), stmts=((1, 1), (2, 1), (3, 1))),
    Shape(
        T + "ALTER TABLE t_{k} RENAME COLUMN a TO b;\nALTER TABLE t_{k} RENAME TO u_{k};", (("SA015", "warn", 2, 1), ("SA015", "warn", 3, 1)),
        stmts=((1, 1), (2, 1), (3, 1)),
    ),
    Shape(
        T + "ALTER TABLE t_{k} ADD CONSTRAINT ck CHECK (a > 0), ADD CHECK (b > 0) NOT VALID;", (("SA016", "error", 2, 1),), ops=ALTER,
        actions=("ADD CONSTRAINT ck CHECK (a > 0)", "ADD CHECK (b > 0) NOT VALID"),
    ),
    Shape(T + "ALTER TABLE t_{k} ALTER a SET NOT NULL;", (("SA017", "warn", 2, 1),), ops=ALTER, risk="medium", actions=("ALTER a SET NOT NULL",)),
    Shape(T + "ALTER TABLE t_{k} ADD PRIMARY KEY (a, b);", (("SA018", "warn", 2, 1),), ops=ALTER, actions=("ADD PRIMARY KEY (a, b)",)),
    Shape(T + "REINDEX TABLE t_{k};", (("SA019", "warn", 2, 1),)),
    Shape(
        "-- tool:no-transaction\nCREATE INDEX CONCURRENTLY i_{k} ON t_{k} (a);\nREINDEX INDEX CONCURRENTLY i_{k};", stmts=((2, 1), (3, 1)),
        ops=(("CREATE INDEX CONCURRENTLY", "i_{k} ON t_{k}", "ShareUpdateExclusiveLock"),), risk="medium",
    ),
    Shape("LOCK TABLE t_{k} IN SHARE MODE;\nALTER TABLE ONLY t_{k} VALIDATE CONSTRAINT ck;", (("SA021", "warn", 1, 1), ("SA013", "warn", 2, 1)),
          ops=(("ALTER TABLE", "t_{k}", "ShareUpdateExclusiveLock"),), actions=("VALIDATE CONSTRAINT ck",)),
    Shape(
        "CREATE FUNCTION f_{k}() RETURNS void AS $body$\nBEGIN\n  DELETE FROM t_{k}; TRUNCATE t_{k};\nEND\n$body$ LANGUAGE plpgsql;\n"
        "/* UPDATE t_{k} SET a = 1; /* nested; */ */\n\\echo done\n  SELECT 'DROP TABLE t_{k};', E'it\\'s; fine';",
        stmts=((1, 1), (8, 3)), ops=(("CREATE FUNCTION", "f_{k}", "none"),),
    ),
    Shape(
        "-- tool:disable SA010\nUPDATE t_{k} SET a = 1;\n-- tool:enable SA010\nDELETE FROM t_{k}; -- tool:disable SA010,SA999\nUPDATE u_{k} SET a = 2;\n-- tool:disable SA008",
        (("SA010", "warn", 5, 1), ("suppression", "warn", 4, 1), ("suppression", "warn", 4, 1), ("suppression", "warn", 6, 1), ("suppression", "warn", 6, 1)),
        stmts=((2, 1), (4, 1), (5, 1)), raw=(("SA010", "warn", 2, 1), ("SA010", "warn", 4, 1), ("SA010", "warn", 5, 1)),
    ),
    Shape("CREATE TABLE t_{k} (a int;\nDROP TABLE x", (("parse-error", "error", 1, 1),), broken=True, risk="medium"),
)
N = len(SHAPES)


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, kind, sql: one script per order; every tenth is a revert script."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    key = F.col("o_orderkey").cast("string")
    shape = F.get(F.array(*[F.lit(s.sql) for s in SHAPES]), (F.col("o_orderkey") % N).cast("int"))
    kind = F.when(F.col("o_orderkey") % 10 == 0, "revert").otherwise("deploy")
    return o.select(F.concat(kind, F.lit("/c"), key, F.lit(".sql")).alias("path"), kind.alias("kind"), F.replace(shape, F.lit("{k}"), key).alias("sql"))


def _quote(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def values(name: str, columns: str, rows: Iterable[tuple]) -> str:
    listed = ",\n  ".join("(" + ", ".join(_quote(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES\n  {listed})"


SCRIPTS_SQL = values("shapes", "n, text", ((n, s.sql) for n, s in enumerate(SHAPES))) + f""",
scripts AS (
  SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'revert' ELSE 'deploy' END || '/c' || o_orderkey || '.sql' AS path,
         CASE WHEN o_orderkey % 10 = 0 THEN 'revert' ELSE 'deploy' END AS kind, replace(text, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS sql, n, o_orderkey AS k
  FROM orders JOIN shapes ON n = o_orderkey % {N})"""


def expected(name: str, columns: str, attribute: str) -> str:
    """CTE with the expected rows of every shape: shape number, row number, columns."""
    rows = []
    for n, shape in enumerate(SHAPES):
        for i, row in enumerate(getattr(shape, attribute)):
            rows.append((n, i + 1, *(row if isinstance(row, tuple) else (row,))))
    return values(name, f"n, i, {columns}", rows)
