"""Rules, masking, suppression and lint on hand-written scripts."""

import pytest
from pyspark.sql import functions as F

from changewright.functions import sqltext as T
from changewright.operators import explain as E
from changewright.operators import lint as L
from changewright.operators.rules import Rule, default_rules

# Per rule: statements that must raise it, statements that must not.
CASES = {
    "SA001": (
        ["ALTER TABLE t ADD COLUMN a int NOT NULL", "alter table if exists only s.t add a int not null", "ALTER TABLE t ADD b text, ADD c int NOT NULL CHECK (c > 0)"],
        ["ALTER TABLE t ADD COLUMN a int", "ALTER TABLE t ADD COLUMN a int NOT NULL DEFAULT 0", "ALTER TABLE t ADD CHECK (a IS NOT NULL)", "CREATE TABLE t (a int NOT NULL)",
         "ALTER TABLE t ALTER COLUMN a SET NOT NULL", "ALTER TABLE t ADD COLUMN a int CHECK (a IS NOT NULL)"],
    ),
    "SA002": (
        ["ALTER TABLE t ADD a uuid DEFAULT gen_random_uuid()", "ALTER TABLE t ADD a float DEFAULT (random() * 2)::float", "ALTER TABLE t ADD a int DEFAULT coalesce(nextval('q'), 1) NOT NULL"],
        ["ALTER TABLE t ADD a int DEFAULT 0", "ALTER TABLE t ADD a timestamptz DEFAULT now()", "ALTER TABLE t ADD a int CHECK (a > random())", "ALTER TABLE t ALTER a SET DEFAULT random()",
         "ALTER TABLE t ADD a text DEFAULT 'random()'"],
    ),
    "SA003": (
        ["ALTER TABLE t ALTER COLUMN a TYPE bigint", "ALTER TABLE t ALTER a SET DATA TYPE text", "ALTER TABLE t ALTER COLUMN \"A b\" TYPE int USING 1"],
        ["ALTER TABLE t ALTER a SET DEFAULT 1", "ALTER TABLE t ADD a text", "ALTER TYPE e ADD VALUE 'x'", "ALTER TABLE t ALTER a SET NOT NULL", "ALTER TABLE t RENAME a TO type"],
    ),
    "SA004": (
        ["CREATE INDEX i ON t (a)", "create unique index if not exists i on only t (a)", "CREATE INDEX ON s.t USING gin (a)"],
        ["CREATE INDEX CONCURRENTLY i ON t (a)", "DROP INDEX i", "CREATE TABLE t (a int UNIQUE)", "-- CREATE INDEX i ON t (a)\nSELECT 1", "SELECT 'CREATE INDEX i ON t (a)'"],
    ),
    "SA005": (
        ["DROP INDEX i", "DROP INDEX IF EXISTS s.i, j CASCADE", "drop index i restrict"],
        ["DROP INDEX CONCURRENTLY i", "DROP TABLE t", "DROP VIEW v", "CREATE INDEX i ON t (a)", "REINDEX INDEX i"],
    ),
    "SA006": (
        ["ALTER TABLE t DROP COLUMN a", "ALTER TABLE t DROP a", "ALTER TABLE t ADD b int, DROP COLUMN IF EXISTS a CASCADE"],
        ["ALTER TABLE t DROP CONSTRAINT c", "ALTER TABLE t ALTER a DROP DEFAULT", "DROP TABLE t", "ALTER TABLE t ALTER a DROP NOT NULL", "ALTER VIEW v RENAME TO w"],
    ),
    "SA007": (
        ["DROP TABLE t", "DROP TABLE IF EXISTS s.t, u CASCADE", "drop table t restrict"],
        ["DROP VIEW t", "DROP INDEX t", "TRUNCATE t", "DO $$ BEGIN DROP TABLE t; END $$", "/* DROP TABLE t; */ SELECT 1"],
    ),
    "SA008": (
        ["TRUNCATE t", "TRUNCATE TABLE ONLY s.t, u RESTART IDENTITY CASCADE", "truncate t"],
        ["DELETE FROM t WHERE a", "DROP TABLE t", "CREATE FUNCTION f() RETURNS void AS $x$ TRUNCATE t; $x$ LANGUAGE sql", "SELECT 'TRUNCATE t'", "CREATE TRIGGER g BEFORE TRUNCATE ON t EXECUTE FUNCTION f()"],
    ),
    "SA009": (
        ["ALTER TABLE t ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES p (a)", "ALTER TABLE t ADD FOREIGN KEY (a, b) REFERENCES s.p", "ALTER TABLE t ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES p ON DELETE CASCADE"],
        ["ALTER TABLE t ADD CONSTRAINT f FOREIGN KEY (a) REFERENCES p (a) NOT VALID", "ALTER TABLE t ADD a int REFERENCES p", "ALTER TABLE t VALIDATE CONSTRAINT f", "CREATE TABLE t (a int REFERENCES p)",
         "ALTER TABLE t ADD CONSTRAINT u UNIQUE (a)"],
    ),
    "SA010": (
        ["UPDATE t SET a = 1", "DELETE FROM ONLY t", "WITH x AS (SELECT 1 WHERE true) DELETE FROM t USING x", "UPDATE t SET a = (SELECT b FROM u WHERE u.id = t.id)"],
        ["UPDATE t SET a = 1 WHERE b", "DELETE FROM t WHERE a", "WITH x AS (DELETE FROM t) SELECT 1", "INSERT INTO t VALUES (1) ON CONFLICT (a) DO UPDATE SET a = 2", "DO $$ BEGIN UPDATE t SET a = 1; END $$",
         "SELECT 1 FROM t FOR UPDATE"],
    ),
    "SA012": (
        ["ALTER SEQUENCE q RESTART", "ALTER SEQUENCE IF EXISTS s.q RESTART WITH 5", "alter sequence q increment 2 restart 9"],
        ["ALTER SEQUENCE q INCREMENT 2", "CREATE SEQUENCE q", "ALTER SEQUENCE q OWNED BY t.a", "TRUNCATE t RESTART IDENTITY", "SELECT setval('q', 1)"],
    ),
    "SA013": (
        ["ALTER TABLE t ADD a int", "CREATE INDEX i ON t (a)", "SET lock_timeout TO DEFAULT; DROP TABLE t", "DROP INDEX i; SET lock_timeout = '1s'"],
        ["SET lock_timeout = '5s'; ALTER TABLE t ADD a int", "set local lock_timeout to 100; DROP TABLE t", "CREATE INDEX CONCURRENTLY i ON t (a)", "CREATE TABLE t (a int)", "ALTER TABLE t RENAME TO u"],
    ),
    "SA014": (
        ["VACUUM FULL t", "VACUUM (VERBOSE, FULL) t", "CLUSTER t USING i"],
        ["VACUUM t", "VACUUM (ANALYZE) t", "ANALYZE t", "SELECT 'VACUUM FULL'", "VACUUM VERBOSE \"full\""],
    ),
    "SA015": (
        ["ALTER TABLE t RENAME TO u", "ALTER TABLE IF EXISTS t RENAME COLUMN a TO b", "ALTER TABLE t RENAME a TO b"],
        ["ALTER TABLE t RENAME CONSTRAINT a TO b", "ALTER INDEX i RENAME TO j", "ALTER VIEW v RENAME TO w", "ALTER TABLE t ADD a int", "ALTER TYPE e RENAME TO f"],
    ),
    "SA016": (
        ["ALTER TABLE t ADD CHECK (a > 0)", "ALTER TABLE t ADD CONSTRAINT c CHECK ((a > 0) AND (b > 0))", "ALTER TABLE t ADD CONSTRAINT c CHECK (n <> 'NOT VALID')"],
        ["ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0) NOT VALID", "ALTER TABLE t ADD a int CHECK (a > 0)", "CREATE TABLE t (a int CHECK (a > 0))", "ALTER DOMAIN d ADD CHECK (VALUE > 0)", "ALTER TABLE t VALIDATE CONSTRAINT c"],
    ),
    "SA017": (
        ["ALTER TABLE t ALTER COLUMN a SET NOT NULL", "ALTER TABLE t ALTER a SET NOT NULL", "ALTER TABLE t ADD b int, ALTER COLUMN a SET NOT NULL"],
        ["ALTER TABLE t ALTER a DROP NOT NULL", "ALTER TABLE t ADD a int NOT NULL", "ALTER TABLE t ALTER a SET DEFAULT 1", "CREATE TABLE t (a int NOT NULL)", "ALTER DOMAIN d SET NOT NULL"],
    ),
    "SA018": (
        ["ALTER TABLE t ADD PRIMARY KEY (a)", "ALTER TABLE t ADD CONSTRAINT k PRIMARY KEY (a, b)", "ALTER TABLE t ADD PRIMARY KEY (a) USING INDEX TABLESPACE x"],
        ["ALTER TABLE t ADD CONSTRAINT k PRIMARY KEY USING INDEX i", "CREATE TABLE t (a int PRIMARY KEY)", "ALTER TABLE t ADD a int PRIMARY KEY", "ALTER TABLE t ADD UNIQUE (a)", "ALTER TABLE t DROP CONSTRAINT k"],
    ),
    "SA019": (
        ["REINDEX TABLE t", "REINDEX (VERBOSE) INDEX s.i", "REINDEX SCHEMA s"],
        ["REINDEX INDEX CONCURRENTLY i", "REINDEX (CONCURRENTLY) TABLE t", "REINDEX (VERBOSE, CONCURRENTLY) TABLE t", "CREATE INDEX CONCURRENTLY i ON t (a)", "SELECT 'REINDEX TABLE t'"],
    ),
    "SA020": (
        ["CREATE INDEX CONCURRENTLY i ON t (a)", "DROP INDEX CONCURRENTLY IF EXISTS i", "REINDEX (CONCURRENTLY) TABLE t"],
        ["CREATE INDEX i ON t (a)", "-- any:no-transaction\nCREATE INDEX CONCURRENTLY i ON t (a)", "CREATE INDEX CONCURRENTLY i ON t (a); -- any:NO-TRANSACTION", "DROP INDEX i", "REINDEX TABLE t"],
    ),
    "SA021": (
        ["LOCK TABLE t", "LOCK t, s.u IN ACCESS SHARE MODE", "lock table only t in row exclusive mode nowait"],
        ["SELECT pg_advisory_lock(1)", "SELECT 1 FROM t FOR UPDATE", "SET lock_timeout = 1", "DO $$ BEGIN LOCK TABLE t; END $$", "-- LOCK TABLE t\nSELECT 1"],
    ),
}


def corpus(spark, texts, kind="deploy"):
    return spark.createDataFrame([(p, kind, sql) for p, sql in texts.items()], "path string, kind string, sql string")


def test_rules_fire_and_stay_silent(spark):
    texts = {f"{rule}/{side}/{n}": sql for rule, sides in CASES.items() for side, stmts in zip(("hit", "miss"), sides) for n, sql in enumerate(stmts)}
    found = {}
    for r in L.findings(corpus(spark, texts)).select("path", "rule").distinct().collect():
        found.setdefault(r.path, set()).add(r.rule)
    wrong = [(p, texts[p], found.get(p)) for p in texts if (p.split("/")[0] in found.get(p, set())) != ("/hit/" in p) or "parse-error" in found.get(p, set())]
    assert wrong == []
    assert all(len(h) >= 3 and len(m) >= 5 for h, m in CASES.values())


def test_old_server_and_connected_rules(spark):
    texts = {"v": "ALTER TABLE t ADD a int DEFAULT 0", "big": "UPDATE S.Big SET a = 1 WHERE b", "small": "DELETE FROM small WHERE b", "cte": "WITH x AS (SELECT 1) UPDATE s.big SET a = 1 WHERE b",
             "off": "UPDATE s.big SET a = 1 WHERE b; -- x:disable SA011"}
    rows = corpus(spark, texts)
    stats = spark.createDataFrame([("s.big", 20000), ("small", 5)], "table_name string, rows long")
    got = {(r.path, r.rule) for r in L.lint(rows, L.LintConfig(version=10), stats=stats).collect()}
    assert got == {("v", "SA002b"), ("v", "SA013"), ("big", "SA011"), ("cte", "SA011")}
    assert ("off", "suppression") in {(r.path, r.rule) for r in L.lint(rows).collect()}


def test_revert_scripts_may_drop_tables(spark):
    rows = corpus(spark, {"r": "DROP TABLE t"}, kind="revert")
    assert "SA007" not in {r.rule for r in L.findings(rows).collect()}


@pytest.mark.parametrize("sql", ["SELECT 'open", "SELECT \"open", "/* open", "SELECT (1", "FROBNICATE t"])
def test_parse_errors(spark, sql):
    assert [r.rule for r in L.lint(corpus(spark, {"x": sql})).collect()] == ["parse-error"]


def test_blank_scripts_say_nothing(spark):
    assert L.lint(corpus(spark, {"a": "", "b": " \n\t", "c": "\\set x 1\n\\! ls\n"})).count() == 0


def test_mask_keeps_shape_and_hides_text(spark):
    sql = "SELECT 'a;b', E'q\\'; c', \"x;y\", $t$ ; $$ ; $t$; -- ; c\n/* ; /* ; */ ; */ SELECT 2; SELECT 'é;''z'"
    row = corpus(spark, {"x": sql}).select(T.mask(F.col("sql")).alias("m")).first()
    assert len(row.m) == len(sql) and [len(p) for p in row.m.split("\n")] == [len(p) for p in sql.split("\n")]
    assert row.m.count(";") == 2
    stmts = L.statements(corpus(spark, {"x": sql})).orderBy("stmt_no").collect()
    assert [(s.line, s.column) for s in stmts] == [(1, 1), (2, 19), (2, 29)]


def test_large_literals_do_not_overflow(spark):
    sql = "SELECT '" + "x''" * 400_000 + "'; SELECT E'" + "\\'y" * 300_000 + "'; /*" + "* " * 300_000 + "*/ UPDATE t SET a = " + "(1)" + " + (1)" * 20_000
    rows = corpus(spark, {"x": sql})
    assert [r.rule for r in L.findings(rows).collect()] == ["SA010"]


def test_suppression_blocks(spark):
    sql = "\n".join([
        "-- x:disable SA010", "-- x:disable SA010", "UPDATE t SET a = 1;", "-- x:enable SA010", "-- x:enable SA010", "UPDATE t SET a = 1;",
        "-- x:disable all,SA010", "UPDATE t SET a = 1; -- x:disable SA010", "-- x:disable SA008", "TRUNCATE t;",
    ])
    rows = corpus(spark, {"x": sql})
    ranges = [(r.rule, r.from_line, r.to_line, r.closed) for r in L.suppression_ranges(rows).orderBy("ord").collect()]
    assert ranges == [("SA010", 2, 4, True), ("SA010", 8, 8, True), ("SA008", 9, 10, False)]
    got = sorted((r.rule, r.line) for r in L.lint(rows).where("rule <> 'SA013'").collect())
    assert got == [("SA010", 6), ("suppression", 7), ("suppression", 7), ("suppression", 9)]


def test_registry_refuses_duplicates():
    with pytest.raises(ValueError):
        default_rules().register(Rule("SA001", "info", "true", "'x'"))
    assert len(default_rules().ids()) == 22


def test_context_keeps_known_quirks(spark):
    texts = {"drop": "ALTER TABLE t ALTER a DROP NOT NULL", "conc": "CREATE INDEX CONCURRENTLY i ON s.t (a)", "bad": "SELECT (", "none": "SELECT 1", "ctas": "CREATE TABLE t AS SELECT 1",
             "view": "CREATE OR REPLACE VIEW s.v AS SELECT 1", "trig": "CREATE TRIGGER g AFTER INSERT ON t EXECUTE FUNCTION f()", "type": "CREATE TYPE e AS ENUM ('a')",
             "multi": "DROP TABLE a, B.c; ALTER TABLE t OWNER TO me, DROP COLUMN x"}
    got = {r.path: r for r in E.script_context(corpus(spark, texts)).collect()}
    assert got["drop"].risk == "medium" and got["conc"].risk == "medium" and len(got["conc"].factors) == 2
    assert got["bad"].risk == "medium" and got["bad"].factors == [E.UNPARSED] and got["none"].factors == [E.NO_RISK]
    assert got["ctas"].operations == [] and got["view"].operations[0].object_name == "s.v" and got["trig"].tables == ["t"]
    assert got["type"].operations[0].type == "CREATE TYPE" and got["conc"].tables == ["s.t"]
    assert [o.object_name for o in got["multi"].operations] == ["a, b.c", "t"] and got["multi"].risk == "critical"
    assert got["multi"].operations[1].actions == ["OWNER TO", 'DROP COLUMN "x"']


DEPTHS = (1, 2, 6, 7, 20, 50)


@pytest.mark.parametrize(("text", "want"), [
    (lambda d: f"DELETE FROM t USING (SELECT 1 FROM a WHERE {'(' * d}x = 1{')' * d}) x;", {"SA010"}),
    (lambda d: f"ALTER TABLE t ADD CONSTRAINT c CHECK ({'(' * d}a IN (1, 2), b{')' * d}) NOT VALID;", {"SA013"}),
    (lambda d: "/* a ' ; " * d + "*/ " * d + "\nDROP TABLE foo;", {"SA007", "SA013"}),
    (lambda d: f"CREATE RULE r AS ON INSERT TO t DO ALSO ({'(' * d}SELECT 1{')' * d}; SELECT 2);\nDROP TABLE foo;", {"SA007", "SA013"}),
], ids=["using", "check", "comment", "rule"])
def test_depth_does_not_matter(spark, text, want):
    rows = spark.createDataFrame([(str(d), "deploy", text(d)) for d in DEPTHS], "path string, kind string, sql string")
    got = {}
    for r in L.lint(rows).collect():
        got.setdefault(r["path"], set()).add(r["rule"])
    assert got == {str(d): want for d in DEPTHS}


def test_atomic_body_is_one_statement(spark):
    sql = "CREATE FUNCTION f() RETURNS int LANGUAGE sql BEGIN ATOMIC SELECT CASE WHEN true THEN 1 END; RETURN 2; END;\nBEGIN;\nDROP TABLE foo;\nEND;"
    rows = L.statements(spark.createDataFrame([("p", "deploy", sql)], "path string, kind string, sql string")).orderBy("stmt_no").collect()
    assert [(r["line"], r["stmt"]) for r in rows] == [(1, sql.split(";\n")[0]), (2, "BEGIN"), (3, "DROP TABLE foo"), (4, "END")]


def test_columns_of_many_statements_in_one_line(spark):
    import time

    from changewright.functions import sqltext as T

    def places(n):
        parts = [f"SELECT {i}" + " " * (i % 3) for i in range(n)]
        line = ";".join(parts)
        df = spark.createDataFrame([(line,)], "l string").select(T.part_columns(F.split("l", ";")).alias("c"))
        begin = time.perf_counter()
        got = df.first()["c"]
        want, at = [], 1
        for p in parts:
            want.append(at)
            at += len(p) + 1
        assert got == want
        return time.perf_counter() - begin

    for n in (1, 2, 127, 128, 129, 257):
        places(n)
    small, large = places(2_000), places(20_000)
    assert large < 30 * max(small, 0.1)


def test_sizes_are_looked_up_in_one_pass(spark, tmp_path):
    rows = [
        ("a.sql", "deploy", "UPDATE big SET x = 1 WHERE y = 2;\nDELETE FROM small WHERE z = 1;"),
        ("b.sql", "deploy", "-- tool:disable SA011\nUPDATE big SET x = 1 WHERE y = 2;\nUPDATE big SET x = 2 WHERE y = 2;"),
        ("c.sql", "deploy", "-- tool:disable SA011\nUPDATE small SET x = 1 WHERE y = 2;"),
        ("d.sql", "deploy", "SELECT 1;"), ("e.sql", "deploy", "SELECT (;"),
    ]
    spark.createDataFrame(rows, "path string, kind string, sql string").write.parquet(str(tmp_path / "s"))
    stats = spark.createDataFrame([("big", 10**6), ("big", 10**6), ("small", 10)], "table_name string, rows long")
    out = L.lint(spark.read.parquet(str(tmp_path / "s")), stats=stats)
    got = sorted((r.path, r.rule) for r in out.collect() if r.rule in ("SA011", "parse-error") or r.message.startswith("Unused"))
    assert got == [("a.sql", "SA011"), ("c.sql", "suppression"), ("e.sql", "parse-error")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [path") == 1


def test_spread_makes_tasks_of_bounded_length(spark):
    from changewright.session import spread

    rows = spark.range(0, 1000, 1, 1)
    out = spread(rows, width=10)
    assert out.rdd.getNumPartitions() == 100 and out.count() == 1000
    assert spread(spark.range(0, 1000, 1, 100), width=10).rdd.getNumPartitions() == 100


def test_settled_rows_are_dealt_over_the_join(spark):
    """No row that needs no table size meets the join with a null key, which would be one task's work."""
    scripts = spark.createDataFrame([("a.sql", "deploy", "TRUNCATE t;"), ("b.sql", "deploy", "UPDATE big SET x = 1 WHERE y = 2;")], "path string, kind string, sql string")
    out = L.lint(scripts, stats=spark.createDataFrame([("big", 10**6)], "table_name string, rows long"))
    assert "concat(\u0000, path" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.path, r.rule) for r in out.collect()} >= {("a.sql", "SA008"), ("b.sql", "SA011")}
