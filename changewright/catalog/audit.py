"""Queries over the script audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from changewright.catalog import corpus as C
from changewright.catalog.corpus import scripts
from changewright.catalog.registry import query
from changewright.fixtures import table
from changewright.functions import sqltext as T
from changewright.functions import values as V
from changewright.functions.ids import fingerprint, script_hash
from changewright.operators import explain as E
from changewright.operators import lint as L
from changewright.operators.rules import Rule, default_rules
from changewright.sources import reports as R

S = "WITH " + C.SCRIPTS_SQL
FOUND = C.expected("found", "rule, severity, line, col", "found")
RAW = C.expected("raw", "rule, severity, line, col", "findings")
NOT_EXEMPT = "NOT (rule = 'SA007' AND kind = 'revert')"
LINTED = f"{S}, {FOUND}, linted AS (SELECT path, kind, k, s.n, rule, severity, line, col FROM scripts s JOIN found USING (n) WHERE {NOT_EXEMPT})"


def _short(found):
    return found.select("path", "rule", "severity", "line", F.col("column").alias("col"))


@query("lint", f"{LINTED} SELECT path, rule, severity, line, col FROM linted")
def lint(s, d):
    return _short(L.lint(scripts(s, d)))


@query("lint_configured", f"""{LINTED}, extra AS (SELECT path, 'SA002b' AS rule, 'error' AS severity, 2 AS line, 1 AS col FROM scripts WHERE n = 2),
skipped AS (SELECT path FROM scripts WHERE k % 3 = 0)
SELECT path, rule, CASE WHEN rule = 'suppression' THEN severity WHEN rule = 'SA012' THEN 'error' WHEN severity = 'warn' THEN 'error' ELSE severity END AS severity, line, col
FROM linted WHERE rule NOT IN ('SA006', 'SA010') AND NOT (rule = 'SA004' AND path IN (SELECT path FROM skipped))
UNION ALL SELECT * FROM extra
UNION ALL SELECT path, 'suppression', 'warn', unnest([1, 4]), 1 FROM scripts WHERE n = 22""")
def lint_configured(s, d):
    config = L.LintConfig(version=10, skip=["SA006"], severity={"SA010": "off", "SA012": "warn"}, error_on_warn=True)
    rows = scripts(s, d)
    key = F.regexp_extract("path", r"c(\d+)\.sql", 1).cast("long")
    skips = rows.where(key % 3 == 0).select("path", F.lit("SA004").alias("rule"))
    return _short(L.lint(rows, config, skips=skips))


@query("lint_connected", f"""{LINTED}, big AS (SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 200000)
SELECT path, rule, severity, line, col FROM linted
UNION ALL SELECT path, 'SA011', 'warn', 1, 1 FROM scripts JOIN big USING (k) WHERE n = 10
UNION ALL SELECT path, 'SA011', 'warn', 2, 12 FROM scripts JOIN big USING (k) WHERE n = 10
UNION ALL SELECT path, 'SA011', 'warn', unnest([2, 4]), 1 FROM scripts JOIN big USING (k) WHERE n = 22""")
def lint_connected(s, d):
    stats = table(s, d, "orders").select(F.concat(F.lit("t_"), F.col("o_orderkey").cast("string")).alias("table_name"), F.col("o_totalprice").alias("rows"))
    return _short(L.lint(scripts(s, d), L.LintConfig(max_affected_rows=200000), stats=stats))


@query("findings", f"{S}, {RAW} SELECT path, rule, severity, line, col FROM scripts JOIN raw USING (n) WHERE {NOT_EXEMPT}")
def findings(s, d):
    return _short(L.findings(scripts(s, d)))


@query("custom_rule", f"""{S} SELECT path, 'X001' AS rule, line, col, 'SELECT in ' || kind AS message
FROM scripts JOIN (VALUES (10, 2, 1), (21, 8, 3)) v(n, line, col) USING (n)""")
def custom_rule(s, d):
    rule = Rule("X001", "info", "i.verb = 'SELECT'", "concat('SELECT in ', i.kind)")
    rules = default_rules().register(rule)
    found = L.findings(scripts(s, d), [r for r in rules if r.id == "X001"]).where("rule = 'X001'")
    return found.select("path", "rule", "line", F.col("column").alias("col"), "message")


#: Texts of the statements that hold comments, bodies or literals, which are blank in the masked text.
MASKED = C.values("masked", "n, i, stmt", (
    (19, 1, "CREATE INDEX CONCURRENTLY i_{k} ON t_{k} (a)"), (19, 2, "REINDEX INDEX CONCURRENTLY i_{k}"), (21, 1, "CREATE FUNCTION f_{k}() RETURNS void AS $ $ LANGUAGE plpgsql"),
    (21, 2, "SELECT ' ', E' '"), (22, 1, "UPDATE t_{k} SET a = 1"), (22, 2, "DELETE FROM t_{k}"), (22, 3, "UPDATE u_{k} SET a = 2"), (23, 1, "CREATE TABLE t_{k} (a int"), (23, 2, "DROP TABLE x")))


@query("statements", rf"""{S}, {C.expected('st', 'line, col', 'stmts')}, {MASKED},
p AS (SELECT n, path, k, i, line, col, list_filter(list_transform(string_split(regexp_replace(sql, '''[0-9]s''', ''' ''', 'g'), ';'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS plain
  FROM scripts JOIN st USING (n) WHERE n <> 23 UNION ALL SELECT n, path, k, unnest([1, 2]), unnest([1, 2]), 1, [] FROM scripts WHERE n = 23)
SELECT path, p.i AS stmt_no, line, col, coalesce(replace(stmt, '{{k}}', CAST(k AS VARCHAR)), plain[p.i]) AS stmt FROM p LEFT JOIN masked m ON m.n = p.n AND m.i = p.i""")
def statements(s, d):
    return L.statements(scripts(s, d)).select("path", "stmt_no", "line", F.col("column").alias("col"), "stmt")


@query("mask", f"{S} SELECT path, length(sql) AS size, true AS same_lines, n IN (21, 22, 19) OR sql LIKE 'SET lock%' OR n = 12 AS changed FROM scripts")
def mask(s, d):
    rows = scripts(s, d).withColumn("m", T.mask(F.col("sql")))

    def breaks(c):
        return F.transform(F.split(c, "\n"), lambda l: F.length(l))

    return rows.select("path", F.length("m").alias("size"), (breaks(F.col("m")) == breaks(F.col("sql"))).alias("same_lines"), (F.col("m") != F.col("sql")).alias("changed"))


@query("mask_metacommands", f"{S} SELECT path, replace(sql, '\\echo done', '          ') AS sql FROM scripts")
def mask_metacommands(s, d):
    return scripts(s, d).select("path", T.mask_metacommands(F.col("sql")).alias("sql"))


@query("location", f"""{S} SELECT path, length(sql) - length(replace(sql, chr(10), '')) + 1 AS line, length(regexp_replace(sql, '(?s)^.*\\n', '')) + 1 AS col FROM scripts""")
def location(s, d):
    end = F.length("sql")
    return scripts(s, d).select("path", T.location_line(F.col("sql"), end).alias("line"), T.location_column(F.col("sql"), end).alias("col"))


@query("alter_actions", f"{S}, {C.expected('ac', 'action', 'actions')} SELECT path, i AS action_no, action FROM scripts JOIN ac USING (n)")
def alter_actions(s, d):
    return L.alter_actions(scripts(s, d)).select("path", "action_no", "action")


OPS = C.expected("ops", "type, object_name, lock", "ops")
OPS_K = "replace(object_name, '{k}', CAST(k AS VARCHAR))"


@query("operations", f"""{S}, {OPS} SELECT path, i AS op_no, type, {OPS_K} AS object_name, lock,
  lock = 'AccessExclusiveLock' AS blocks_reads, lock IN ('AccessExclusiveLock', 'ShareLock') AS blocks_writes FROM scripts JOIN ops USING (n)""")
def operations(s, d):
    return E.operations(scripts(s, d)).select("path", "op_no", "type", "object_name", "lock", "blocks_reads", "blocks_writes")


@query("tables_affected", f"""{S}, {OPS} SELECT DISTINCT path, regexp_replace({OPS_K}, '^.* ON ', '') AS "table" FROM scripts JOIN ops USING (n)
WHERE type IN ('ALTER TABLE', 'DROP TABLE') OR object_name LIKE '% ON %'""")
def tables_affected(s, d):
    return E.tables_affected(E.operations(scripts(s, d)))


RISKS = C.values("risks", "n, risk, broken", ((n, x.risk, x.broken) for n, x in enumerate(C.SHAPES)))


FACTORS = C.values("factors", "n, factors", (
    *((n, "adds a column") for n in (0, 1, 2, 12)), (3, "changes a column type, may rewrite the table"), (4, "creates an index, blocks writes unless concurrent"), (6, "drops a column"),
    (7, "drops a table"), (16, "touches a NOT NULL constraint, may scan the table"), (19, "creates an index, blocks writes unless concurrent; works concurrently, slower but not blocking"),
    (23, "the script cannot be parsed, review it by hand")))


@query("script_risk", f"{S}, {RISKS}, {FACTORS} SELECT path, risk, coalesce(factors, 'no risk factor found') AS factors FROM scripts JOIN risks USING (n) LEFT JOIN factors USING (n)")
def script_risk(s, d):
    return E.script_risk(scripts(s, d)).select("path", "risk", F.array_join("factors", "; ").alias("factors"))


@query("script_context", f"""{S}, {RISKS}, {OPS}, c AS (SELECT path, string_agg(type || ' ' || {OPS_K}, ',' ORDER BY i) AS operations, string_agg(lock, ',' ORDER BY i) AS locks,
  string_agg(regexp_replace({OPS_K}, '^.* ON ', ''), ',' ORDER BY i) FILTER (WHERE type IN ('ALTER TABLE', 'DROP TABLE') OR object_name LIKE '% ON %') AS tables FROM scripts JOIN ops USING (n) GROUP BY 1)
SELECT path, coalesce(operations, '') AS operations, coalesce(locks, '') AS locks, coalesce(tables, '') AS tables, risk, n = 23 AS unparsed FROM scripts JOIN risks USING (n) LEFT JOIN c USING (path)""")
def script_context(s, d):
    out = E.script_context(scripts(s, d))
    named = F.transform("operations", lambda o: F.concat_ws(" ", o["type"], o["object_name"]))
    return out.select(
        "path", F.array_join(named, ",").alias("operations"), F.array_join("locks.lock", ",").alias("locks"), F.array_join("tables", ",").alias("tables"), "risk",
        F.array_contains("factors", E.UNPARSED).alias("unparsed"))


RANGES = C.values("ranges", "n, ord, rule, from_line, to_line, closed", (
    (22, 1, "SA010", 1, 3, True), (22, 2, "SA010", 4, 4, True), (22, 3, "SA999", 4, 4, True), (22, 4, "SA008", 6, 6, False)))


@query("directives", f"""{S} SELECT path, line, action, rules, inline FROM scripts JOIN (VALUES (22, 1, 'disable', 'SA010', false), (22, 3, 'enable', 'SA010', false),
  (22, 4, 'disable', 'SA010,SA999', true), (22, 6, 'disable', 'SA008', false)) v(n, line, action, rules, inline) USING (n)""")
def directives(s, d):
    return L.directives(scripts(s, d)).withColumn("rules", F.array_join("rules", ","))


@query("suppression_ranges", f"{S}, {RANGES} SELECT path, ord, rule, from_line, to_line, closed FROM scripts JOIN ranges USING (n)")
def suppression_ranges(s, d):
    return L.suppression_ranges(scripts(s, d))


@query("apply_suppressions", f"""{S}, {RAW}, {RANGES}, f AS (SELECT path, k, n, rule, line, col FROM scripts JOIN raw USING (n) WHERE {NOT_EXEMPT})
SELECT f.path, f.rule, f.line, f.col, min(r.ord) AS ord, min(r.ord) IS NOT NULL OR (f.rule = 'SA004' AND f.k % 3 = 0) AS suppressed
FROM f LEFT JOIN ranges r ON r.n = f.n AND r.rule = f.rule AND f.line BETWEEN r.from_line AND r.to_line GROUP BY f.path, f.rule, f.line, f.col, f.k""")
def apply_suppressions(s, d):
    rows = scripts(s, d)
    key = F.regexp_extract("path", r"c(\d+)\.sql", 1).cast("long")
    skips = rows.where(key % 3 == 0).select("path", F.lit("SA004").alias("rule"))
    out = L.apply_suppressions(L.findings(rows), L.suppression_ranges(rows), skips)
    return out.select("path", "rule", "line", F.col("column").alias("col"), "ord", "suppressed")


@query("suppression_warnings", f"{S} SELECT path, line FROM scripts JOIN (VALUES (22, 4), (22, 4), (22, 6), (22, 6)) v(n, line) USING (n)")
def suppression_warnings(s, d):
    rows = scripts(s, d)
    hidden = L.apply_suppressions(L.findings(rows).select("path", "rule", "line"), L.suppression_ranges(rows)).where("ord is not null")
    return L.suppression_warnings(rows, hidden.select("path", "ord").distinct(), default_rules().ids()).select("path", "line")


@query("apply_severity", f"""{S}, {RAW} SELECT path, rule, CASE WHEN rule = 'SA004' THEN 'info' WHEN severity = 'warn' THEN 'error' ELSE severity END AS severity
FROM scripts JOIN raw USING (n) WHERE {NOT_EXEMPT} AND rule NOT IN ('SA001', 'SA021')""")
def apply_severity(s, d):
    config = L.LintConfig(skip=["SA001"], severity={"SA004": "info", "SA021": "off"}, error_on_warn=True)
    return L.apply_severity(L.findings(scripts(s, d)), config).select("path", "rule", "severity")


COUNTS = "count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (severity = 'info') AS info"


def _kind():
    return F.substring_index("path", "/", 1)


@query("finding_summary", f"{LINTED} SELECT kind, {COUNTS} FROM linted GROUP BY 1")
def finding_summary(s, d):
    return L.finding_summary(L.lint(scripts(s, d)).withColumn("kind", _kind()), ["kind"])


@query("review_risk", f"""{LINTED} SELECT path, {COUNTS}, 1 AS files, CASE WHEN bool_or(severity = 'error') THEN 'high' WHEN bool_or(severity = 'warn') THEN 'medium' ELSE 'low' END AS risk
FROM linted GROUP BY 1""")
def review_risk(s, d):
    return L.review_risk(L.lint(scripts(s, d)), ["path"])


@query("lint_verdict", f"{LINTED} SELECT path, CASE WHEN bool_or(severity IN ('error', 'warn')) THEN 2 ELSE 0 END AS code FROM linted GROUP BY 1")
def lint_verdict(s, d):
    return L.lint_verdict(L.lint(scripts(s, d)), True, ["path"])


@query("metacommand_report", f"{S} SELECT path, 7 AS line, '\\echo done' AS text FROM scripts WHERE n = 21")
def metacommand_report(s, d):
    return L.metacommand_report(scripts(s, d)).select("path", F.explode("lines").alias("l")).select("path", "l.*")


@query("script_flags", f"""{S} SELECT path, sql LIKE '%SET lock_timeout%' AS sets_timeout, n = 19 AS no_transaction, sha1(sql) AS script_hash FROM scripts""")
def script_flags(s, d):
    sql = F.col("sql")
    return scripts(s, d).select("path", V.sets_lock_timeout(sql).alias("sets_timeout"), V.is_non_transactional(sql).alias("no_transaction"), script_hash(sql).alias("script_hash"))


@query("report_json", f"""{LINTED} SELECT path, 1 AS version, 'audit' AS tool, {COUNTS},
  string_agg(rule || ':' || severity || ':' || path || ':' || line || ':' || col, ' ' ORDER BY line, col, rule) AS entries FROM linted GROUP BY 1""")
def report_json(s, d):
    out = R.report_json(L.lint(scripts(s, d)), tool="audit")
    entry = "struct<ruleId:string, severity:string, message:string, location:struct<file:string, line:int, column:int>>"
    doc = F.from_json("json", f"version int, metadata struct<tool:string>, findings array<{entry}>, summary struct<errors:long,warnings:long,info:long>")

    def told(e):
        place = e["location"]
        return F.when(F.length(e["message"]) > 0, F.concat_ws(":", e["ruleId"], e["severity"], place["file"], place["line"].cast("string"), place["column"].cast("string")))

    return out.select("path", doc.alias("j")).select("path", "j.version", "j.metadata.tool", "j.summary.*", F.array_join(F.transform("j.findings", told), " ").alias("entries"))


@query("report_annotations", f"""{LINTED} SELECT '::' || CASE severity WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'notice' END
  || ' file=' || path || ',line=' || line || ',col=' || col || '::' || rule AS head FROM linted""")
def report_annotations(s, d):
    out = R.report_annotations(L.lint(scripts(s, d)))
    return out.select(F.regexp_extract("value", r"^(::\w+ file=[^:]+::[\w-]+): ", 1).alias("head"))


@query("report_code_quality", f"""{LINTED} SELECT rule AS check_name, sha1(rule || ':' || path || ':' || line) AS fingerprint,
  CASE severity WHEN 'error' THEN 'critical' WHEN 'warn' THEN 'major' ELSE 'minor' END AS severity, path, line FROM linted""")
def report_code_quality(s, d):
    out = R.report_code_quality(L.lint(scripts(s, d)))
    return out.select("check_name", "fingerprint", "severity", F.col("location.path").alias("path"), F.col("location.lines.begin").alias("line"))


@query("fingerprint", f"{LINTED} SELECT path, rule, line, sha1(rule || ':' || path || ':' || line) AS fingerprint FROM linted")
def fingerprint_query(s, d):
    out = L.lint(scripts(s, d)).select("path", "rule", "line")
    return out.withColumn("fingerprint", fingerprint(F.col("rule"), F.col("path"), F.col("line")))
