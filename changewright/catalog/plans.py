"""Queries over plan files, ids and historic includes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from changewright.catalog.registry import query
from changewright.fixtures import PLAN_SQL, micros, plan_changes, table
from changewright.functions import ids
from changewright.operators import includes as I
from changewright.operators import ordered
from changewright.plans import text as P
from changewright.session import checkpoint_dir, spread

# Plan file of one order; {k} order key, {p} project number.
PLAN = (
    "%syntax-version=1.0.0\n%project=p{p}\n%uri=https://example.org/{k}\n\n# remark\n"
    "alpha 2024-01-01T00:00:00Z Ann A <a@x.org> # start {k}\n"
    "beta [alpha !old other:z] 2024-01-02T00:00:00Z Bob  <b@x.org># second\\n\\\\line\n"
    "@v1 2024-01-03T00:00:00Z Ann A <a@x.org> # tag é\n"
    "gamma [beta@v1]  2024-01-04T00:00:00Z Cy <c@x.org>\n"
)


def plan_texts(s, d):
    o = spread(table(s, d, "orders").select("o_orderkey", "o_custkey"))
    key, project = F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 11).cast("string")
    text = F.replace(F.replace(F.lit(PLAN), F.lit("{k}"), key), F.lit("{p}"), project)
    return o.select(F.concat(F.lit("plan"), key).alias("plan"), text.alias("text"))


def _id(kind: str, content: str) -> str:
    return f"sha1('{kind} ' || strlen({content}) || chr(0) || {content})"


NL = "chr(10)"
HEAD = "'project p' || (o_custkey % 11) || chr(10) || 'uri https://example.org/' || o_orderkey || chr(10)"
ALPHA = f"{HEAD} || 'change alpha' || {NL} || 'planner Ann A <a@x.org>' || {NL} || 'date 2024-01-01T00:00:00Z' || {NL} || {NL} || 'start ' || o_orderkey"
BETA = f"""{HEAD} || 'change beta' || {NL} || 'parent ' || alpha || {NL} || 'planner Bob  <b@x.org>' || {NL} || 'date 2024-01-02T00:00:00Z' || {NL} || 'requires' || {NL}
  || '  + alpha' || {NL} || '  + other:z' || {NL} || 'conflicts' || {NL} || '  - old' || {NL} || {NL} || 'second' || {NL} || '\\line'""".replace("Bob  <", "Bob  <")
GAMMA = f"{HEAD} || 'change gamma' || {NL} || 'parent ' || beta || {NL} || 'planner Cy <c@x.org>' || {NL} || 'date 2024-01-04T00:00:00Z' || {NL} || 'requires' || {NL} || '  + beta@v1'"
TAG = f"{HEAD} || 'tag @v1' || {NL} || 'change ' || beta || {NL} || 'planner Ann A <a@x.org>' || {NL} || 'date 2024-01-03T00:00:00Z' || {NL} || {NL} || 'tag é'"
IDS = f"""WITH a AS (SELECT *, {_id('change', ALPHA)} AS alpha FROM orders), b AS (SELECT *, {_id('change', BETA)} AS beta FROM a),
c AS (SELECT *, {_id('change', GAMMA)} AS gamma, {_id('tag', TAG)} AS tag_id FROM b)"""


@query("read_plans", f"""{IDS} SELECT 'plan' || o_orderkey AS plan, 6 AS pos, 'alpha' AS name, alpha AS change_id, NULL AS parent, 'Ann A' AS planner_name, '' AS requires FROM c
UNION ALL SELECT 'plan' || o_orderkey, 7, 'beta', beta, alpha, 'Bob ', 'alpha,other:z' FROM c
UNION ALL SELECT 'plan' || o_orderkey, 9, 'gamma', gamma, beta, 'Cy', 'beta@v1' FROM c""")
def read_plans(s, d):
    changes, _, _ = P.parse_plans(plan_texts(s, d))
    return changes.select("plan", "pos", "name", "change_id", "parent", "planner_name", F.array_join("requires", ",").alias("requires"))


@query("read_plan_tags", f"{IDS} SELECT 'plan' || o_orderkey AS plan, 'v1' AS tag, beta AS change_id, tag_id, 7 AS change_pos FROM c")
def read_plan_tags(s, d):
    _, tags, _ = P.parse_plans(plan_texts(s, d))
    return tags.select("plan", "tag", "change_id", "tag_id", "change_pos")


@query("read_plan_pragmas", """SELECT 'plan' || o_orderkey AS plan, k AS key, CASE k WHEN 'syntax-version' THEN '1.0.0' WHEN 'project' THEN 'p' || (o_custkey % 11)
  ELSE 'https://example.org/' || o_orderkey END AS value FROM orders, (VALUES ('syntax-version'), ('project'), ('uri')) v(k)""")
def read_plan_pragmas(s, d):
    return P.plan_pragmas(plan_texts(s, d)).select("plan", "key", "value")


@query("recompute_ids", f"""{IDS} SELECT alpha AS change_id, alpha AS computed_id FROM c UNION ALL SELECT beta, beta FROM c UNION ALL SELECT gamma, gamma FROM c""")
def recompute_ids(s, d):
    changes, _, _ = P.parse_plans(plan_texts(s, d))
    return P.recompute_ids(changes).select("change_id", "computed_id")


CHAIN = f"'project ' || n.project || {NL} || 'change ' || n.name || {NL} || coalesce('parent ' || c.change_id || {NL}, '') || 'planner Ann <a@x.org>' || {NL} || 'date d' || n.pos || CASE WHEN n.requires = '' THEN '' ELSE {NL} || 'requires' || {NL} || '  + ' || n.requires END"


FILED = CHAIN.replace("'date d' || n.pos", "'date 2024-01-01T00:00:00Z'")


@query("read_plan_files", f"""WITH RECURSIVE {PLAN_SQL},
n AS (SELECT target || '-' || project AS project, pos, name, array_to_string(requires, {NL} || '  + ') AS requires, row_number() OVER (PARTITION BY target, project ORDER BY pos) AS i FROM plan_changes),
c AS (SELECT n.project, n.pos, n.i, n.name, {_id('change', FILED.replace("coalesce('parent ' || c.change_id || chr(10), '')", "''"))} AS change_id FROM n WHERE i = 1
      UNION ALL SELECT n.project, n.pos, n.i, n.name, {_id('change', FILED)} FROM c JOIN n ON n.project = c.project AND n.i = c.i + 1)
SELECT 'change' AS entry, project, i + 2 AS line_no, name, change_id AS value FROM c
UNION ALL SELECT 'tag', project, max(i) + 3, 'v1', arg_max(change_id, i) FROM c GROUP BY project
UNION ALL SELECT 'pragma', p, k, CASE k WHEN 1 THEN 'syntax-version' ELSE 'project' END, CASE k WHEN 1 THEN '1.0.0' ELSE p END FROM (SELECT DISTINCT project AS p FROM n), (VALUES (1), (2)) v(k)""")
def read_plan_files(s, d):
    """Plan files on disk, one per target and project with a line per order, read back in one parse."""
    folder = f"{checkpoint_dir(s)}/{uuid.uuid4().hex}"
    plan = plan_changes(s, d).withColumn("project", F.concat_ws("-", "target", "project"))
    deps = F.when(F.size("requires") > 0, F.concat(F.lit(" ["), F.array_join("requires", " "), F.lit("]"))).otherwise("")
    lines = plan.select("project", F.col("pos").alias("at"), F.concat(F.col("name"), deps, F.lit(" 2024-01-01T00:00:00Z Ann <a@x.org>")).alias("line"))
    names = plan.select("project").distinct()
    frame = [(-2, F.lit("%syntax-version=1.0.0")), (-1, F.concat(F.lit("%project="), "project")), (1 << 62, F.lit("@v1 2024-01-02T00:00:00Z Ann <a@x.org>"))]
    for at, line in frame:
        lines = lines.unionByName(names.select("project", F.lit(at).cast("long").alias("at"), line.alias("line")))
    lines.repartition("project").sortWithinPartitions("project", "at").select("project", "line").write.partitionBy("project").text(folder)
    changes, tags, pragmas = P.read_plans(s, folder)
    parts = [
        changes.select(F.lit("change").alias("entry"), "project", F.col("pos").alias("line_no"), "name", F.col("change_id").alias("value")),
        tags.select(F.lit("tag").alias("entry"), "project", F.col("pos").alias("line_no"), F.col("tag").alias("name"), F.col("change_id").alias("value")),
        pragmas.select(F.lit("pragma").alias("entry"), F.regexp_extract("plan", r"project=([^/]*)/", 1).alias("project"), "line_no", F.col("key").alias("name"), "value"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_HEADS = "(VALUES (1, 'syntax-version', '1.0.0'), (2, 'project', NULL)) v(k, name, note)"
_NOTE = "o_orderpriority || chr(92) || 'n' || chr(10) || chr(9) || '# <é> ' || o_orderkey"


@query("write_plans", f"""WITH {PLAN_SQL},
n AS (SELECT *, target || '-' || project AS plan, row_number() OVER (PARTITION BY target, project ORDER BY pos) AS i FROM plan_changes)
SELECT plan, 2 * i + 2 AS pos, 'change' AS entry, name, array_to_string(requires, ',') AS requires, array_to_string(conflicts, ',') AS conflicts, 'Ann ' AS planner_name, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE {_NOTE} END AS note FROM n
UNION ALL SELECT plan, 2 * i + 3, 'tag', 'v' || o_orderkey, '', '', 'Bo B', {_NOTE} FROM n WHERE o_orderkey % 10 = 0
UNION ALL SELECT plan, k, 'pragma', name, '', '', NULL, coalesce(note, plan) FROM (SELECT DISTINCT plan FROM n), {_HEADS}""")
def write_plans(s, d):
    """Changes, tags and pragmas written as one plan file per target and project, and read back from disk."""
    folder = f"{checkpoint_dir(s)}/{uuid.uuid4().hex}"
    key = F.col("o_orderkey")
    notes = table(s, d, "orders").select((key + 1).alias("pos"), F.concat("o_orderpriority", F.lit("\\n\n\t# <é> "), key.cast("string")).alias("note"), key)
    plan = plan_changes(s, d).withColumn("plan", F.concat_ws("-", "target", "project")).select("plan", "pos", "name", "requires", "conflicts")
    dense = ordered.unsliced(ordered.number(ordered.slice_by_position(plan, "pos"), ["plan"], "i")).join(notes, "pos")
    none, uri = F.array().cast("array<string>"), F.lit(None).cast("string")

    def rows(df, pos, entry, name, requires, conflicts, stamp, planner, email, note):
        own = zip((pos, entry, name, requires, conflicts, stamp, planner, email, note), ("pos", "entry", "name", "requires", "conflicts", "planned_at", "planner_name", "planner_email", "note"), strict=True)
        return df.select("plan", F.col("plan").alias("project"), uri.alias("uri"), *[c.alias(n) for c, n in own])

    own, i = [F.col(c) for c in ("requires", "conflicts")], F.col("i")
    changes = rows(dense, 2 * i + 2, F.lit("change"), F.col("name"), *own, F.lit("2024-01-01T00:00:00Z"), F.lit("Ann "), F.lit("a@x.org"), F.when(key % 3 == 0, "").otherwise(F.col("note")))
    tags = rows(dense.where(key % 10 == 0), 2 * i + 3, F.lit("tag"), F.concat(F.lit("v"), key.cast("string")), none, none, F.lit("2024-01-02T00:00:00Z"), F.lit("Bo B"), F.lit("b@x.org"), F.col("note"))
    every, names = changes.unionByName(tags), plan.select("plan").distinct()
    for at, name, value in ((1, "syntax-version", F.lit("1.0.0")), (2, "project", F.col("plan"))):
        every = every.unionByName(rows(names, F.lit(at).cast("long"), F.lit("pragma"), F.lit(name), none, none, uri, uri, uri, value))
    P.write_plans(every, folder)
    back = P.read_written_rows(s, folder)
    return back.select("plan", "pos", "entry", "name", F.array_join("requires", ",").alias("requires"), F.array_join("conflicts", ",").alias("conflicts"), "planner_name", "note")


@query("chain_build", f"""WITH RECURSIVE {PLAN_SQL},
n AS (SELECT target, project, pos, name, array_to_string(requires, {NL} || '  + ') AS requires, row_number() OVER (PARTITION BY target, project ORDER BY pos) AS i FROM plan_changes),
c AS (SELECT n.target, n.project, n.pos, n.i, {_id('change', CHAIN.replace("coalesce('parent ' || c.change_id || chr(10), '')", "''"))} AS change_id FROM n WHERE i = 1
      UNION ALL SELECT n.target, n.project, n.pos, n.i, {_id('change', CHAIN)} FROM c JOIN n ON n.target = c.target AND n.project = c.project AND n.i = c.i + 1)
SELECT target, project, pos, change_id FROM c""")
def chain_build(s, d):
    plan = plan_changes(s, d).drop("change_id", "conflicts").withColumns({
        "uri": F.lit(None).cast("string"), "planner_name": F.lit("Ann"), "planner_email": F.lit("a@x.org"), "note": F.lit(""),
        "planned_at": F.concat(F.lit("d"), F.col("pos").cast("string")), "conflicts": F.array().cast("array<string>"),
    })
    return P.chain_build(plan, ["target", "project"]).select("target", "project", "pos", "change_id")


@query("change_id", f"""SELECT o_orderkey, {_id('change', "'project x' || chr(10) || 'change c' || o_orderkey || chr(10) || 'planner é <e@x.org>' || chr(10) || 'date d' || chr(10) || chr(10) || o_orderpriority")} AS change_id,
  {_id('tag', "'project x' || chr(10) || 'tag @t' || chr(10) || 'change ' || o_orderkey || chr(10) || 'planner é <e@x.org>' || chr(10) || 'date d'")} AS tag_id FROM orders""")
def change_id(s, d):
    key, none, empty = F.col("o_orderkey").cast("string"), F.lit(None).cast("string"), F.array().cast("array<string>")
    who = (F.lit("é"), F.lit("e@x.org"), F.lit("d"))
    change = ids.change_id(F.lit("x"), none, F.concat(F.lit("c"), key), F.lit(""), *who, empty, empty, F.col("o_orderpriority"))
    tag = ids.tag_id(F.lit("x"), none, F.lit("t"), key, *who, F.lit(""))
    return table(s, d, "orders").select("o_orderkey", change.alias("change_id"), tag.alias("tag_id"))


HEALTH = {
    "1-URGENT": ("%project=a\nx 2024-01-01T00:00:00Z A <a@x>\n", ((1, "no-syntax-version", "warn"),)),
    "2-HIGH": ("%syntax-version=2\n%project=a\n@v1 2024-01-01T00:00:00Z A <a@x>\nx [y 2024-01-01T00:00:00Z A <a@x>", ((1, "syntax-version", "error"), (3, "tag-before-change", "error"), (4, "unclosed-bracket", "error"))),
    "3-MEDIUM": ("%syntax-version=1.0.0\nx 2024-01-01 A <a@x>\n# c\ny 2024-01-01T00:00:00Z A\n", ((1, "no-project", "error"), (2, "timestamp", "error"), (4, "email", "error"))),
    "4-NOT SPECIFIED": ("%syntax-version=1\n%project=a\nx 2024-01-01T00:00:00Z A <a@x>\n@1v 2024-01-01T00:00:00Z A <a@x>\n[z] 2024-01-01T00:00:00Z A <a@x>\n", ((4, "tag-name", "error"), (5, "name", "error"))),
    "5-LOW": (PLAN, ()),
}


@query("plan_health", """SELECT 'plan' || o_orderkey AS plan, line_no, "check", severity FROM orders JOIN (VALUES """ + ", ".join(
    f"('{p}', {n}, '{c}', '{v}')" for p, (_, rows) in HEALTH.items() for n, c, v in rows) + """) h(p, line_no, "check", severity) ON p = o_orderpriority""")
def plan_health(s, d):
    text = F.lit(None).cast("string")
    for priority, (body, _) in HEALTH.items():
        text = F.when(F.col("o_orderpriority") == priority, F.lit(body)).otherwise(text)
    texts = table(s, d, "orders").select(F.concat(F.lit("plan"), F.col("o_orderkey").cast("string")).alias("plan"), text.alias("text"))
    return P.plan_health(texts)


# -- includes ----------------------------------------------------------------

SCRIPT = "-- head\n\\ir ../shared/f{c}.sql\nSELECT {k};\n/*\n\\i skipped.sql\n*/\n  \\include 'shared/./g.sql';\n-- end"


def include_scripts(s, d):
    o = spread(table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    key, file = F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 20).cast("string")
    sql = F.replace(F.replace(F.lit(SCRIPT), F.lit("{k}"), key), F.lit("{c}"), file)
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("deploy/c"), key, F.lit(".sql")).alias("path"), F.col("o_orderdate").alias("planned_at"), sql.alias("sql"))


def file_versions(s, d):
    """Shared files change on ship dates: f0..f19 (each includes a base file), base0..base2, g."""
    l = table(s, d, "lineitem").withColumnRenamed("l_shipdate", "ts")

    def versions(path, body):
        return l.groupBy(path.alias("path"), "ts").agg(F.count(F.lit(1)).alias("n")).select("path", "ts", "n", body.alias("sql"))

    def name(stem, number):
        return F.concat(F.lit(f"shared/{stem}"), (F.col(number) % (20 if stem == "f" else 3)).cast("string"), F.lit(".sql"))

    count = F.col("n").cast("string")
    files = versions(name("f", "l_partkey"), F.concat(F.lit("f "), count, F.lit("\n\\ir base1.sql")))
    bases = versions(name("base", "l_suppkey"), F.concat(F.lit("base "), count))
    return files.unionByName(bases).unionByName(versions(F.lit("shared/g.sql"), F.concat(F.lit("g "), count)))


VERSIONS_SQL = """WITH versions AS (
  SELECT 'shared/f' || (l_partkey % 20) || '.sql' AS path, l_shipdate AS ts, count(*) AS n FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'shared/base' || (l_suppkey % 3) || '.sql', l_shipdate, count(*) FROM lineitem GROUP BY 1, 2
  UNION ALL SELECT 'shared/g.sql', l_shipdate, count(*) FROM lineitem GROUP BY 1, 2),
head AS (SELECT path, arg_max(n, ts) AS n FROM versions GROUP BY 1),
pairs AS (SELECT path, planned_at FROM head, (SELECT DISTINCT o_orderdate AS planned_at FROM orders)),
seen AS MATERIALIZED (SELECT p.path, p.planned_at, coalesce(v.n, h.n) AS n, v.n IS NULL AS from_head FROM pairs p
         ASOF LEFT JOIN versions v ON p.path = v.path AND p.planned_at >= v.ts JOIN head h ON h.path = p.path)"""


@query("include_version_asof", f"""{VERSIONS_SQL} SELECT o_orderkey AS id, s.path, s.n, s.from_head FROM orders
JOIN seen s ON s.planned_at = o_orderdate AND s.path = 'shared/f' || (o_custkey % 20) || '.sql'""")
def include_version_asof(s, d):
    o = table(s, d, "orders")
    path = F.concat(F.lit("shared/f"), (F.col("o_custkey") % 20).cast("string"), F.lit(".sql"))
    refs = o.select(F.col("o_orderkey").alias("id"), path.alias("path"), F.col("o_orderdate").alias("planned_at"))
    return I.include_version_asof(refs, file_versions(s, d), "n").select("id", "path", "n", "from_head")


@query("include_directives", """SELECT 'deploy/c' || o_orderkey || '.sql' AS path, line, type, CASE line WHEN 2 THEN 'shared/f' || (o_custkey % 20) || '.sql' ELSE 'shared/g.sql' END AS include
FROM orders, (VALUES (2, 'ir'), (7, 'i')) v(line, type)""")
def include_directives(s, d):
    return I.include_directives(include_scripts(s, d)).select("path", "line", "type", "include")


MARK = "'-- [snapshot] {} include: ' || {}"


@query("expand_includes", f"""{VERSIONS_SQL}, x AS (SELECT o_orderkey AS id, '../shared/f' || (o_custkey % 20) || '.sql' AS f, sf.n AS fn, sb.n AS bn, sg.n AS gn FROM orders
  JOIN seen sf ON sf.planned_at = o_orderdate AND sf.path = 'shared/f' || (o_custkey % 20) || '.sql'
  JOIN seen sb ON sb.planned_at = o_orderdate AND sb.path = 'shared/base1.sql' JOIN seen sg ON sg.planned_at = o_orderdate AND sg.path = 'shared/g.sql')
SELECT id, concat_ws(chr(10), '-- head', {MARK.format('begin', 'f')}, 'f ' || fn, {MARK.format('begin', "'base1.sql'")}, 'base ' || bn, {MARK.format('end', "'base1.sql'")},
  {MARK.format('end', 'f')}, 'SELECT ' || id || ';', '/*', '\\i skipped.sql', '*/', {MARK.format('begin', "'shared/./g.sql'")}, 'g ' || gn, {MARK.format('end', "'shared/./g.sql'")}, '-- end') AS sql FROM x""")
def expand_includes(s, d):
    return I.expand_includes(include_scripts(s, d), file_versions(s, d).select("path", "ts", "sql"))


@query("expand_includes_newest", rf"""{VERSIONS_SQL}, x AS (SELECT o_orderkey AS id, '../shared/f' || (o_custkey % 20) || '.sql' AS f, sf.n AS fn, sb.n AS bn, sg.n AS gn FROM orders
  JOIN head sf ON sf.path = 'shared/f' || (o_custkey % 20) || '.sql' JOIN head sb ON sb.path = 'shared/base1.sql' JOIN head sg ON sg.path = 'shared/g.sql')
SELECT id, concat_ws(chr(10), '-- head', {MARK.format('begin', 'f')}, 'f ' || fn, {MARK.format('begin', "'base1.sql'")}, 'base ' || bn, {MARK.format('end', "'base1.sql'")},
  {MARK.format('end', 'f')}, 'SELECT ' || id || ';', '/*', '\i skipped.sql', '*/', {MARK.format('begin', "'shared/./g.sql'")}, 'g ' || gn, {MARK.format('end', "'shared/./g.sql'")}, '-- end') AS sql FROM x""")
def expand_includes_newest(s, d):
    return I.expand_includes(include_scripts(s, d), file_versions(s, d).select("path", "ts", "sql"), snapshot=False)


@query("included_files", f"""{VERSIONS_SQL}, stamp AS MATERIALIZED (SELECT p.path, p.planned_at, coalesce(v.ts, (SELECT max(ts) FROM versions m WHERE m.path = p.path)) AS ts
  FROM pairs p ASOF LEFT JOIN versions v ON p.path = v.path AND p.planned_at >= v.ts),
w AS (SELECT o_orderkey AS id, o_orderdate AS planned_at, u.* FROM orders, LATERAL (SELECT unnest([2, 2, 7]) AS line, unnest([1, 2, 1]) AS depth,
  unnest(['shared/f' || (o_custkey % 20) || '.sql', 'shared/base1.sql', 'shared/g.sql']) AS path) u)
SELECT id, line, depth, w.path, epoch_us(CAST(ts AS TIMESTAMP)) AS version_us FROM w JOIN stamp USING (path, planned_at)""")
def included_files(s, d):
    out = I.included_files(include_scripts(s, d), file_versions(s, d).select("path", "ts", "sql"))
    return out.select("id", F.get("ord", F.lit(0)).alias("line"), "depth", "path", micros(F.col("version")).alias("version_us"))


@query("include_path", """SELECT o_orderkey AS id, 'deploy/' || CASE o_orderstatus WHEN 'F' THEN 'b.sql' WHEN 'O' THEN 'sub/c.sql' ELSE 'sub' END AS a,
  CASE o_orderstatus WHEN 'F' THEN '../x' WHEN 'O' THEN 'x/y' ELSE '.' END AS b FROM orders""")
def include_path(s, d):
    status = F.col("o_orderstatus")
    rel = F.when(status == "F", "../sub/../b.sql").when(status == "O", "./c.sql").otherwise("../sub/")
    root = F.when(status == "F", "../x").when(status == "O", "x//y").otherwise("x/..")
    here = F.when(status == "F", "deploy/sub/a.sql").when(status == "O", "deploy/sub/a.sql").otherwise("deploy/k/a.sql")
    return table(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), I.include_path(F.lit("ir"), rel, here).alias("a"), I.include_path(F.lit("i"), root, here).alias("b")
    )
