"""Queries over change history and dependency graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from changewright.catalog.registry import query
from changewright.fixtures import EVENTS_SQL, PLAN_SQL, change_events, deployed, micros, plan_changes, plan_tags, table
from changewright.functions.names import base_name, pair_base, parse_deps, phase_of
from changewright.operators import graph as G
from changewright.operators import history as H
from changewright.session import checkpoint_dir
from changewright.sources import history_store as S
from changewright.sources import scripts as C

P, E = "WITH " + PLAN_SQL, "WITH " + EVENTS_SQL
K = ["target", "project"]
NOT_DEPLOYED = "NOT EXISTS (SELECT 1 FROM deployed d WHERE d.target = p.target AND d.project = p.project AND d.change_id = p.change_id)"


def _text(df, *arrays):
    return df.withColumns({a: F.array_join(a, ",") for a in arrays})


@query("pending", f"{E} SELECT target, project, pos, change_id, name FROM plan_changes p WHERE {NOT_DEPLOYED}")
def pending(s, d):
    return H.pending(plan_changes(s, d), deployed(s, d)).select(*K, "pos", "change_id", "name")


@query("pending_list", f"""{E} SELECT target, project, pos, name, change_id,
  row_number() OVER (PARTITION BY target, project ORDER BY pos) AS seq FROM plan_changes p WHERE {NOT_DEPLOYED}""")
def pending_list(s, d):
    return H.pending_list(plan_changes(s, d), deployed(s, d))


@query("diff_status", f"""{E} SELECT target, project, change_id, name,
  CASE WHEN {NOT_DEPLOYED} THEN 'pending' ELSE 'deployed' END AS status FROM plan_changes p""")
def diff_status(s, d):
    return H.diff_status(plan_changes(s, d), deployed(s, d)).select(*K, "change_id", "name", "status")


@query("range_diff", f"""{E}, b AS (
  SELECT target, project, min(pos) FILTER (tag = 'v0') AS lo, min(pos) FILTER (tag = 'v1') AS hi FROM plan_tags GROUP BY 1, 2)
SELECT p.target, p.project, p.pos, p.change_id, CASE WHEN {NOT_DEPLOYED} THEN 'pending' ELSE 'deployed' END AS status
FROM plan_changes p JOIN b USING (target, project) WHERE p.pos > b.lo AND p.pos <= b.hi""")
def range_diff(s, d):
    out = H.range_diff(plan_changes(s, d), plan_tags(s, d), "v0", "v1", deployed(s, d), strict=False)
    return out.select(*K, "pos", "change_id", "status")


SCRIPT_NAMES_SQL = """
first_tags AS (SELECT target, project, change_id, min(pos) AS pos, min_by(tag, (pos, tag)) AS tag FROM plan_tags GROUP BY 1, 2, 3),
versions AS (SELECT *, lead(pos) OVER (PARTITION BY target, project, name ORDER BY pos) AS next_pos FROM plan_changes),
script_names AS (
  SELECT v.target, v.project, v.change_id, v.pos, v.name,
         v.name || coalesce('@' || (SELECT min_by(t.tag, t.pos) FROM first_tags t WHERE t.target = v.target AND t.project = v.project
                                    AND t.pos >= v.pos AND t.pos < v.next_pos), '') AS script_name
  FROM versions v)"""


@query("script_names", f"{P}, {SCRIPT_NAMES_SQL} SELECT * FROM script_names")
def script_names(s, d):
    return H.script_names(plan_changes(s, d), plan_tags(s, d))


@query("modified_scripts", f"""{E}, {SCRIPT_NAMES_SQL}
SELECT n.target, n.project, n.change_id, n.name, n.script_name, p.script_hash AS deployed_hash, sha1(p.script_hash || '-edited') AS current_hash
FROM script_names n JOIN plan_changes p USING (target, project, change_id) JOIN deployed USING (target, project, change_id)
WHERE p.o_orderpriority = '1-URGENT'
  AND NOT EXISTS (SELECT 1 FROM script_names m WHERE m.target = n.target AND m.project = n.project AND m.script_name = n.script_name AND m.pos > n.pos)""")
def modified_scripts(s, d):
    plan = plan_changes(s, d)
    named = H.script_names(plan, plan_tags(s, d))
    hashes = plan.select(*K, "change_id", "script_hash", "o_orderpriority", "pos")
    recorded = deployed(s, d).join(hashes.drop("o_orderpriority", "pos"), [*K, "change_id"])
    # A file belongs to the last change that uses its name; urgent ones were edited.
    edited = F.sha1(F.concat("script_hash", F.lit("-edited")).cast("binary"))
    owner = named.groupBy(*K, "script_name").agg(F.max_by("change_id", "pos").alias("change_id"))
    files = owner.join(hashes, [*K, "change_id"]).withColumn("script_hash", F.when(F.col("o_orderpriority") == "1-URGENT", edited).otherwise(F.col("script_hash")))
    own = named.join(owner, [*K, "script_name", "change_id"], "left_semi")
    out = H.modified_scripts(own, recorded, files)
    return out.select(*K, "change_id", "name", "script_name", "deployed_hash", "current_hash")


@query("status_rollup", f"""{E}, pc AS (SELECT target, project, count(*) FILTER ({NOT_DEPLOYED}) AS pending_count FROM plan_changes p GROUP BY 1, 2),
dc AS (SELECT target, project, count(*) AS deployed_count, arg_max(name, (committed_at, change_id)) AS last_change,
              arg_max(change_id, (committed_at, change_id)) AS last_change_id FROM deployed GROUP BY 1, 2),
mc AS (SELECT target, project, count(*) AS modified_count FROM plan_changes p JOIN deployed USING (target, project, change_id)
       WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)
SELECT target, project, coalesce(deployed_count, 0) AS deployed_count, coalesce(pending_count, 0) AS pending_count, last_change, last_change_id,
       coalesce(modified_count, 0) AS modified_count
FROM pc FULL JOIN dc USING (target, project) LEFT JOIN mc USING (target, project)""")
def status_rollup(s, d):
    plan, done = plan_changes(s, d), deployed(s, d)
    urgent = plan.where("o_orderpriority = '1-URGENT'").join(done.select(*K, "change_id"), [*K, "change_id"])
    return H.status_rollup(plan, done, modified=urgent).drop("last_committed_at")


@query("missing_dependencies", f"""{E}, r AS (SELECT target, project, change_id, name, unnest(requires) AS dependency FROM plan_changes)
SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM plan_changes p WHERE p.target = r.target AND p.project = r.project AND p.name = split_part(r.dependency, '@', 1))
  AND NOT EXISTS (SELECT 1 FROM deployed p WHERE p.target = r.target AND p.project = r.project AND p.name = split_part(r.dependency, '@', 1))""")
def missing_dependencies(s, d):
    return H.missing_dependencies(plan_changes(s, d), deployed(s, d)).select(*K, "change_id", "name", "dependency")


@query("conflicts", f"""{E}, r AS (SELECT target, project, change_id, name, unnest(conflicts) AS dependency FROM plan_changes)
SELECT * FROM r WHERE EXISTS (SELECT 1 FROM deployed p WHERE p.target = r.target AND p.project = r.project AND p.name = split_part(r.dependency, '@', 1))""")
def conflicts(s, d):
    return H.conflicts(plan_changes(s, d), deployed(s, d)).select(*K, "change_id", "name", "dependency")


@query("resolve_dependencies", f"""{P}, f AS (SELECT target, project, name, min_by(change_id, pos) AS dependency_id FROM plan_changes GROUP BY 1, 2, 3),
r AS (SELECT target, project, change_id, 'require' AS type, unnest(requires) AS dependency FROM plan_changes
      UNION ALL SELECT target, project, change_id, 'conflict', unnest(conflicts) FROM plan_changes)
SELECT r.*, f.dependency_id FROM r LEFT JOIN f ON f.target = r.target AND f.project = r.project AND f.name = split_part(r.dependency, '@', 1)""")
def resolve_dependencies(s, d):
    return H.resolve_dependencies(plan_changes(s, d)).select(*K, "change_id", "type", "dependency", "dependency_id")


def _script_rows(s, d):
    """Scripts that exist: deploy always, revert unless urgent, verify only for finished orders."""
    plan = plan_changes(s, d)
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus")
    kinds = F.array_compact(F.array(
        F.when(F.col("o_orderstatus") != "P", F.lit("deploy")),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.lit("revert")),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW"), F.lit("verify")),
    ))
    return plan.join(o, "o_orderkey").select(*K, "name", F.explode(kinds).alias("kind")).distinct()


@query("missing_scripts", f"""{P}, have AS (
  SELECT DISTINCT p.target, p.project, p.name, k.kind FROM plan_changes p JOIN orders o USING (o_orderkey), (VALUES ('deploy'), ('revert'), ('verify')) k(kind)
  WHERE (k.kind = 'deploy' AND o.o_orderstatus <> 'P') OR (k.kind = 'revert' AND o.o_orderpriority <> '1-URGENT')
     OR (k.kind = 'verify' AND o.o_orderstatus = 'F' AND o.o_orderpriority = '5-LOW'))
SELECT n.target, n.project, n.name, k.kind, CASE WHEN k.kind = 'verify' THEN 'warn' ELSE 'error' END AS severity
FROM (SELECT DISTINCT target, project, name FROM plan_changes) n, (VALUES ('deploy'), ('revert'), ('verify')) k(kind)
WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.target = n.target AND h.project = n.project AND h.name = n.name AND h.kind = k.kind)""")
def missing_scripts(s, d):
    return H.missing_scripts(plan_changes(s, d), _script_rows(s, d))


PAIR_SQL = """pairs AS (SELECT *, name || CASE WHEN o_orderpriority < '3' THEN '_expand' WHEN o_orderpriority < '5' THEN '_contract' ELSE '' END AS pair_name
  FROM plan_changes)"""


def _pairs(s, d):
    p = plan_changes(s, d)
    suffix = F.when(F.col("o_orderpriority") < "3", "_expand").when(F.col("o_orderpriority") < "5", "_contract").otherwise("")
    return p.withColumn("name", F.concat("name", suffix))


@query("phase_names", f"""{P}, {PAIR_SQL} SELECT change_id, pair_name AS name,
  CASE WHEN suffix(pair_name, '_expand') THEN 'expand' WHEN suffix(pair_name, '_contract') THEN 'contract' END AS phase,
  CASE WHEN suffix(pair_name, '_expand') OR suffix(pair_name, '_contract') THEN name END AS base FROM pairs""")
def phase_names(s, d):
    return _pairs(s, d).select("change_id", "name", phase_of(F.col("name")).alias("phase"), pair_base(F.col("name")).alias("base"))


@query("contract_ready", f"""{E}, {PAIR_SQL},
ops AS (SELECT target, project, name AS base, arg_max(['expanding', 'expanded', 'contracting', 'completed'][o_orderkey % 4 + 1], planned_at_key) AS phase
        FROM (SELECT *, (planned_at, o_orderkey) AS planned_at_key FROM pairs) WHERE o_orderkey % 2 = 0 GROUP BY 1, 2, 3),
fill AS (SELECT target, project, name AS base, bool_and(o_orderpriority <> '1-URGENT') AS is_complete FROM pairs GROUP BY 1, 2, 3),
gone AS (SELECT p.target, p.project, p.name AS base FROM pairs p JOIN deployed USING (target, project, change_id) WHERE suffix(p.pair_name, '_expand') GROUP BY 1, 2, 3),
rows AS (SELECT p.target, p.project, p.change_id, p.pair_name AS name, p.name AS base,
  CASE WHEN g.base IS NULL THEN 'expand not deployed' WHEN o.phase IN ('expanding', 'expanded') AND NOT f.is_complete THEN 'backfill not complete' END AS reason
  FROM pairs p LEFT JOIN gone g ON g.target = p.target AND g.project = p.project AND g.base = p.name
  LEFT JOIN ops o ON o.target = p.target AND o.project = p.project AND o.base = p.name
  LEFT JOIN fill f ON f.target = p.target AND f.project = p.project AND f.base = p.name
  WHERE suffix(p.pair_name, '_contract') AND {NOT_DEPLOYED})
SELECT target, project, change_id, name, base, reason IS NULL AS ready, reason FROM rows""")
def contract_ready(s, d):
    pairs = _pairs(s, d)
    base = pairs.withColumn("change_name", F.regexp_replace("name", "_(expand|contract)$", ""))
    done = deployed(s, d).select(*K, "change_id").join(pairs.select(*K, "change_id", "name"), [*K, "change_id"])
    phase = F.get(F.array(*[F.lit(x) for x in ("expanding", "expanded", "contracting", "completed")]), (F.col("o_orderkey") % 4).cast("int"))
    ops = base.where("o_orderkey % 2 = 0").select(*K, "change_name", phase.alias("phase"), F.struct("planned_at", "o_orderkey").alias("started_at"))
    fill = base.groupBy(*K, "change_name").agg(F.bool_and(F.col("o_orderpriority") != "1-URGENT").alias("is_complete"))
    return H.contract_ready(H.pending(pairs, done), done, ops, fill)


@query("reconcile", """WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders WHERE o_totalprice < 450000),
b AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority,
             o_orderdate + to_seconds(o_orderkey % 9) AS o_orderdate FROM orders WHERE o_totalprice > 50000),
j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN b.o_orderkey IS NULL THEN 'only_left' WHEN a.o_orderkey IS NULL THEN 'only_right' ELSE 'differs' END AS difference,
  CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE
    concat_ws(',', CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
                   CASE WHEN abs(epoch_us(a.o_orderdate) - epoch_us(b.o_orderdate)) > 5000000 THEN 'o_orderdate' END) END AS fields
  FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT * FROM j WHERE difference <> 'differs' OR fields <> ''""")
def reconcile(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]
    a = o.where("o_totalprice < 450000").select(*cols)
    b = o.where("o_totalprice > 50000").withColumns({
        "o_orderstatus": F.when(F.col("o_custkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")),
        "o_orderdate": F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_orderkey") % 9),
    }).select(*cols)
    out = H.reconcile(a, b, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"])
    return _text(out, "fields")


@query("change_tags", f"{P} SELECT target, project, change_id, string_agg('@' || tag, ',' ORDER BY pos, tag) AS tags FROM plan_tags GROUP BY 1, 2, 3")
def change_tags(s, d):
    return _text(H.change_tags(plan_tags(s, d)), "tags")


@query("plan_listing", f"""{P}, t AS (SELECT target, project, change_id, string_agg('@' || tag, ',' ORDER BY pos, tag) AS tags FROM plan_tags GROUP BY 1, 2, 3)
SELECT p.target, p.project, p.change_id, p.pos, p.name, array_to_string(p.requires, ',') AS requires, array_to_string(p.conflicts, ',') AS conflicts,
       coalesce(t.tags, '') AS tags FROM plan_changes p LEFT JOIN t USING (target, project, change_id)""")
def plan_listing(s, d):
    return _text(H.plan_listing(plan_changes(s, d), plan_tags(s, d)), "requires", "conflicts", "tags")


FILTER_SQL = """cut AS (SELECT target, project, min(pos) AS c FROM plan_tags WHERE tag = 'v1' GROUP BY 1, 2),
kept AS (SELECT p.* FROM plan_changes p JOIN cut USING (target, project) WHERE p.pos <= c)"""


@query("filter_plan", f"{P}, {FILTER_SQL} SELECT target, project, pos, change_id, name FROM kept")
def filter_plan(s, d):
    return H.filter_plan(plan_changes(s, d), plan_tags(s, d), tag="v1")[0].select(*K, "pos", "change_id", "name")


@query("filter_plan_tags", f"""{P}, {FILTER_SQL} SELECT target, project, tag, change_id FROM plan_tags t
WHERE EXISTS (SELECT 1 FROM kept k WHERE k.target = t.target AND k.project = t.project AND k.change_id = t.change_id AND k.name = 'chg_1')""")
def filter_plan_tags(s, d):
    return H.filter_plan(plan_changes(s, d), plan_tags(s, d), tag="v1", change="chg_1")[1].select(*K, "tag", "change_id")


@query("up_to_target", f"""{P}, c AS (SELECT target, project, min(pos) AS cut FROM plan_changes WHERE name = 'chg_5' GROUP BY 1, 2)
SELECT target, project, pos, change_id, name FROM plan_changes JOIN c USING (target, project) WHERE pos <= cut""")
def up_to_target(s, d):
    return H.up_to_target(plan_changes(s, d), "chg_5", strict=False).select(*K, "pos", "change_id", "name")


@query("find_change", f"{P} SELECT target, project, name, max(pos) AS pos, arg_max(change_id, pos) AS change_id FROM plan_changes GROUP BY 1, 2, 3")
def find_change(s, d):
    return H.find_change(plan_changes(s, d))


@query("find_tag", f"{P} SELECT target, project, tag, min(pos) AS pos, arg_min(change_id, pos) AS change_id FROM plan_tags GROUP BY 1, 2, 3")
def find_tag(s, d):
    return H.find_tag(plan_tags(s, d))


@query("record_tags", f"""{E} SELECT t.target, t.project, t.change_id, '@' || t.tag AS tag, d.name AS change
FROM plan_tags t JOIN deployed d USING (target, project, change_id)""")
def record_tags(s, d):
    return H.record_tags(plan_tags(s, d), deployed(s, d))


@query("events_query", f"""{E} SELECT event, target, change_id, epoch_us(committed_at) AS committed_us, event_id FROM change_events
WHERE project = 'p3' AND event = 'deploy' ORDER BY committed_at DESC, event_id DESC LIMIT 100 OFFSET 20""")
def events_query(s, d):
    out = H.events_query(change_events(s, d), "p3", event="deploy", limit=100, offset=20)
    return out.select("event", "target", "change_id", micros(F.col("committed_at")).alias("committed_us"), "event_id")


@query("events_pages", f"""{E} SELECT page + 1 AS page, event_id, epoch_us(committed_at) AS committed_us FROM (
  SELECT event_id, committed_at, (row_number() OVER (ORDER BY committed_at DESC, event_id DESC) - 1) // 40 AS page FROM change_events WHERE project = 'p3') WHERE page < 4""")
def events_pages(s, d):
    """Four pages of a log, each found behind the last row of the one before."""
    log, pages, after = change_events(s, d), [], None
    for n in range(1, 5):
        page = H.events_query(log, "p3", limit=40, after=after).withColumn("page", F.lit(n).cast("long"))
        after = H.page_end(page)
        pages.append(page)
        if after is None:
            break
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out.select("page", "event_id", micros(F.col("committed_at")).alias("committed_us"))


@query("current_state", f"{E} SELECT target, project, change_id, name, epoch_us(committed_at) AS committed_us FROM deployed")
def current_state(s, d):
    return deployed(s, d).select(*K, "change_id", "name", micros(F.col("committed_at")).alias("committed_us"))


@query("deployed_changes", f"""{E} SELECT target, project, change_id, name,
  row_number() OVER (PARTITION BY target, project ORDER BY committed_at, change_id) AS seq FROM deployed""")
def deployed_changes(s, d):
    return H.in_deploy_order(deployed(s, d)).select(*K, "change_id", "name", "seq")


@query("deployed_tags", f"""{E} SELECT t.target, t.project, t.tag, t.change_id,
  row_number() OVER (PARTITION BY t.target, t.project ORDER BY d.committed_at, t.tag) AS seq FROM plan_tags t JOIN deployed d USING (target, project, change_id)""")
def deployed_tags(s, d):
    return H.deployed_tags(plan_tags(s, d), deployed(s, d)).select(*K, "tag", "change_id", "seq")


@query("last_deployed", f"""{E} SELECT target, project, arg_max(change_id, (committed_at, change_id)) AS change_id,
  arg_max(name, (committed_at, change_id)) AS name, epoch_us(max(committed_at)) AS committed_us FROM deployed GROUP BY 1, 2""")
def last_deployed(s, d):
    out = H.last_deployed(deployed(s, d))
    return out.select(*K, "change_id", "name", micros(F.col("committed_at")).alias("committed_us"))


@query("verify_range", f"""{E}, b AS (SELECT target, project, min((committed_at, change_id)) FILTER (name = 'chg_1') AS lo,
  min((committed_at, change_id)) FILTER (name = 'chg_2') AS hi FROM deployed GROUP BY 1, 2)
SELECT d.target, d.project, d.change_id, d.name FROM deployed d JOIN b USING (target, project)
WHERE (d.committed_at, d.change_id) >= lo AND (d.committed_at, d.change_id) <= hi""")
def verify_range(s, d):
    return H.verify_range(deployed(s, d), "chg_1", "chg_2", strict=False).select(*K, "change_id", "name")


@query("revert_set", f"""{E}, b AS (SELECT target, project, min((committed_at, change_id)) FILTER (name = 'chg_1') AS lo FROM deployed GROUP BY 1, 2)
SELECT d.target, d.project, d.change_id, d.name, row_number() OVER (PARTITION BY d.target, d.project ORDER BY d.committed_at DESC, d.change_id DESC) AS seq
FROM deployed d JOIN b USING (target, project) WHERE (d.committed_at, d.change_id) > lo""")
def revert_set(s, d):
    return H.revert_set(deployed(s, d), "chg_1", strict=False).select(*K, "change_id", "name", "seq")


@query("chain_check", f"""{P}, c AS (SELECT *, CASE WHEN o_orderpriority = '2-HIGH' THEN 'c0' ELSE prev END AS parent FROM (
  SELECT *, lag(change_id) OVER (PARTITION BY target, project ORDER BY pos) AS prev FROM plan_changes))
SELECT target, project, pos, change_id, name, parent, prev AS expected_parent FROM c WHERE parent IS DISTINCT FROM prev""")
def chain_check(s, d):
    from changewright.operators import ordered

    plan = plan_changes(s, d)
    linked = ordered.unsliced(ordered.neighbour(ordered.slice_by_position(plan, "pos"), K, F.col("change_id"), "parent", -1))
    linked = linked.withColumn("parent", F.when(F.col("o_orderpriority") == "2-HIGH", "c0").otherwise(F.col("parent")))
    return H.chain_check(linked)


@query("rework_ready", f"""{P}, l AS (SELECT target, project, name, max(pos) AS last_pos FROM plan_changes GROUP BY 1, 2, 3)
SELECT target, project, name, last_pos, coalesce(last_pos <= (SELECT max(pos) FROM plan_tags t WHERE t.target = l.target AND t.project = l.project), false) AS ready FROM l""")
def rework_ready(s, d):
    return H.rework_ready(plan_changes(s, d), plan_tags(s, d))


EDGES_SQL = """firsts AS (SELECT target, project, name, min(pos) AS pos FROM plan_changes GROUP BY 1, 2, 3),
edges AS (SELECT DISTINCT r.target, r.project, f.pos AS src, r.pos AS dst FROM (
    SELECT target, project, pos, unnest(requires) AS dep FROM plan_changes) r
  JOIN firsts f ON f.target = r.target AND f.project = r.project AND f.name = split_part(r.dep, '@', 1))"""


@query("deploy_levels", f"""WITH RECURSIVE {PLAN_SQL}, {EDGES_SQL},
lv AS (SELECT target, project, pos, 0 AS level FROM plan_changes
       UNION SELECT e.target, e.project, e.dst, lv.level + 1 FROM lv JOIN edges e ON e.target = lv.target AND e.project = lv.project AND e.src = lv.pos)
SELECT target, project, pos, CAST(max(level) AS BIGINT) AS level FROM lv GROUP BY 1, 2, 3""")
def deploy_levels(s, d):
    return G.deploy_levels(plan_changes(s, d)).select(*K, "pos", "level")


def _one_plan(s, d, requires):
    """All orders as one plan, a change each, with requirements as names of other orders."""
    key = F.col("o_orderkey")
    named = F.transform(F.array_compact(requires(key)), lambda k: F.concat(F.lit("c"), k.cast("string")))
    return table(s, d, "orders").select(
        F.lit("db").alias("target"), (F.col("o_custkey") * 0).cast("string").alias("project"), key.alias("pos"), F.concat(F.lit("c"), key.cast("string")).alias("change_id"),
        F.concat(F.lit("c"), key.cast("string")).alias("name"), named.alias("requires"))


@query("deploy_levels_chain", """SELECT target, project, pos, row_number() OVER (PARTITION BY run ORDER BY pos) - 1 AS level FROM (
  SELECT 'db' AS target, '0' AS project, o_orderkey AS pos, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS run FROM orders)""")
def deploy_levels_chain(s, d):
    """One plan in which every change requires the one before it, worked on by pointer doubling."""
    return G.deploy_levels(_one_plan(s, d, lambda k: F.array(k - 1)), local=1000).select(*K, "pos", "level")


@query("deploy_order_ladder", """SELECT 'db' AS target, '0' AS project, o_orderkey AS pos, row_number() OVER (ORDER BY o_orderkey // 40, o_orderkey DESC) AS seq FROM orders""")
def deploy_order_ladder(s, d):
    """One plan of ladders: a change requires the two behind it, within forty."""
    def behind(k):
        return F.array(*[F.when(F.floor((k + i) / 40) == F.floor(k / 40), k + i) for i in (1, 2)])

    return G.deploy_order(_one_plan(s, d, behind)).select(*K, "pos", "seq")


@query("cycles_behind_chain", """SELECT 'db' AS target, '0' AS project, 'c' || o_orderkey AS name FROM orders
WHERE o_orderkey < 128 AND (SELECT count(*) FROM orders WHERE o_orderkey < 128) = 128""")
def cycles_behind_chain(s, d):
    """One plan in which every change requires the one before it and the first one the 128th: a ring and a long chain."""
    return G.cycles(_one_plan(s, d, lambda k: F.array(F.when(k == 0, F.lit(127).cast("long")).otherwise(k - 1))), local=1000)


ORDER_SQL = f"""{EDGES_SQL},
anc AS (SELECT target, project, src AS a, dst AS v FROM edges
        UNION SELECT e.target, e.project, e.src, anc.v FROM anc JOIN edges e ON e.target = anc.target AND e.project = anc.project AND e.dst = anc.a),
top AS (SELECT target, project, v AS pos, max(a) AS m FROM anc GROUP BY 1, 2, 3),
m1 AS (SELECT p.target, p.project, p.pos, p.change_id, p.name, greatest(p.pos, coalesce(t.m, 0)) AS k1
       FROM plan_changes p LEFT JOIN top t USING (target, project, pos)),
in1 AS (SELECT anc.* FROM anc JOIN m1 x ON x.target = anc.target AND x.project = anc.project AND x.pos = anc.a
        JOIN m1 y ON y.target = anc.target AND y.project = anc.project AND y.pos = anc.v WHERE x.k1 = y.k1 AND x.pos < x.k1),
m2 AS (SELECT m1.*, CASE WHEN pos = k1 THEN 0 ELSE greatest(pos, coalesce((SELECT max(i.a) FROM in1 i
        WHERE i.target = m1.target AND i.project = m1.project AND i.v = m1.pos), 0)) END AS k2 FROM m1),
in2 AS (SELECT in1.* FROM in1 JOIN m2 x ON x.target = in1.target AND x.project = in1.project AND x.pos = in1.a
        JOIN m2 y ON y.target = in1.target AND y.project = in1.project AND y.pos = in1.v WHERE x.k2 = y.k2 AND x.pos < x.k2),
m3 AS (SELECT m2.*, CASE WHEN pos = k2 OR k2 = 0 THEN 0 ELSE greatest(pos, coalesce((SELECT max(i.a) FROM in2 i
        WHERE i.target = m2.target AND i.project = m2.project AND i.v = m2.pos), 0)) END AS k3 FROM m2),
deploy_order AS (SELECT target, project, pos, change_id, name, row_number() OVER (PARTITION BY target, project ORDER BY k1, k2, k3, pos) AS seq FROM m3)"""


@query("deploy_order", f"WITH RECURSIVE {PLAN_SQL}, {ORDER_SQL} SELECT target, project, pos, change_id, seq FROM deploy_order")
def deploy_order(s, d):
    return G.deploy_order(plan_changes(s, d)).select(*K, "pos", "change_id", "seq")


@query("deploy_preview", f"""WITH RECURSIVE {PLAN_SQL}, {ORDER_SQL}
SELECT target, project, seq, change_id, name, o_orderpriority = '1-URGENT' AS no_transaction
FROM deploy_order JOIN plan_changes USING (target, project, change_id, name)""")
def deploy_preview(s, d):
    plan = plan_changes(s, d)
    head = F.when(F.col("o_orderpriority") == "1-URGENT", "-- tool:no-transaction\n").otherwise("-- tool:note\n-- tool:no-transaction\n")
    texts = plan.select(*K, "change_id", F.concat(head, F.lit("SELECT 1;")).alias("sql"))
    return G.deploy_preview(plan, texts)


LOOP_SQL = PLAN_SQL.replace("AS requires", """|| CASE WHEN (o_orderkey // 200) % 10 = 0 THEN ['chg_' || (o_orderkey // 200 + 3)]
              WHEN (o_orderkey // 200) % 10 = 3 THEN ['chg_' || (o_orderkey // 200 - 3)] ELSE CAST([] AS VARCHAR[]) END AS requires""")


@query("cycles", f"""WITH RECURSIVE {LOOP_SQL}, {EDGES_SQL},
own AS (SELECT e.* FROM edges e JOIN firsts f ON f.target = e.target AND f.project = e.project AND f.pos = e.dst),
reach AS (SELECT * FROM own UNION SELECT r.target, r.project, r.src, o.dst FROM reach r JOIN own o ON o.target = r.target AND o.project = r.project AND o.src = r.dst)
SELECT f.target, f.project, f.name FROM firsts f JOIN reach r ON r.target = f.target AND r.project = f.project AND r.src = f.pos AND r.dst = f.pos""")
def cycles(s, d):
    plan = plan_changes(s, d)
    slot = F.floor(F.col("o_orderkey") / 200)

    def chg(n):
        return F.array(F.concat(F.lit("chg_"), n.cast("string")))

    back = F.when(slot % 10 == 0, chg(slot + 3)).when(slot % 10 == 3, chg(slot - 3)).otherwise(F.array().cast("array<string>"))
    return G.cycles(plan.withColumn("requires", F.concat("requires", back)))


@query("parse_deps", f"""{P}, t AS (SELECT change_id, list_concat(requires, ['other:' || name, name || '@v1']) AS r,
  list_concat(conflicts, ['old_' || name]) AS c FROM plan_changes)
SELECT change_id, array_to_string(r, ',') AS requires, array_to_string(c, ',') AS conflicts FROM t""")
def parse_deps_query(s, d):
    p = plan_changes(s, d)
    marks = F.transform(F.concat("conflicts", F.array(F.concat(F.lit("old_"), "name"))), lambda c: F.concat(F.lit("!"), c))
    names = F.concat("requires", F.array(F.concat(F.lit("other:"), "name"), F.concat("name", F.lit("@v1"))))
    text = F.concat(F.lit("[ "), F.array_join(F.concat(marks, names), "  "), F.lit("]"))
    return _text(p.select("change_id", parse_deps(text).alias("d")).select("change_id", "d.*"), "requires", "conflicts")


@query("base_name", f"""{P} SELECT change_id, dep, split_part(dep, '@', 1) AS base FROM (
  SELECT change_id, unnest([name || '@v' || pos, name, 'other:' || name || '@beta@x']) AS dep FROM plan_changes)""")
def base_name_query(s, d):
    p = plan_changes(s, d)
    deps = F.array(F.concat("name", F.lit("@v"), F.col("pos").cast("string")), F.col("name"), F.concat(F.lit("other:"), "name", F.lit("@beta@x")))
    return p.select("change_id", F.explode(deps).alias("dep")).withColumn("base", base_name(F.col("dep")))


@query("scripts_in_plan", f"""{E} SELECT change_id, name FROM (
  SELECT change_id, name || CASE WHEN o_orderpriority = '5-LOW' THEN '_draft' ELSE '' END AS name FROM plan_changes)
WHERE name IN (SELECT name FROM change_events WHERE event = 'fail')""")
def scripts_in_plan(s, d):
    draft = F.when(F.col("o_orderpriority") == "5-LOW", "_draft").otherwise("")
    scripts = plan_changes(s, d).select("change_id", F.concat("name", draft).alias("name"))
    return C.scripts_in_plan(scripts, change_events(s, d).where("event = 'fail'"))


@query("changed_scripts", f"""{P} SELECT change_id AS path, CASE WHEN o_orderpriority = '2-HIGH' THEN sha1(script_hash) ELSE script_hash END AS script_hash
FROM plan_changes p WHERE o_orderpriority = '2-HIGH' OR NOT EXISTS (SELECT 1 FROM change_events_ids c WHERE c.change_id = p.change_id)""".replace(
    "SELECT change_id AS path", ", change_events_ids AS (SELECT DISTINCT 'c' || (event_id // 4) AS change_id FROM events) SELECT change_id AS path", 1))
def changed_scripts(s, d):
    plan = plan_changes(s, d)
    now = F.when(F.col("o_orderpriority") == "2-HIGH", F.sha1(F.col("script_hash").cast("binary"))).otherwise(F.col("script_hash"))
    scripts = plan.select(F.col("change_id").alias("path"), now.alias("script_hash"))
    manifest = change_events(s, d).select(F.col("change_id").alias("path"), "script_hash").distinct()
    return C.changed_scripts(scripts, manifest)


@query("read_scripts", """SELECT 's' || l_suppkey AS name, 'revert' AS kind, text AS sql, sha1(text) AS script_hash
FROM (SELECT l_suppkey, string_agg('-- ' || day || chr(10), '' ORDER BY day) AS text FROM (SELECT DISTINCT l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day FROM lineitem) GROUP BY 1)""")
def read_scripts(s, d):
    """Scripts on disk, one per supplier with a line per ship date, read as text and as raw bytes."""
    folder = f"{checkpoint_dir(s)}/{uuid.uuid4().hex}"
    days = table(s, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day")).repartition("l_suppkey").distinct()
    name, line = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("-- "), F.col("day").cast("string"))
    C.write_scripts(days.select("l_suppkey", name.alias("name"), line.alias("line")), folder, by="l_suppkey")
    texts, hashes = C.read_scripts(s, folder, "revert"), C.read_script_hashes(s, folder)
    return texts.join(hashes.select("name", "script_hash"), "name").select("name", "kind", "sql", "script_hash")


@query("upsert_projects", f"""{E}, old AS (SELECT target, project, min(name) AS uri FROM change_events WHERE event = 'revert' AND event_id % 2 = 0 GROUP BY 1, 2),
new AS (SELECT target, project, 'new' AS uri FROM plan_changes GROUP BY 1, 2)
SELECT * FROM old UNION ALL SELECT * FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.target = n.target AND o.project = n.project)""")
def upsert_projects(s, d):
    old = change_events(s, d).where("event = 'revert' and event_id % 2 = 0").groupBy(*K).agg(F.min("name").alias("uri"))
    new = plan_changes(s, d).select(*K).distinct().withColumn("uri", F.lit("new"))
    return S.upsert_projects(old, new)


APPLIED_SQL = f"""{E}, first AS (SELECT * FROM change_events WHERE event = 'deploy' QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY event_id) = 1),
last AS (SELECT * FROM change_events WHERE event IN ('deploy', 'revert') QUALIFY row_number() OVER (PARTITION BY change_id ORDER BY event_id DESC) = 1),
alive AS (SELECT change_id FROM first WHERE change_id NOT IN (SELECT change_id FROM last WHERE event = 'revert')
          UNION SELECT change_id FROM last WHERE event = 'deploy'),
x AS (SELECT change_id FROM alive)
SELECT 'changes' AS part, change_id, 1 AS n FROM x
UNION ALL SELECT 'dependencies', p.change_id, count(*) FROM x JOIN (SELECT change_id, unnest(requires) FROM plan_changes) p USING (change_id) GROUP BY 2
UNION ALL SELECT 'tags', t.change_id, count(*) FROM plan_tags t JOIN first USING (change_id) WHERE change_id NOT IN (SELECT change_id FROM last WHERE event = 'revert') GROUP BY 2
UNION ALL SELECT 'events', change_id, count(*) FROM (SELECT change_id FROM first UNION ALL SELECT change_id FROM last) GROUP BY 2"""


def _first_and_last(s, d):
    """First deploys, the last deploy or revert of each change, and the dependencies of all changes."""
    rows = [c for c in change_events(s, d).columns if c != "change_id"]
    log, plan = change_events(s, d), plan_changes(s, d)
    pick = F.struct(*rows)
    first = log.where("event = 'deploy'").groupBy("change_id").agg(F.min_by(pick, "event_id").alias("e")).select("change_id", "e.*")
    last = log.where("event in ('deploy', 'revert')").groupBy("change_id").agg(F.max_by(pick, "event_id").alias("e")).select("change_id", "e.*")
    deps = plan.select(*K, "change_id", F.lit("require").alias("type"), F.explode("requires").alias("dependency"), F.lit(None).cast("string").alias("dependency_id"))
    return first, last, deps


def _counted(tables):
    parts = [tables[t].select(F.lit(t).alias("part"), "change_id") for t in ("changes", "dependencies", "tags", "events")]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.groupBy("part", "change_id").agg(F.count(F.lit(1)).alias("n"))


@query("apply_history", APPLIED_SQL)
def apply_history(s, d):
    """First deploys as the state, the last deploy or revert of each change as the batch."""
    first, last, deps = _first_and_last(s, d)
    on = [*K, "change_id"]
    state = {
        "events": first, "changes": first, "dependencies": deps.join(first, on, "left_semi"),
        "tags": plan_tags(s, d).join(first, on, "left_semi"),
    }
    return _counted(S.apply_history(state, last, deps))


@query("commit_history", APPLIED_SQL)
def commit_history(s, d):
    """The same as two commits to a store on disk, read back."""
    folder = f"{checkpoint_dir(s)}/{uuid.uuid4().hex}"
    first, last, deps = _first_and_last(s, d)
    S.commit_history(s, folder, first, deps, plan_tags(s, d))
    S.commit_history(s, folder, last, deps)
    return _counted({t: S.stored_history(s, folder, t) for t in ("changes", "dependencies", "tags", "events")})


@query("stored_changes", f"""{E} SELECT DISTINCT target, project, change_id, name, epoch_us(planned_at) AS planned_us FROM change_events WHERE event = 'deploy'""")
def stored_changes(s, d):
    """A history table written to files and read back."""
    folder = f"{checkpoint_dir(s)}/{uuid.uuid4().hex}"
    S.write_history(change_events(s, d).where("event = 'deploy'").dropDuplicates([*K, "change_id"]).drop("committed_at"), "changes", folder)
    return S.read_history(s, "changes", folder).select(*K, "change_id", "name", micros(F.col("planned_at")).alias("planned_us"))
