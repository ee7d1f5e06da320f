"""Queries over column changes: ``customer.c_acctbal`` becomes a decimal."""

from __future__ import annotations

from pyspark.sql import functions as F

from changewright.catalog.registry import query
from changewright.fixtures import micros, table
from changewright.operators import columns as X

CHANGE = X.ColumnChange("c_acctbal", "balance", "double", "decimal(15,2)")
TEXT = X.ColumnChange(
    "c_mktsegment", "segment", "string", "string", forward="lower(c_mktsegment)", reverse="upper(segment)", new_default="'none'", old_default="'NONE'"
)
FWD = "CAST(c_acctbal AS DECIMAL(15, 2))"


def _customer(s, d):
    return table(s, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")


@query("expand", f"SELECT c_custkey, c_acctbal, {FWD} AS balance FROM customer")
def expand(s, d):
    return X.expand(_customer(s, d).drop("c_mktsegment"), CHANGE)


@query("sync_expressions", """SELECT c_custkey, coalesce(lower(m), 'none') AS fwd, coalesce(upper(g), 'NONE') AS rev
FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS m, CASE WHEN c_acctbal > 0 THEN 'seg' || c_nationkey END AS g FROM customer)""")
def sync_expressions(s, d):
    c = table(s, d, "customer").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("seg"), F.col("c_nationkey").cast("string"))).alias("segment"),
    )
    return c.select("c_custkey", X.fwd_expr(TEXT).alias("fwd"), X.rev_expr(TEXT).alias("rev"))


def _inserted(s, d):
    """New rows: old only, new only, both or neither, by nation."""
    c = table(s, d, "customer")
    kind = F.col("c_nationkey") % 4
    return c.select(
        "c_custkey",
        F.when(kind.isin(0, 2), F.col("c_acctbal")).alias("c_acctbal"),
        F.when(kind.isin(1, 2), F.col("c_custkey")).cast("decimal(15,2)").alias("balance"),
    )


@query("sync_insert", f"""WITH i AS (SELECT c_custkey, CASE WHEN c_nationkey % 4 IN (0, 2) THEN c_acctbal END AS c_acctbal,
  CAST(CASE WHEN c_nationkey % 4 IN (1, 2) THEN c_custkey END AS DECIMAL(15, 2)) AS balance FROM customer)
SELECT c_custkey, coalesce(c_acctbal, CAST(balance AS DOUBLE)) AS c_acctbal, coalesce(balance, {FWD}) AS balance FROM i""")
def sync_insert(s, d):
    return X.sync_insert(_inserted(s, d), CHANGE)


IMAGES = f"""before AS (SELECT c_custkey, c_acctbal, {FWD} AS balance FROM customer),
after AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_nationkey % 3 = 1 OR c_nationkey % 6 = 0 THEN CAST({FWD} - 7 AS DECIMAL(15, 2)) ELSE {FWD} END AS balance FROM customer)"""


def _images(s, d):
    before = X.expand(table(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), CHANGE)
    old = F.when(F.col("c_nationkey") % 3 == 0, F.col("c_acctbal") + 100).otherwise(F.col("c_acctbal"))
    moved = (F.col("c_nationkey") % 3 == 1) | (F.col("c_nationkey") % 6 == 0)
    new = F.when(moved, (F.col("balance") - 7).cast("decimal(15,2)")).otherwise(F.col("balance"))
    after = before.withColumns({"c_acctbal": old, "balance": new})
    return before.drop("c_nationkey"), after.drop("c_nationkey")


SYNCED = f"""synced AS (SELECT a.c_custkey,
  CASE WHEN a.c_acctbal IS DISTINCT FROM b.c_acctbal THEN a.c_acctbal WHEN a.balance IS DISTINCT FROM b.balance THEN CAST(a.balance AS DOUBLE) ELSE a.c_acctbal END AS c_acctbal,
  CASE WHEN a.c_acctbal IS DISTINCT FROM b.c_acctbal THEN CAST(a.c_acctbal AS DECIMAL(15, 2)) ELSE a.balance END AS balance
  FROM after a JOIN before b USING (c_custkey))"""


@query("sync_update", f"WITH {IMAGES}, {SYNCED} SELECT * FROM synced")
def sync_update(s, d):
    before, after = _images(s, d)
    return X.sync_update(before, after, ["c_custkey"], CHANGE)


def change_rows(s, d):
    """Two images per touched customer, then deletes, of which every other comes back, and inserts under negative keys."""
    _, after = _images(s, d)
    nation = table(s, d, "customer").select("c_custkey", "c_nationkey")
    rows = after.join(nation, "c_custkey")
    last = rows.select("c_custkey", "c_acctbal", "balance", F.when(F.col("c_nationkey") == 5, "delete").otherwise("update").alias("op"), F.lit(2).alias("seq"))
    first = rows.select("c_custkey", (F.col("c_acctbal") * 0).alias("c_acctbal"), "balance", F.lit("update").alias("op"), F.lit(1).alias("seq"))
    back = rows.where("c_nationkey = 5 and c_custkey % 2 = 0").select("c_custkey", "c_acctbal", F.lit(None).cast("decimal(15,2)").alias("balance"), F.lit("insert").alias("op"), F.lit(3).alias("seq"))
    fresh = _inserted(s, d).select((-F.col("c_custkey") - 1).alias("c_custkey"), "c_acctbal", "balance", F.lit("insert").alias("op"), F.lit(1).alias("seq"))
    return last.unionByName(first).unionByName(back).unionByName(fresh)


def _step(name: str, source: str, old: str, new: str, was_old: str, was_new: str) -> str:
    """One image against the row before it."""
    return f"""{name} AS (SELECT c_custkey, CASE WHEN {old} IS DISTINCT FROM {was_old} THEN {old} WHEN {new} IS DISTINCT FROM {was_new} THEN CAST({new} AS DOUBLE) ELSE {old} END AS o,
  CASE WHEN {old} IS DISTINCT FROM {was_old} THEN CAST({old} AS DECIMAL(15, 2)) ELSE {new} END AS n FROM {source})"""


#: Row by row, whatever the batches.
APPLIED = f"""WITH {IMAGES}, i AS (SELECT -c_custkey - 1 AS c_custkey, CASE WHEN c_nationkey % 4 IN (0, 2) THEN c_acctbal END AS c_acctbal,
  CAST(CASE WHEN c_nationkey % 4 IN (1, 2) THEN c_custkey END AS DECIMAL(15, 2)) AS balance FROM customer),
{_step("s1", "after a JOIN before b USING (c_custkey)", "a.c_acctbal * 0", "a.balance", "b.c_acctbal", "b.balance")},
{_step("s2", "after a JOIN s1 USING (c_custkey)", "a.c_acctbal", "a.balance", "s1.o", "s1.n")}
SELECT c_custkey, CASE WHEN c_nationkey = 5 THEN a.c_acctbal ELSE o END AS c_acctbal, CASE WHEN c_nationkey = 5 THEN CAST(a.c_acctbal AS DECIMAL(15, 2)) ELSE n END AS balance
FROM s2 JOIN after a USING (c_custkey) JOIN (SELECT c_custkey, c_nationkey FROM customer) USING (c_custkey) WHERE c_nationkey <> 5 OR c_custkey % 2 = 0
UNION ALL SELECT c_custkey, coalesce(c_acctbal, CAST(balance AS DOUBLE)), coalesce(balance, {FWD}) FROM i"""


@query("apply_changes", APPLIED)
def apply_changes(s, d):
    before, _ = _images(s, d)
    return X.apply_changes(before, change_rows(s, d), ["c_custkey"], CHANGE, ["seq"])


@query("backfill_status", """SELECT count(*) AS total_rows, count(nullif(l_tax, 0)) AS backfilled_rows, count(*) = count(nullif(l_tax, 0)) AS is_complete
FROM lineitem WHERE l_returnflag = 'R'""")
def backfill_status(s, d):
    rows = table(s, d, "lineitem").withColumn("new_tax", F.nullif("l_tax", F.lit(0.0)))
    return X.backfill_status(rows, "new_tax", F.col("l_returnflag") == "R")


@query("unsynced", "SELECT c_custkey FROM customer WHERE c_acctbal <= 0 AND c_acctbal IS NOT NULL")
def unsynced(s, d):
    part = _customer(s, d).withColumn("balance", F.when(F.col("c_acctbal") > 0, X.fwd_expr(CHANGE)))
    return X.unsynced(part, CHANGE).select("c_custkey")


@query("contract", f"SELECT c_custkey, {FWD} AS balance FROM customer")
def contract(s, d):
    return X.contract(X.expand(_customer(s, d).drop("c_mktsegment"), CHANGE), CHANGE)


@query("contract_revert", f"SELECT c_custkey, balance, CAST(balance AS DOUBLE) AS c_acctbal FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN {FWD} END AS balance FROM customer)")
def contract_revert(s, d):
    new_only = _customer(s, d).select("c_custkey", F.when(F.col("c_acctbal") > 0, X.fwd_expr(CHANGE)).alias("balance"))
    return X.contract_revert(new_only, CHANGE)


@query("expand_revert", "SELECT c_custkey, c_acctbal FROM customer")
def expand_revert(s, d):
    return X.expand_revert(X.expand(_customer(s, d).drop("c_mktsegment"), CHANGE), CHANGE)


def _phase(n):
    return F.get(F.array(*[F.lit(x) for x in ("expanding", "expanded", "contracting", "completed")]), n.cast("int"))


@query("phase_transitions", """WITH steps AS (SELECT l_orderkey AS operation_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS step_no,
  ['expanding', 'expanded', 'contracting', 'completed'][1 + CASE WHEN l_returnflag = 'R' THEN l_linenumber % 4 ELSE least(l_linenumber - 1, 3) END] AS phase FROM lineitem),
j AS (SELECT s.*, p.phase AS from_phase, o.o_orderstatus = 'F' AS done FROM steps s LEFT JOIN steps p ON p.operation_id = s.operation_id AND p.step_no = s.step_no - 1
      LEFT JOIN orders o ON o.o_orderkey = s.operation_id),
r AS (SELECT *, CASE WHEN NOT coalesce((from_phase IS NULL AND phase = 'expanding') OR (from_phase = 'expanding' AND phase = 'expanded')
  OR (from_phase = 'expanded' AND phase = 'contracting') OR (from_phase = 'contracting' AND phase = 'completed'), false) THEN 'illegal step'
  WHEN phase = 'contracting' AND NOT coalesce(done, false) THEN 'backfill not complete' END AS problem FROM j)
SELECT operation_id, step_no, from_phase, phase, problem IS NULL AS legal, problem FROM r""")
def phase_transitions(s, d):
    from changewright.operators.ordered import number_by

    l = table(s, d, "lineitem").withColumn("operation_id", F.col("l_orderkey"))
    l = l.select("operation_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    steps = number_by(l, ["operation_id"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], "step_no")
    at = F.when(F.col("l_returnflag") == "R", F.col("l_linenumber") % 4).otherwise(F.least(F.col("l_linenumber") - 1, F.lit(3)))
    log = steps.select("operation_id", "step_no", _phase(at).alias("phase"))
    done = table(s, d, "orders").select(F.col("o_orderkey").alias("operation_id"), (F.col("o_orderstatus") == "F").alias("is_complete"))
    return X.phase_transitions(log, done)


STATE_SQL = """state AS (SELECT o_orderkey AS id, 'p' || (o_custkey % 11) AS project, 'op_' || o_custkey AS change_name,
  ['expanding', 'expanded', 'contracting', 'completed'][o_orderkey % 4 + 1] AS phase, o_orderdate AS started_at FROM orders)"""


def _state(s, d):
    o = table(s, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), (F.col("o_custkey") % 11).cast("string")).alias("project"),
        F.concat(F.lit("op_"), F.col("o_custkey").cast("string")).alias("change_name"), _phase(F.col("o_orderkey") % 4).alias("phase"),
        F.col("o_orderdate").alias("started_at"),
    )


@query("list_operations", f"WITH {STATE_SQL} SELECT id, change_name, phase, epoch_us(started_at) AS started_us FROM state WHERE project = 'p3' AND phase <> 'completed'")
def list_operations(s, d):
    out = X.list_operations(_state(s, d), project="p3", active=True)
    return out.select("id", "change_name", "phase", micros(F.col("started_at")).alias("started_us"))


@query("deletable", f"WITH {STATE_SQL} SELECT id, phase, phase IN ('expanding', 'completed') AS deletable FROM state")
def deletable(s, d):
    return X.deletable(_state(s, d)).select("id", "phase", "deletable")


@query("duplicate_active", f"WITH {STATE_SQL} SELECT project, change_name, count(*) AS operations FROM state WHERE phase <> 'completed' GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_active(s, d):
    return X.duplicate_active(_state(s, d))
