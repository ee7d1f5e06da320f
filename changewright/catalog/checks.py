"""Queries over data prechecks, straight on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from changewright.catalog.registry import query
from changewright.fixtures import table
from changewright.operators import checks as D


def _lines(s, d):
    """lineitem with a tax that is null where it is zero."""
    return table(s, d, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))


@query("not_null_check", """SELECT 'l_tax' AS column, count(*) FILTER (nullif(l_tax, 0) IS NULL) AS nulls, count(*) FILTER (nullif(l_tax, 0) IS NULL) = 0 AS passes FROM lineitem
UNION ALL SELECT 'l_shipdate', count(*) FILTER (l_shipdate IS NULL), count(*) FILTER (l_shipdate IS NULL) = 0 FROM lineitem""")
def not_null_check(s, d):
    return D.not_null_check(_lines(s, d), ["l_tax", "l_shipdate"])


@query("add_column", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state, CAST(NULL AS INTEGER) AS review FROM orders""")
def add_column(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    state = F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open")
    return D.add_column(D.add_column(o, "state", "string", state, nullable=False), "review", "int").drop("o_orderstatus")


@query("add_column_volatile", "SELECT count(*) AS rows, true AS in_range, true AS spread FROM orders")
def add_column_volatile(s, d):
    drawn = D.add_column(table(s, d, "orders"), "token", "double", seed_keys=["o_orderkey"])
    return drawn.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bool_and((F.col("token") >= 0) & (F.col("token") < 1)).alias("in_range"),
        ((F.min("token") < 0.01) & (F.max("token") > 0.99)).alias("spread"),
    )


@query("cast_check", """SELECT o_orderkey, code, CASE WHEN TRY_CAST(code AS INTEGER) IS NULL THEN 'fails' ELSE 'lossy' END AS problem
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority WHEN o_orderstatus = 'O' THEN '0' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS code FROM orders)
WHERE TRY_CAST(code AS INTEGER) IS NULL OR CAST(TRY_CAST(code AS INTEGER) AS VARCHAR) <> code""")
def cast_check(s, d):
    key = F.col("o_custkey").cast("string")
    code = F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).when(F.col("o_orderstatus") == "O", F.concat(F.lit("0"), key)).otherwise(key)
    return D.cast_check(table(s, d, "orders").select("o_orderkey", code.alias("code")), "code", "int")


@query("drop_impact", """SELECT 'l_returnflag' AS column, count(*) AS rows, count(l_returnflag) AS non_null, count(DISTINCT l_returnflag) AS distinct_values FROM lineitem
UNION ALL SELECT 'l_suppkey', count(*), count(l_suppkey), count(DISTINCT l_suppkey) FROM lineitem
UNION ALL SELECT 'l_tax', count(*), count(nullif(l_tax, 0)), count(DISTINCT nullif(l_tax, 0)) FROM lineitem""")
def drop_impact(s, d):
    return D.drop_impact(_lines(s, d), ["l_returnflag", "l_suppkey", "l_tax"])


@query("truncate_impact", """SELECT 'orders' AS table_name, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'customer', count(*) FROM customer""")
def truncate_impact(s, d):
    return D.truncate_impact({t: table(s, d, t) for t in ("orders", "lineitem", "customer")})


@query("fk_orphans", """SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (
  SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus <> 'P')""")
def fk_orphans(s, d):
    parent = table(s, d, "orders").where("o_orderstatus <> 'P'")
    return D.fk_orphans(table(s, d, "lineitem"), parent, {"l_orderkey": "o_orderkey"}).select("l_orderkey", "l_linenumber")


@query("fk_orphans_composite", """SELECT l.l_orderkey, l.l_linenumber FROM lineitem l WHERE nullif(l.l_tax, 0) IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_returnflag = 'R' AND p.l_partkey = l.l_partkey AND p.l_tax = l.l_tax)""")
def fk_orphans_composite(s, d):
    parent = table(s, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_tax")
    out = D.fk_orphans(_lines(s, d), parent, {"l_partkey": "l_partkey", "l_tax": "l_tax"})
    return out.select("l_orderkey", "l_linenumber")


@query("dml_impact", """SELECT count(*) AS total_rows, count(*) FILTER (l_quantity < 24 AND l_returnflag = 'A') AS rows_hit,
  CAST(CAST(count(*) FILTER (l_quantity < 24 AND l_returnflag = 'A') AS DOUBLE) / count(*) AS DECIMAL(9, 6)) AS fraction,
  count(*) FILTER (l_quantity < 24 AND l_returnflag = 'A') > 10000 AS large FROM lineitem""")
def dml_impact(s, d):
    return D.dml_impact(table(s, d, "lineitem"), (F.col("l_quantity") < 24) & (F.col("l_returnflag") == "A"))


@query("sequence_check", "SELECT max(o_orderkey) AS max_value, count(*) FILTER (o_orderkey >= 1000) AS rows_at_or_above FROM orders")
def sequence_check(s, d):
    return D.sequence_check(table(s, d, "orders"), "o_orderkey", 1000)


@query("rename_view", "SELECT c_custkey, c_name, c_name AS customer_name FROM customer")
def rename_view(s, d):
    return D.rename_view(table(s, d, "customer").select("c_custkey", "c_name"), {"c_name": "customer_name"})


@query("check_violations", "SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END AS c_acctbal FROM customer) WHERE NOT (c_acctbal >= 0)")
def check_violations(s, d):
    balance = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal"))
    return D.check_violations(table(s, d, "customer").select("c_custkey", balance.alias("c_acctbal")), F.col("c_acctbal") >= 0)


@query("pk_check", "SELECT l_orderkey, l_linenumber, count(*) AS rows, false AS has_null FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def pk_check(s, d):
    return D.pk_check(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("pk_check_nulls", """SELECT l_linenumber, t AS l_tax, count(*) AS rows, t IS NULL AS has_null FROM (SELECT l_linenumber, nullif(l_tax, 0) AS t FROM lineitem)
GROUP BY 1, 2 HAVING count(*) > 1 OR t IS NULL""")
def pk_check_nulls(s, d):
    return D.pk_check(_lines(s, d), ["l_linenumber", "l_tax"])


def _suite():
    return [
        D.Check("tax present", F.col("l_tax").isNull()),
        D.Check("quantity positive", F.col("l_quantity") <= 0),
        D.Check("discount below 5 %", F.col("l_discount") >= 0.05),
        D.Check("no script"),
    ]


@query("run_checks", """SELECT 'tax present' AS name, count(*) FILTER (nullif(l_tax, 0) IS NULL) = 0 AS pass, false AS skipped, count(*) FILTER (nullif(l_tax, 0) IS NULL) AS bad_rows FROM lineitem
UNION ALL SELECT 'quantity positive', count(*) FILTER (l_quantity <= 0) = 0, false, count(*) FILTER (l_quantity <= 0) FROM lineitem
UNION ALL SELECT 'discount below 5 %', count(*) FILTER (l_discount >= 0.05) = 0, false, count(*) FILTER (l_discount >= 0.05) FROM lineitem
UNION ALL SELECT 'no script', true, true, 0""")
def run_checks(s, d):
    return D.run_checks(_lines(s, d), _suite())


@query("verify_summary", """SELECT 4 AS total, (SELECT CAST(count(*) FILTER (l_quantity <= 0) = 0 AS BIGINT) FROM lineitem) AS passed,
  (SELECT 3 - CAST(count(*) FILTER (l_quantity <= 0) = 0 AS BIGINT) FROM lineitem) AS failed, 1 AS skipped""")
def verify_summary(s, d):
    return D.verify_summary(D.run_checks(_lines(s, d), _suite()))
