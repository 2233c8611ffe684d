"""Merge queries: new state of a table after a change."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillflow.operators import merge as ops
from quillflow.plans.registry import query
from quillflow.sources.tables import table


def _parts(spark, sf_dir):
    old = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").alias("size"), (F.col("p_size") > 2).alias("active"))
    new = table(spark, sf_dir, "part").where("p_partkey % 3 = 0 and p_size < 40").select("p_brand", (F.col("p_partkey") + 500).alias("p_partkey"), (F.col("p_size") * 10).alias("size"))
    return old, new


@query("""
WITH o AS (SELECT p_brand, p_partkey, p_size AS size, p_size > 2 AS active FROM part),
n AS (SELECT p_brand, p_partkey + 500 AS p_partkey, p_size * 10 AS size FROM part WHERE p_partkey % 3 = 0 AND p_size < 40)
SELECT coalesce(o.p_brand, n.p_brand) AS p_brand, coalesce(o.p_partkey, n.p_partkey) AS p_partkey, coalesce(n.size, o.size) AS size,
  CASE WHEN n.p_partkey IS NOT NULL THEN true WHEN o.p_brand IN (SELECT p_brand FROM n) THEN false ELSE o.active END AS active
FROM o FULL JOIN n ON o.p_brand = n.p_brand AND o.p_partkey = n.p_partkey
""")
def merge_soft_delete(spark, sf_dir):
    """Upsert; rows missing from the source become inactive within its groups."""
    old, new = _parts(spark, sf_dir)
    return ops.upsert_soft_delete(old, new, ["p_brand", "p_partkey"], ["size"], "p_brand")


@query("""
WITH n AS (SELECT p_partkey + 500 AS k, CASE WHEN p_size < 20 THEN '' ELSE p_type END AS spec FROM part WHERE p_partkey % 3 = 0)
SELECT p_partkey, CASE WHEN n.k IS NOT NULL AND spec <> '' THEN spec ELSE p_type END AS spec, CASE WHEN n.k IS NULL THEN p_size > 2 ELSE spec <> '' END AS active
FROM part LEFT JOIN n ON n.k = p_partkey
""")
def merge_conditional(spark, sf_dir):
    """A mapping with an empty spec is switched off, with one switched on and updated."""
    part = table(spark, sf_dir, "part")
    new = part.where("p_partkey % 3 = 0").select((F.col("p_partkey") + 500).alias("p_partkey"), F.when(F.col("p_size") < 20, "").otherwise(F.col("p_type")).alias("new"))
    on = F.col("new") != ""
    return part.join(new, "p_partkey", "left").select(
        "p_partkey", F.when(on, F.col("new")).otherwise(F.col("p_type")).alias("spec"), F.when(F.col("new").isNull(), F.col("p_size") > 2).otherwise(on).alias("active")
    )


@query("SELECT l_orderkey, l_linenumber, NOT (o_custkey % 4 = 0) AS active FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def soft_delete_cascade(spark, sf_dir):
    """Parents switched off take their children along."""
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 4 != 0).alias("active"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(parents, "l_orderkey")


@query("""
WITH n AS (SELECT l_orderkey, l_linenumber + 100 AS l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R')
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM n) UNION ALL SELECT * FROM n
""")
def replace_children(spark, sf_dir):
    """Children of some parents deleted and reinserted."""
    lines = table(spark, sf_dir, "lineitem")
    new = lines.where("l_returnflag = 'R'").select("l_orderkey", (F.col("l_linenumber") + 100).alias("l_linenumber"), "l_partkey")
    return ops.replace_children(lines.select("l_orderkey", "l_linenumber", "l_partkey"), new, "l_orderkey")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48) THEN 'LOADED' ELSE o_orderstatus END AS status FROM orders
""")
def advance_status(spark, sf_dir):
    """Rows of an id set move on when their status allows."""
    ids = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return ops.update_where(rows, ids, "o_orderkey", "status", F.col("status").isin("O", "P"), "LOADED")


@query("""
SELECT o_orderkey, o_orderstatus AS was FROM orders, (SELECT max(o_orderdate) AS m FROM orders)
WHERE o_orderstatus IN ('O', 'P') AND o_orderdate < m - INTERVAL 900 DAY
""")
def expire_stale(spark, sf_dir):
    """Unresolved rows that nobody touched for the time to live."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate")).scalar()
    stale = F.col("o_orderdate") < last - F.expr("INTERVAL 900 DAYS")
    return orders.where(F.col("o_orderstatus").isin("O", "P") & stale).select("o_orderkey", F.col("o_orderstatus").alias("was"))


@query("""
SELECT s_suppkey, s_name, last_header, n_lines FROM supplier LEFT JOIN (
  SELECT l_suppkey, max(l_orderkey) AS last_header, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
""")
def vendor_latest(spark, sf_dir):
    """Vendor master with the latest document of each vendor."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_orderkey").alias("last_header"), F.count("*").alias("n_lines"))
    return table(spark, sf_dir, "supplier").join(last, "s_suppkey", "left").select("s_suppkey", "s_name", "last_header", "n_lines")


@query("""
WITH m AS (SELECT o_orderkey AS shell, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS kept FROM orders)
SELECT kept AS header, l_linenumber, count(*) AS n FROM lineitem JOIN m ON shell = l_orderkey GROUP BY 1, 2
""")
def reparent_merge(spark, sf_dir):
    """Later shells of a key merge into the first; their children move there."""
    from pyspark.sql.window import Window

    first = F.first("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    moved = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), first.alias("header"))
    return table(spark, sf_dir, "lineitem").join(moved, "l_orderkey").groupBy("header", "l_linenumber").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE::VARCHAR AS note, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS pos FROM lineitem),
b AS (SELECT l_orderkey, CASE WHEN l_tax < 0.03 THEN '  ' ELSE 'tax ' || (l_tax * 100)::INTEGER END AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS pos
  FROM lineitem WHERE l_returnflag = 'N')
SELECT a.l_orderkey, l_linenumber, CASE WHEN trim(v) <> '' THEN v ELSE note END AS note FROM a LEFT JOIN b ON b.l_orderkey = a.l_orderkey AND b.pos = a.pos
""")
def positional_patch(spark, sf_dir):
    """New texts patch lines by position; blanks never overwrite."""
    lines = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey", "l_extendedprice"))
    old = lines.select("l_orderkey", "l_linenumber", "o", F.date_format("l_shipdate", "yyyy-MM-dd").alias("note"))
    tax = F.concat(F.lit("tax "), F.bround(F.col("l_tax") * 100).cast("int").cast("string"))
    new = lines.where("l_returnflag = 'N'").select("l_orderkey", "o", F.when(F.col("l_tax") < 0.03, "  ").otherwise(tax).alias("note"))
    return ops.patch_by_position(old, new, "l_orderkey", "o", "o", "note").drop("o")
