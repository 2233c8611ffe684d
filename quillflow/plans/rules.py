"""Filter and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillflow.operators import aggregate as agg
from quillflow.operators import rules as ops
from quillflow.plans.aggregates import BATCH, LABELLED, labelled_batches
from quillflow.plans.registry import query
from quillflow.sources.tables import table, trackers


@query(f"SELECT o_orderkey AS id, {BATCH} AS batch FROM orders WHERE o_orderstatus IN ('O', 'P') AND NOT o_orderpriority LIKE '5%'")
def by_status(spark, sf_dir):
    """Live rows of some statuses; a null flag means not excluded."""
    rows = trackers(spark, sf_dir)
    return rows.where(F.col("status").isin("O", "P") & ~F.coalesce("excluded", F.lit(False))).select("id", "batch")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_type), 're') OR contains(lower(p_brand), 're')")
def search_contains(spark, sf_dir):
    """Substring search over several columns."""
    return table(spark, sf_dir, "part").where(ops.any_contains([F.col("p_name"), F.col("p_type"), F.col("p_brand")], "RE")).select("p_partkey", "p_name")


@query("SELECT p_type, count(*) AS n FROM part WHERE ends_with(p_type, right(p_brand, 1)) OR ends_with(p_name, '1') GROUP BY 1")
def suffix_match(spark, sf_dir):
    """Names with a wanted ending, taken literally."""
    part = table(spark, sf_dir, "part")
    kept = part.where(F.endswith("p_type", F.expr("right(p_brand, 1)")) | F.endswith("p_name", F.lit("1")))
    return kept.groupBy("p_type").agg(F.count("*").alias("n"))


@query("""
SELECT event_id, user_id, event_type, strftime(ts, '%d-%m-%Y %H:%M:%S') AS at FROM events
WHERE user_id < 60 AND event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'
  AND (contains(lower(event_type), '7') OR contains(lower(props), '7') OR contains(event_id::VARCHAR, '7')) ORDER BY ts DESC, event_id DESC LIMIT 200
""")
def audit_search(spark, sf_dir):
    """Newest entries that meet all given filters, a text search among them (a top-200 report)."""
    hit = ops.any_contains([F.col("event_type"), F.col("props"), F.col("event_id").cast("string")], "7")
    during = (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-21").cast("timestamp_ntz"))
    found = table(spark, sf_dir, "events").where((F.col("user_id") < 60) & F.col("event_type").isin("click", "view") & during & hit)
    found = found.orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return found.select("event_id", "user_id", "event_type", F.date_format("ts", "dd-MM-yyyy HH:mm:ss").alias("at"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate + INTERVAL 90 DAY > (SELECT max(o_orderdate) FROM orders)")
def active_asof(spark, sf_dir):
    """Rows still valid as of the latest time in the table."""
    orders = table(spark, sf_dir, "orders")
    now = orders.agg(F.max("o_orderdate")).scalar()
    return orders.where("o_orderstatus <> 'F'").where(F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS") > now).select("o_orderkey")


MISSING = """
SELECT o_orderkey, o_custkey, o_orderstatus, array_to_string(list_sort(list_filter([
  CASE WHEN trim(coalesce(CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority END, '')) = '' THEN 'priority' END,
  CASE WHEN trim(coalesce(CASE WHEN o_totalprice > 50000 THEN o_orderstatus ELSE '  ' END, '')) = '' THEN 'amount' END,
  CASE WHEN trim(coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN 'x' ELSE '' END, '')) = '' THEN 'buyer' END], lambda x: x IS NOT NULL)), ',') AS missing FROM orders
"""


def _missing(spark, sf_dir):
    fields = {
        "priority": F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderpriority")),
        "amount": F.when(F.col("o_totalprice") > 50000, F.col("o_orderstatus")).otherwise("  "),
        "buyer": F.when(F.col("o_orderkey") % 5 != 0, "x").otherwise(""),
    }
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.array_join(ops.missing_fields(fields), ",").alias("missing"))


@query(f"SELECT o_orderkey, missing FROM ({MISSING})")
def missing_fields(spark, sf_dir):
    """Names of the mandatory fields that are blank."""
    return _missing(spark, sf_dir).select("o_orderkey", "missing")


VERDICT = """
SELECT o_orderkey, o_custkey, CASE WHEN o_custkey % 11 = 0 THEN 'BUYER ORDER NO DOESN''T EXIST' WHEN o_orderpriority LIKE '5%' AND o_orderkey % 3 = 0 THEN 'PENDING IN SF'
  WHEN n_lines IS NULL THEN 'PENDING IN SF' WHEN bad IS NOT NULL THEN 'DATA MISMATCH' ELSE 'READY TO LOAD' END AS verdict, bad.rule AS rule
FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n_lines, min({'line': l_linenumber, 'rule': CASE WHEN l_quantity > 49 THEN 1 WHEN l_discount > 0.09 THEN 2 ELSE 3 END})
    FILTER (l_quantity > 49 OR l_discount > 0.09 OR l_tax > 0.075) AS bad FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
"""


def _verdicts(spark, sf_dir):
    bad = F.when(F.col("l_quantity") > 49, 1).when(F.col("l_discount") > 0.09, 2).when(F.col("l_tax") > 0.075, 3)
    lines = table(spark, sf_dir, "lineitem").withColumn("rule", bad)
    lines = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.min(F.when(F.col("rule").isNotNull(), F.struct("l_linenumber", "rule"))).alias("bad"))
    rules = [
        (F.col("o_custkey") % 11 == 0, "BUYER ORDER NO DOESN'T EXIST"),
        (F.startswith("o_orderpriority", F.lit("5")) & (F.col("o_orderkey") % 3 == 0), "PENDING IN SF"),
        (F.col("n_lines").isNull(), "PENDING IN SF"),
        (F.col("bad").isNotNull(), "DATA MISMATCH"),
    ]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return orders.join(lines, "o_orderkey", "left").select("o_orderkey", "o_custkey", ops.first_hit(rules, "READY TO LOAD").alias("verdict"), F.col("bad.rule").alias("rule"))


@query(f"SELECT o_orderkey, verdict, rule::INTEGER AS rule FROM ({VERDICT})")
def verdict(spark, sf_dir):
    """First failing rule of a document; lines are tested in order, rules in order within a line."""
    return _verdicts(spark, sf_dir).select("o_orderkey", "verdict", "rule")


@query(f"""
SELECT o_orderkey, CASE WHEN v.o_custkey % 11 = 0 AND rn > 1 THEN 'DUPLICATE' WHEN rn > 1 AND o_orderstatus = 'F' THEN 'DUPLICATE' WHEN o_totalprice < 20000 THEN 'NEW TEMPLATE'
  WHEN o_orderpriority LIKE '1%' THEN 'SERVICE' ELSE v.verdict END AS route
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, {BATCH} ORDER BY o_orderkey) AS rn FROM orders) o JOIN ({VERDICT}) v USING (o_orderkey)
""")
def routing(spark, sf_dir):
    """Duplicate, new template, service, else the verdict of its lines."""
    seen = F.row_number().over(Window.partitionBy("buyer", "batch").orderBy("id"))
    rows = trackers(spark, sf_dir).withColumn("rn", seen)
    rows = rows.join(_verdicts(spark, sf_dir).select(F.col("o_orderkey").alias("id"), "verdict"), "id")
    route = (
        F.when((F.col("buyer") % 11 == 0) & (F.col("rn") > 1), "DUPLICATE").when((F.col("rn") > 1) & (F.col("status") == "F"), "DUPLICATE")
        .when(F.col("amount") < 20000, "NEW TEMPLATE").when(F.startswith("priority", F.lit("1")), "SERVICE").otherwise(F.col("verdict"))
    )
    return rows.select(F.col("id").alias("o_orderkey"), route.alias("route"))


@query(f"""
SELECT m.o_orderkey, CASE WHEN verdict LIKE 'BUYER%' THEN verdict WHEN contains(missing, 'amount') THEN 'NEW TEMPLATE' WHEN missing <> '' THEN 'DATA MISMATCH' ELSE 'READY TO LOAD' END AS gated,
  missing = '' AND NOT verdict LIKE 'BUYER%' AS active FROM ({MISSING}) m JOIN ({VERDICT}) v ON v.o_orderkey = m.o_orderkey
""")
def verdict_gate(spark, sf_dir):
    """Completeness has the last word on a new run."""
    joined = _missing(spark, sf_dir).select("o_orderkey", "missing").join(_verdicts(spark, sf_dir).select("o_orderkey", "verdict"), "o_orderkey")
    skipped = F.startswith("verdict", F.lit("BUYER"))
    gated = F.when(skipped, F.col("verdict")).when(F.contains("missing", F.lit("amount")), "NEW TEMPLATE").when(F.col("missing") != "", "DATA MISMATCH").otherwise("READY TO LOAD")
    return joined.select("o_orderkey", gated.alias("gated"), ((F.col("missing") == "") & ~skipped).alias("active"))


@query(f"""
WITH b AS ({LABELLED})
SELECT batch, NOT (label = 'EXCLUDED') AND open > 0 AND pending < 6 AND NOT EXISTS (SELECT 1 FROM b p WHERE p.batch < b.batch AND p.pending >= 15) AS eligible FROM b
""")
def download_eligible(spark, sf_dir):
    """Batches that meet all download guards, the one on earlier batches included."""
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    blocked = F.coalesce(F.bool_or(F.col("pending") >= 15).over(before), F.lit(False))
    ok = (F.col("label") != "EXCLUDED") & (F.col("open") > 0) & (F.col("pending") < 6) & ~blocked
    return labelled_batches(spark, sf_dir).select("batch", ok.alias("eligible"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_size BETWEEN 10 AND 30")
def natural_sort(spark, sf_dir):
    """Rows in the numeric order of a text column, then by the text."""
    rows = table(spark, sf_dir, "part").where("p_size between 10 and 30").withColumn("no", F.col("p_size").cast("string"))
    return rows.orderBy(F.col("no").try_cast("double"), "p_name", "p_partkey").select("p_partkey", "p_name", "p_size")


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus = 'P' DESC, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paged(spark, sf_dir):
    """A page of a stable two-class order."""
    first = F.when(F.col("o_orderstatus") == "P", 0).otherwise(1)
    return table(spark, sf_dir, "orders").orderBy(first, F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_orderstatus")


@query("""
SELECT 'orders' AS what, count(*) AS n, count(o_custkey) AS filled FROM orders UNION ALL SELECT 'lineitem', count(*), count(l_orderkey) FROM lineitem
UNION ALL SELECT 'customer', count(*), count(c_name) FROM customer
""")
def union_check(spark, sf_dir):
    """Self-check of several tables in one result."""
    check = lambda name, c: table(spark, sf_dir, name).agg(F.lit(name).alias("what"), F.count("*").alias("n"), F.count(c).alias("filled"))
    return check("orders", "o_custkey").unionAll(check("lineitem", "l_orderkey")).unionAll(check("customer", "c_name"))


@query("""
WITH e AS (SELECT user_id, list_distinct(list(event_type)) AS a, list_distinct(list(CASE WHEN value > 90 THEN event_type END)) AS b FROM events GROUP BY 1)
SELECT user_id, round(len(list_intersect(a, b)) / len(a), 9) AS score FROM e
""")
def jaccard(spark, sf_dir):
    """Label-set overlap."""
    from quillflow.operators.joins import jaccard as score

    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"), F.collect_set(F.when(F.col("value") > 90, F.col("event_type"))).alias("b"))
    return sets.select("user_id", F.round(score(F.col("a"), F.col("b")), 9).alias("score"))


@query("""
SELECT l_orderkey, round(sum(CASE WHEN l_returnflag <> 'A' THEN l_extendedprice::DECIMAL(18,4) END)::DOUBLE, 2) AS goods, sum((l_returnflag = 'A')::INTEGER)::BIGINT AS n_charges
FROM lineitem GROUP BY 1
""")
def goods_and_charges(spark, sf_dir):
    """Conditional sums of goods and charges."""
    lines = table(spark, sf_dir, "lineitem")
    goods = agg.money(F.when(F.col("l_returnflag") != "A", F.col("l_extendedprice")))
    return lines.groupBy("l_orderkey").agg(F.round(goods, 2).alias("goods"), agg.count_if(F.col("l_returnflag") == "A").alias("n_charges"))
