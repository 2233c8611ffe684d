"""Window queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillflow.operators import window as win
from quillflow.plans.aggregates import BATCH, LABELLED, labelled_batches
from quillflow.plans.registry import query
from quillflow.sources.tables import table, trackers

STAMP = "yyyy-MM-dd HH:mm:ss"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _newest():
    return [F.desc("ts"), F.desc("event_id")]


def _seconds(column="ts"):
    return F.unix_timestamp(F.col(column).cast("timestamp"))


RANKED = "SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY ts DESC, event_id DESC) AS rn FROM events"


@query(f"SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM ({RANKED.format(by='user_id, event_type')}) WHERE rn = 1")
def latest_per_key(spark, sf_dir):
    """Latest upload of each path."""
    found = win.latest(_events(spark, sf_dir), ["user_id", "event_type"], _newest())
    return found.select("user_id", "event_type", "event_id", F.date_format("ts", STAMP).alias("at"))


@query(f"SELECT user_id, event_id, value FROM ({RANKED.format(by='user_id')}) WHERE rn = 1 AND event_type <> 'error'")
def latest_then_filter(spark, sf_dir):
    """Latest row first, status filter after."""
    return win.latest(_events(spark, sf_dir), ["user_id"], _newest()).where("event_type <> 'error'").select("user_id", "event_id", "value")


@query("""
SELECT user_id, event_type AS last_type, n FROM (
  SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1
""")
def download_who(spark, sf_dir):
    """Who downloaded last, and how often."""
    by = Window.partitionBy("user_id")
    ranked = _events(spark, sf_dir).select("user_id", "event_type", F.count("*").over(by).alias("n"), F.row_number().over(by.orderBy(*_newest())).alias("rn"))
    return ranked.where("rn = 1").select("user_id", F.col("event_type").alias("last_type"), "n")


@query("""
SELECT o_orderkey, 'P' || left(o_orderpriority, 1) || '-' || lpad((row_number() OVER (PARTITION BY left(o_orderpriority, 1) ORDER BY o_orderkey) + 100)::VARCHAR, 6, '0') AS doc_no,
  row_number() OVER (ORDER BY o_orderkey) + 5000 AS entry_no FROM orders WHERE o_orderstatus <> 'F'
""")
def mint_numbers(spark, sf_dir):
    """Document numbers per prefix and entry numbers over all, from the last used on."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    rows = rows.select("o_orderkey", F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1), F.lit("-")).alias("prefix"))
    last = spark.createDataFrame([(f"P{k}-", 100) for k in range(1, 6)], "prefix string, last int")
    minted = win.mint(rows, "prefix", "o_orderkey", last, "doc_no")
    return win.global_row_number(minted, "o_orderkey", "entry_no", 5001).select("o_orderkey", "doc_no", "entry_no")


@query("""
WITH h AS (SELECT o_orderkey, 'DOC' || lpad((row_number() OVER (ORDER BY o_orderkey) + 899)::VARCHAR, 8, '0') AS doc_no FROM orders WHERE o_orderstatus = 'P')
SELECT doc_no, l_orderkey, l_linenumber * 10000 AS line_no, count(*) AS n FROM lineitem JOIN h ON l_orderkey = o_orderkey GROUP BY ALL
""")
def renumber(spark, sf_dir):
    """New numbers from a start, carried to the children by key."""
    heads = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    heads = win.global_row_number(heads, "o_orderkey", "no", 900).select("o_orderkey", F.concat(F.lit("DOC"), F.lpad(F.col("no").cast("string"), 8, "0")).alias("doc_no"))
    lines = table(spark, sf_dir, "lineitem").join(heads, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("doc_no", "l_orderkey", (F.col("l_linenumber") * 10000).alias("line_no")).agg(F.count("*").alias("n"))


@query("""
SELECT left(o_orderpriority, 1) AS prefix, max(try_cast(right(o_orderkey::VARCHAR, 4) AS BIGINT)) + 1 AS next_no
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) GROUP BY 1
""")
def next_sequence(spark, sf_dir):
    """Next number under each prefix, ids of the set at hand left out."""
    out = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    rest = table(spark, sf_dir, "orders").join(out, "o_orderkey", "left_anti")
    number = F.expr("right(cast(o_orderkey as string), 4)").try_cast("long")
    return rest.groupBy(F.substring("o_orderpriority", 1, 1).alias("prefix")).agg((F.max(number) + 1).alias("next_no"))


@query(f"""
WITH b AS ({LABELLED})
SELECT batch, label, coalesce((SELECT string_agg(p.batch, ',' ORDER BY p.batch DESC) FROM b p WHERE p.batch < b.batch AND p.label <> 'COMPLETED' AND p.pending > 4), '') AS blocked_by FROM b
""")
def blocked_by(spark, sf_dir):
    """Earlier batches that are not cleared, newest first."""
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    waiting = F.when((F.col("label") != "COMPLETED") & (F.col("pending") > 4), F.col("batch"))
    batches = labelled_batches(spark, sf_dir).withColumn("blocked_by", F.array_join(F.reverse(F.collect_list(waiting).over(before)), ","))
    return batches.select("batch", "label", "blocked_by")


@query("""
SELECT user_id, island, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS begins FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS island FROM (
    SELECT *, CASE WHEN floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) > 21600 THEN 1 ELSE 0 END AS new FROM events))
GROUP BY 1, 2
""")
def gap_islands(spark, sf_dir):
    """Runs of rows without a gap of over six hours."""
    marked = win.islands(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], _seconds(), 21600, "island")
    return marked.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.date_format(F.min("ts"), STAMP).alias("begins"))


@query("""
SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS segment FROM (
  SELECT *, CASE WHEN v IS NOT NULL AND p IS NOT NULL AND v <> p THEN 1 ELSE 0 END AS new FROM (
    SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (
      SELECT *, nullif(event_type, 'error') AS v FROM events)))
""")
def page_segments(spark, sf_dir):
    """Pages dealt to documents by the last number read."""
    value = F.nullif("event_type", F.lit("error"))
    return win.segments(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], value, "segment").select("event_id", "user_id", "segment")


@query(f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey, {BATCH} ORDER BY o_orderkey) = 1 THEN 'NEW' ELSE 'DUPLICATE' END AS verdict FROM orders
""")
def first_wins_dedup(spark, sf_dir):
    """The first row of a key is new, later ones are duplicates."""
    w = Window.partitionBy("buyer", "batch").orderBy("id")
    return trackers(spark, sf_dir).select(F.col("id").alias("o_orderkey"), F.when(F.row_number().over(w) == 1, "NEW").otherwise("DUPLICATE").alias("verdict"))


@query("""
SELECT event_id, n, n > 3 AS throttled FROM (
  SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW) AS n FROM events)
""")
def throttle(spark, sf_dir):
    """Trailing-window counts per key against a limit."""
    counted = _events(spark, sf_dir).select("event_id", win.trailing_count(["user_id"], _seconds(), 43200).alias("n"))
    return counted.withColumn("throttled", F.col("n") > 3)


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS rn FROM customer) WHERE rn <= 5")
def topk_per_group(spark, sf_dir):
    """Five lowest of each group."""
    return win.latest(table(spark, sf_dir, "customer"), ["c_nationkey"], [F.asc("c_acctbal"), F.asc("c_custkey")], 5).select("c_custkey", "c_nationkey", "c_acctbal")


@query("""
SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1
""")
def outer_apply_latest(spark, sf_dir):
    """Latest child of each row, null where there is none."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("m"))
    joined = table(spark, sf_dir, "customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("c_custkey", F.col("m.o_orderkey").alias("last_order"), F.col("m.o_orderstatus").alias("last_status"))


@query("SELECT user_id, event_type, max(event_id) AS last_event, arg_max(value, event_id) AS last_value FROM events GROUP BY 1, 2")
def latest_by_action(spark, sf_dir):
    """Who and when of the last event of each action."""
    return _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_event"), F.max_by("value", "event_id").alias("last_value"))
