"""Aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillflow.operators import aggregate as agg
from quillflow.plans.registry import query
from quillflow.sources.tables import stage_stamps, statuses, table, trackers

BATCH = "'B_' || strftime(o_orderdate, '%Y%m')"


@query(f"""
SELECT s.status, s.status_name, s.display_order::INTEGER AS display_order, count(o.o_orderkey) AS n
FROM (VALUES ('F','FINISHED',1),('O','OPEN',2),('P','PENDING',3),('X','EXCLUDED',4)) s(status, status_name, display_order)
LEFT JOIN orders o ON o.o_orderstatus = s.status AND NOT (o.o_orderpriority LIKE '5%') GROUP BY ALL
""")
def status_counts(spark, sf_dir):
    """Rows by status, zero-filled, without excluded ones."""
    live = trackers(spark, sf_dir).where(~F.coalesce("excluded", F.lit(False)))
    return agg.zero_filled_counts(statuses(spark), live, "status", "id")


@query(f"""
SELECT {BATCH} AS batch, count(*) AS n, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_created,
  count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderpriority LIKE '5%') AS n_excluded,
  sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS amount
FROM orders GROUP BY 1
""")
def batch_summary(spark, sf_dir):
    """Counts, earliest time and amount of each batch."""
    return trackers(spark, sf_dir).groupBy("batch").agg(
        F.count("*").alias("n"),
        F.date_format(F.min("created"), "yyyy-MM-dd HH:mm:ss").alias("first_created"),
        agg.count_if(F.col("status") == "O").alias("n_open"),
        agg.count_if(F.col("excluded")).alias("n_excluded"),
        agg.money("amount").alias("amount"),
    )


@query(f"""
SELECT {BATCH} AS batch, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O",
  count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) FILTER (o_orderstatus = 'X') AS "X" FROM orders GROUP BY 1
""")
def batch_status_pivot(spark, sf_dir):
    """Counts by status as columns of each batch."""
    pivoted = trackers(spark, sf_dir).groupBy("batch").pivot("status", ["F", "O", "P", "X"]).agg(F.count("id"))
    return pivoted.na.fill(0)


BATCH_COUNTS = f"""
SELECT {BATCH} AS batch, count(*) AS total, count(*) FILTER (o_orderpriority LIKE '5%') AS excluded,
  count(*) FILTER (o_orderstatus = 'F' AND NOT o_orderpriority LIKE '5%') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open,
  count(*) FILTER (o_orderstatus = 'P') AS pending FROM orders GROUP BY 1
"""
LABELLED = f"""
SELECT *, CASE WHEN total > 0 AND excluded = total THEN 'EXCLUDED' WHEN total > 0 AND finished + excluded >= total THEN 'COMPLETED'
  WHEN finished > open THEN 'IN PROGRESS' WHEN pending > 0 THEN 'DOWNLOADED' ELSE 'CREATED' END AS label FROM ({BATCH_COUNTS})
"""


def labelled_batches(spark, sf_dir):
    """Batches with status counts and label."""
    skipped = F.coalesce("excluded", F.lit(False))
    counts = trackers(spark, sf_dir).groupBy("batch").agg(
        F.count("*").alias("total"),
        agg.count_if(skipped).alias("excluded"),
        agg.count_if((F.col("status") == "F") & ~skipped).alias("finished"),
        agg.count_if(F.col("status") == "O").alias("open"),
        agg.count_if(F.col("status") == "P").alias("pending"),
    )
    return counts.withColumn("label", agg.batch_label(counts))


@query(LABELLED)
def batch_label(spark, sf_dir):
    """Derived label of each batch, by the first rule that holds."""
    return labelled_batches(spark, sf_dir)


@query("""
SELECT c_nationkey, min(replace(c_name, 'Customer#', '')) AS first_text, max(replace(c_name, 'Customer#', '')) AS last_text,
  min(try_cast(replace(c_name, 'Customer#', '') AS BIGINT)) AS first_number, max(try_cast(replace(c_name, 'Customer#', '') AS BIGINT)) AS last_number
FROM customer GROUP BY 1
""")
def number_range(spark, sf_dir):
    """Range of numbers kept as text, by text and by value."""
    text = F.replace("c_name", F.lit("Customer#"), F.lit(""))
    number = text.try_cast("long")
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.min(text).alias("first_text"), F.max(text).alias("last_text"), F.min(number).alias("first_number"), F.max(number).alias("last_number")
    )


STAMPS = """
SELECT user_id, min(ts) FILTER (event_type = 'signup') AS created, min(ts) FILTER (event_type = 'view') AS loaded,
  min(ts) FILTER (event_type = 'click') AS posted, min(ts) FILTER (event_type = 'purchase') AS completed FROM events GROUP BY 1
"""


@query(f"""
SELECT user_id % 10 AS bucket, count(*) AS n, strftime(min(loaded), '%Y-%m-%d') AS first_loaded, strftime(max(posted), '%Y-%m-%d') AS last_posted,
  datediff('day', min(loaded), max(posted))::BIGINT AS days
FROM ({STAMPS}) GROUP BY 1 HAVING count(loaded) > 0
""")
def report_batch_posted(spark, sf_dir):
    """Loaded and posted dates of groups that loaded anything; day gaps count midnights."""
    grouped = stage_stamps(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("bucket")).agg(
        F.count("*").alias("n"), F.min("loaded").alias("a"), F.max("posted").alias("b"), F.count("loaded").alias("k")
    )
    day = "yyyy-MM-dd"
    days = F.datediff(F.to_date("b"), F.to_date("a")).cast("long").alias("days")
    return grouped.where("k > 0").select("bucket", "n", F.date_format("a", day).alias("first_loaded"), F.date_format("b", day).alias("last_posted"), days)


@query("""
SELECT o_custkey, min(o_orderkey) AS first_id, min(o_orderpriority) AS least_priority, bool_or(o_orderstatus = 'P') AS any_pending,
  arg_min(o_orderpriority, o_orderkey) AS first_priority FROM orders GROUP BY 1
""")
def processed_invoices(spark, sf_dir):
    """One row per key by independent minima, and beside them the value of the first row itself."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderkey").alias("first_id"),
        F.min("o_orderpriority").alias("least_priority"),
        F.bool_or(F.col("o_orderstatus") == "P").alias("any_pending"),
        F.min_by("o_orderpriority", "o_orderkey").alias("first_priority"),
    )


@query("SELECT DISTINCT event_type, json_extract_string(props, '$.k')::BIGINT % 10 AS k FROM events")
def distinct_values(spark, sf_dir):
    """Distinct filter options."""
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).distinct()


@query("SELECT r_name, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def string_agg(spark, sf_dir):
    """Names of each group, joined in order."""
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(agg.string_list("n_name").alias("nations"))


@query("""
SELECT o_orderstatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS of_total, round(count(*) / max(count(*)) OVER (), 9) AS of_max
FROM orders GROUP BY 1
""")
def ratio_to_total(spark, sf_dir):
    """Shares of the total and of the largest group."""
    from pyspark.sql.window import Window

    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.withColumns({"of_total": F.round(F.col("n") / F.sum("n").over(every), 9), "of_max": F.round(F.col("n") / F.max("n").over(every), 9)})


@query("""
SELECT coalesce(r_name, 'ALL') AS region, coalesce(n_name, 'ALL') AS nation, count(*) AS n, sum(c_acctbal::DECIMAL(18,4))::DOUBLE AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def rollup_totals(spark, sf_dir):
    """Totals at nation, region and grand level."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    totals = joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"), agg.money("c_acctbal").alias("balance"))
    return totals.select(F.coalesce("r_name", F.lit("ALL")).alias("region"), F.coalesce("n_name", F.lit("ALL")).alias("nation"), "n", "balance")


@query("""
SELECT user_id, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at,
  arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1
""")
def download_rollup(spark, sf_dir):
    """First, last and number of downloads, with what the last one was."""
    stamp = "yyyy-MM-dd HH:mm:ss"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.date_format(F.min("ts"), stamp).alias("first_at"),
        F.date_format(F.max("ts"), stamp).alias("last_at"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
    )


@query("SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS labels FROM events GROUP BY 1")
def set_union_agg(spark, sf_dir):
    """Union of label sets over a key's rows."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("labels"))
    return rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))), "|").alias("labels"))


@query("""
SELECT user_id, event_type, n FROM (
  SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min((ts, event_id))) AS rn
  FROM events GROUP BY 1, 2) WHERE rn = 1
""")
def mode_first(spark, sf_dir):
    """Most frequent value per key, ties to the first seen."""
    return agg.mode_first(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("""
WITH c AS (
  SELECT o_custkey, i AS pos, substr(lpad(o_orderkey::VARCHAR, 9, '0'), i::INTEGER, 1) AS ch, o_orderkey
  FROM orders, range(1, 10) t(i)),
r AS (SELECT o_custkey, pos, ch, row_number() OVER (PARTITION BY o_custkey, pos ORDER BY count(*) DESC, min(o_orderkey)) AS rn FROM c GROUP BY 1, 2, 3)
SELECT o_custkey, string_agg(ch, '' ORDER BY pos) AS voted FROM r WHERE rn = 1 GROUP BY 1
""")
def char_vote(spark, sf_dir):
    """Character-wise majority of a key's readings."""
    readings = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("reading"))
    return agg.char_vote(readings, ["o_custkey"], "reading", "o_orderkey")


@query("""
SELECT conv_id, arg_min(text, turn) FILTER (role = 'user' AND trim(text) <> '') AS asked, arg_max(text, turn) FILTER (role <> 'user' AND trim(text) <> '') AS answered,
  count(DISTINCT lower(trim(text))) AS n_texts FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY 1
""")
def fold_fields(spark, sf_dir):
    """Fields folded over a group's pages: first non-blank wins, last wins, distinct kept."""
    filled = F.trim("text") != ""
    rows = table(spark, sf_dir, "conversations").distinct()
    return rows.groupBy("conv_id").agg(
        F.min_by("text", F.when((F.col("role") == "user") & filled, F.col("turn"))).alias("asked"),
        F.max_by("text", F.when((F.col("role") != "user") & filled, F.col("turn"))).alias("answered"),
        F.count_distinct(F.lower(F.trim("text"))).alias("n_texts"),
    )
