"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillflow.operators import joins as ops
from quillflow.plans.aggregates import BATCH
from quillflow.plans.registry import query
from quillflow.sources.tables import statuses, table, trackers


@query(f"""
SELECT o_orderkey AS id, c_name AS buyer_name, n_name AS nation, {BATCH} AS batch, s.name AS status_name
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (VALUES ('F','FINISHED'),('O','OPEN'),('P','PENDING'),('X','EXCLUDED')) s(code, name) ON s.code = o_orderstatus
WHERE NOT o_orderpriority LIKE '5%'
""")
def invoice_list(spark, sf_dir):
    """Rows with the names of their dimensions."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    buyers = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = trackers(spark, sf_dir).where(~F.coalesce("excluded", F.lit(False))).join(buyers, F.col("buyer") == F.col("c_custkey"))
    return rows.join(F.broadcast(statuses(spark)), "status", "left").select("id", F.col("c_name").alias("buyer_name"), "nation", "batch", "status_name")


@query(f"SELECT o_orderkey AS id, o_orderstatus AS status, {BATCH} AS batch FROM orders WHERE {BATCH} IN (SELECT {BATCH} FROM orders WHERE o_totalprice > 490000) AND coalesce(o_orderstatus, '') NOT IN ('P', 'X')")
def fetch_batch(spark, sf_dir):
    """Rows of the batches that hold a wanted row, negative list aside."""
    rows = trackers(spark, sf_dir)
    wanted = rows.where("amount > 490000").select("batch").distinct()
    return rows.join(wanted, "batch", "left_semi").where(~F.coalesce("status", F.lit("")).isin("P", "X")).select("id", "status", "batch")


@query(f"SELECT o_orderkey AS id, o_orderstatus AS status, {BATCH} AS batch, NULL::VARCHAR AS remark, count(l_linenumber) AS n_lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
def fetch_batch_all(spark, sf_dir):
    """Wanted columns that exist, null for one that doesn't, with the number of lines."""
    wanted = ("id", "status", "batch", "remark")
    rows = trackers(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("l_linenumber").alias("n_lines"))
    shown = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in wanted]
    return rows.join(lines, "id", "left").select(*shown, F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"))


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('signup', 'purchase') AND json_extract_string(props, '$.k')::INTEGER IN (3, 5, 7)")
def json_array_semi(spark, sf_dir):
    """Rows wanted by a JSON array of types and one of numbers."""
    wanted = spark.range(1).select(F.explode(F.from_json(F.lit('["signup","purchase"]'), "array<string>")).alias("event_type"))
    numbers = spark.range(1).select(F.explode(F.from_json(F.lit("[3,5,7]"), "array<int>")).alias("k"))
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return rows.join(F.broadcast(wanted), "event_type", "left_semi").join(F.broadcast(numbers), "k", "left_semi").select("event_id", "user_id")


@query("""
SELECT o_orderkey AS id, 'PROCESSED' AS action FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
UNION ALL SELECT DISTINCT l_orderkey, 'RETURNED' FROM lineitem WHERE l_returnflag = 'R'
""")
def anti_insert(spark, sf_dir):
    """Events that are missing, inserted beside those that are there."""
    there = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct()
    missing = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(there, "id", "left_anti")
    return missing.withColumn("action", F.lit("PROCESSED")).unionByName(there.withColumn("action", F.lit("RETURNED")))


@query("""
WITH n AS (SELECT o_orderkey AS id, o_custkey AS no, o_orderdate::DATE AS day, strftime(o_orderdate, '%Y%m') AS batch FROM orders)
SELECT no, count(*) AS n, count(DISTINCT batch) AS n_batches FROM n GROUP BY 1 HAVING count(DISTINCT batch) > 1
""")
def number_collision(spark, sf_dir):
    """Numbers that stand in more than one batch: an aggregate where a self-join would pair all rows."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("no"), F.date_format("o_orderdate", "yyyyMM").alias("batch"))
    return rows.groupBy("no").agg(F.count("*").alias("n"), F.count_distinct("batch").alias("n_batches")).where("n_batches > 1")


@query("""
SELECT l_orderkey, l_linenumber, p_name, p_name IS NULL AS missed FROM lineitem
LEFT JOIN (SELECT p_partkey, arg_max(p_name, p_size) AS p_name FROM part WHERE p_size > 5 GROUP BY 1) ON p_partkey = l_partkey WHERE l_returnflag = 'A'
""")
def enrich_lookup(spark, sf_dir):
    """Item-master lookup; of duplicate keys the last wins, misses are kept."""
    master = table(spark, sf_dir, "part").where("p_size > 5").groupBy(ops.norm_key(F.col("p_partkey").cast("string")).alias("k")).agg(F.max_by("p_name", "p_size").alias("p_name"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").withColumn("k", ops.norm_key(F.col("l_partkey").cast("string")))
    return lines.join(master, "k", "left").select("l_orderkey", "l_linenumber", "p_name", F.col("p_name").isNull().alias("missed"))


QUEUE = """
WITH offer AS (
  SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS line, greatest(1, trunc(l_quantity))::INTEGER AS qty FROM lineitem WHERE l_returnflag = 'R'),
slots AS (SELECT k, line, row_number() OVER (PARTITION BY k ORDER BY line, i) AS slot FROM (SELECT k, line, unnest(range(qty)) AS i FROM offer)),
claim AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS row_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS slot
  FROM lineitem WHERE l_returnflag <> 'R')
"""


def _queue_sides(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    offers = lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"), F.col("id").alias("line"), F.greatest(F.lit(1), F.col("l_quantity").cast("int")).alias("qty"))
    return offers, lines.where("l_returnflag <> 'R'").select(F.col("l_suppkey").alias("k"), F.col("id").alias("row_id"))


@query(f"{QUEUE} SELECT claim.k, row_id, claim.slot, line FROM claim LEFT JOIN slots ON slots.k = claim.k AND slots.slot = claim.slot")
def enrich_queue(spark, sf_dir):
    """Incoming rows claim the quantity slots of lines with the same key, in order."""
    offers, claims = _queue_sides(spark, sf_dir)
    return ops.queue_match(offers, claims, ["k"], "qty", "line", "row_id")


@query("""
WITH a AS (SELECT l_orderkey AS k, l_linenumber AS a_line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT l_orderkey AS k, l_linenumber AS b_line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'A')
SELECT a.k, a.pos::INTEGER AS pos, a_line, b_line FROM a JOIN b USING (k, pos, n)
""")
def enrich_positional(spark, sf_dir):
    """The rest zipped by position where both sides have as many rows."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("a_line"))
    b = lines.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("b_line"))
    return ops.positional(a, b, ["k"], "a_line", "b_line")


@query("""
SELECT l_orderkey, l_linenumber, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY l_suppkey, l_tax ORDER BY l_orderkey * 10 + l_linenumber
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS item
FROM (SELECT *, CASE WHEN l_quantity > 25 THEN l_partkey END AS v FROM lineitem)
""")
def sibling_fill(spark, sf_dir):
    """Unresolved lines take the item of the first resolved sibling of the same code and rate."""
    lines = table(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return ops.sibling_fill(lines, ["l_suppkey", "l_tax"], "o", "v", "item").select("l_orderkey", "l_linenumber", "item")


@query("""
SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(split_part(url, '://', 2), '/', 2) AS template, d.n > 1 AS active FROM pages
LEFT JOIN (SELECT split_part(split_part(url, '://', 2), '/', 1) AS h, count(*) AS n FROM pages GROUP BY 1) d ON d.h = split_part(split_part(url, '://', 2), '/', 1)
""")
def path_template(spark, sf_dir):
    """Template found by the parts of a path."""
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    pages = table(spark, sf_dir, "pages").select("page_id", F.split_part(rest, F.lit("/"), F.lit(1)).alias("host"), F.split_part(rest, F.lit("/"), F.lit(2)).alias("template"))
    known = pages.groupBy("host").agg((F.count("*") > 1).alias("active"))
    return pages.join(known, "host", "left").select("page_id", "host", "template", "active")


@query("""
WITH f AS (SELECT p_partkey AS fid, list_distinct(string_split(lower(p_name), ' ')) AS fs, p_brand FROM part WHERE p_size = 1),
d AS (SELECT p_partkey AS id, list_distinct(string_split(lower(p_name), ' ')) AS ds, p_brand FROM part),
s AS (SELECT id, fid, d.p_brand = f.p_brand AS same, len(list_intersect(ds, fs)) / len(list_distinct(ds || fs)) AS score FROM d JOIN f ON d.p_brand = f.p_brand OR list_has_any(ds, fs)),
r AS (SELECT *, CASE WHEN same THEN 1.0 ELSE score END AS final, row_number() OVER (PARTITION BY id ORDER BY same DESC, CASE WHEN same THEN 0 ELSE -score END, fid) AS rn FROM s)
SELECT id, fid, final::DOUBLE AS score FROM r WHERE rn = 1 AND final >= 0.3
""")
def format_match(spark, sf_dir):
    """First format by precedence: equal trusted key, else the best label overlap above a threshold.

    Formats are reduced to one per key and per label set before they are joined, on keys and on labels.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.array_sort(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("labels"))
    formats = part.where("p_size = 1").withColumnRenamed("p_partkey", "fid")
    rows = part.withColumnRenamed("p_partkey", "id")
    by_key = ops.first_of(rows, formats, "p_brand").withColumn("score", F.lit(1.0))
    rest = rows.join(formats.select("p_brand").distinct(), "p_brand", "left_anti")
    return by_key.unionByName(ops.best_overlap(rest.select("id", "labels"), formats.select("fid", "labels"), 0.3))


@query("""
SELECT lower(trim(p_type)) AS norm, p_brand, count(*) AS n, count(DISTINCT p_size)::BIGINT AS n_ids FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) > 1
""")
def desc_conflict(spark, sf_dir):
    """Descriptions claimed by more than one id."""
    grouped = table(spark, sf_dir, "part").groupBy(ops.norm_key("p_type").alias("norm"), "p_brand")
    return grouped.agg(F.count("*").alias("n"), F.count_distinct("p_size").alias("n_ids")).where("n_ids > 1")


@query("""
SELECT o_orderkey, o_orderstatus, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS suppliers, count(DISTINCT l_partkey) AS n_parts
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderstatus IN ('P', 'O') GROUP BY 1, 2
""")
def po_details(spark, sf_dir):
    """Orders with the distinct names of their suppliers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey")
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("P", "O")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("o_orderkey", "o_orderstatus").agg(F.array_join(F.array_sort(F.collect_set("s_name")), ",").alias("suppliers"), F.count_distinct("l_partkey").alias("n_parts"))


@query("""
WITH files AS (SELECT 'Customer#' || lpad((c_custkey * 2)::VARCHAR, 9, '0') AS f FROM customer),
o AS (SELECT f FROM files WHERE f NOT IN (SELECT c_name FROM customer))
SELECT f, left(f, 16) IN (SELECT left(c_name, 16) FROM customer) AS recovered FROM o
""")
def orphans(spark, sf_dir):
    """Files without a row, and whether a row shares their prefix: an equi semi-join on the prefix."""
    known = table(spark, sf_dir, "customer")
    found = known.select(F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") * 2).cast("string"), 9, "0")).alias("f"))
    lost = found.join(known.select(F.col("c_name").alias("f")), "f", "left_anti").withColumn("p", F.substring("f", 1, 16))
    prefixes = known.select(F.substring("c_name", 1, 16).alias("p")).distinct().withColumn("hit", F.lit(True))
    return lost.join(prefixes, "p", "left").select("f", F.coalesce("hit", F.lit(False)).alias("recovered"))


@query("SELECT o_custkey, strftime(o_orderdate, '%Y') AS year, count(*) AS n, CASE WHEN count(*) = 1 THEN min(o_orderkey) END AS o_orderkey FROM orders GROUP BY 1, 2")
def unique_or_null(spark, sf_dir):
    """The row of a key that has exactly one."""
    return ops.unique_or_null(table(spark, sf_dir, "orders").withColumn("year", F.date_format("o_orderdate", "yyyy")), ["o_custkey", "year"], "o_orderkey")
