"""Ledger queries: saved batches with minted keys, mapped cells, upserts, labels by tiers, catalogue steps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillflow.operators import window as win
from quillflow.operators.aggregate import count_if, fold_contained, status_tallies, tier_label
from quillflow.operators.layout import groups_from_first
from quillflow.operators.merge import absorb, evolve
from quillflow.plans.registry import query
from quillflow.session import ship_package
from quillflow.sources.tables import table, table_or_empty

#: Lines of an order repeat line numbers, so their order takes all columns.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


@query(f"""
WITH doc AS (SELECT o_orderkey AS gid FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '5%'),
base AS (SELECT (SELECT max(o_orderkey) FROM orders) AS heads, (SELECT count(*) FROM lineitem) AS lines),
head AS (SELECT gid, heads + row_number() OVER (ORDER BY gid) AS id FROM doc, base),
line AS (SELECT id AS header_id, l_partkey, greatest(1, trunc(l_quantity))::BIGINT AS units, lines + row_number() OVER (ORDER BY id, {", ".join(LINE_ORDER)}) AS line_id
  FROM head JOIN lineitem ON l_orderkey = gid, base),
res AS (SELECT header_id, line_id, unnest(range(units)) AS u FROM line)
SELECT 'header' AS kind, id, id AS header_id, gid AS ref FROM head
UNION ALL SELECT 'line', line_id, header_id, l_partkey FROM line
UNION ALL SELECT 'reservation', row_number() OVER (ORDER BY line_id, u), header_id, line_id FROM res
UNION ALL SELECT 'tracker', id, id, 0 FROM head
""")
def save_batch(spark, sf_dir):
    """A batch of documents as header, line, reservation (one a unit) and tracker rows with minted keys.

    Headers are numbered in document order after the last one; lines and reservations after the counts of
    the headers before theirs, so nothing but one row a header is put in a global order.
    """
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    base = orders.agg(F.max("o_orderkey").alias("heads")).first().heads or 0, lines.count()
    docs = orders.where("o_orderstatus = 'P' and o_orderpriority like '5%'").select(F.col("o_orderkey").alias("gid"))
    units = F.greatest(F.lit(1), F.col("l_quantity").cast("int")).cast("long")
    sizes = lines.groupBy(F.col("l_orderkey").alias("gid")).agg(F.count("*").alias("n"), F.sum(units).alias("units"))
    heads = win.global_row_number(docs.join(sizes, "gid", "left").na.fill(0), "gid", "id", base[0] + 1)
    heads = win.global_running_sum(win.global_running_sum(heads, "id", "n", "lines_before"), "id", "units", "units_before")
    own = Window.partitionBy("id").orderBy(*LINE_ORDER)
    child = heads.join(lines, F.col("gid") == F.col("l_orderkey")).withColumn("u", units)
    child = child.withColumn("line_id", F.lit(base[1]) + F.col("lines_before") + F.row_number().over(own))
    child = child.withColumn("begin", F.col("units_before") + F.coalesce(F.sum("u").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    unit = child.select("id", "line_id", F.explode(F.sequence(F.col("begin") + 1, F.col("begin") + F.col("u"))).alias("entry"))
    named = lambda df, kind, key, ref: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col("id").cast("long").alias("header_id"), ref.cast("long").alias("ref"))
    return (
        named(heads, "header", "id", F.col("gid")).unionByName(named(child, "line", "line_id", F.col("l_partkey")))
        .unionByName(named(unit, "reservation", "entry", F.col("line_id"))).unionByName(named(heads, "tracker", "id", F.lit(0)))
    )


#: Sheet, column, specification (`=x` is a literal, else a field), default.
MAPPING = (
    ("Line", "Type", "kind", "Item"), ("Line", "No.", "part", ""), ("Line", "Currency", "=INR", ""), ("Line", "Priority", "priority", ""),
    ("Line", "Remark", "remark", "none"), ("Line", "Line No.", "", ""), ("Header", "Buyer", "buyer", ""),
)


@query("""
WITH m(sheet, col, spec, dflt) AS (VALUES ('Line','Type','kind','Item'),('Line','No.','part',''),('Line','Currency','=INR',''),('Line','Priority','priority',''),('Line','Remark','remark','none'),('Line','Line No.','',''),('Header','Buyer','buyer','')),
l AS (SELECT *, 'Line' AS sheet FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND o_orderstatus = 'P')
SELECT l_orderkey, l_linenumber, l_partkey, col, CASE WHEN col = 'Line No.' THEN (l_linenumber * 10000)::VARCHAR WHEN left(spec, 1) = '=' THEN substr(spec, 2)
  WHEN spec = 'part' THEN l_partkey::VARCHAR WHEN spec = 'kind' AND l_linestatus = 'F' THEN 'Charge (Item)' WHEN spec = 'priority' THEN o_orderpriority ELSE dflt END AS value, count(*) AS n
FROM l JOIN m USING (sheet) GROUP BY ALL
""")
def mapped_cells(spark, sf_dir):
    """Cells by a mapping table: the relationship key first, then literals, item and header fields, defaults."""
    mapping = spark.createDataFrame(list(MAPPING), "sheet string, col string, spec string, dflt string")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    rows = lines.join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("sheet", F.lit("Line"))
    item = F.create_map(F.lit("part"), F.col("l_partkey").cast("string"), F.lit("kind"), F.when(F.col("l_linestatus") == "F", "Charge (Item)"))
    header = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("buyer"), F.col("o_custkey").cast("string"))
    linked = F.when(F.col("col") == "Line No.", (F.col("l_linenumber") * 10000).cast("string"))
    literal = F.when(F.startswith("spec", F.lit("=")), F.substring("spec", 2, 1000))
    value = F.coalesce(linked, literal, F.element_at("item", F.col("spec")), F.element_at("header", F.col("spec")), "dflt")
    cells = rows.withColumn("item", item).withColumn("header", header).join(F.broadcast(mapping), "sheet").withColumn("value", value)
    return cells.groupBy("l_orderkey", "l_linenumber", "l_partkey", "col", "value").agg(F.count("*").alias("n"))


@query("""
SELECT p_type AS col, CASE WHEN count(*) FILTER (p_size % 50 = 0 AND p_retailprice > 950 AND p_type < 'P') > 0 THEN 'Template' ELSE 'None' END AS lineage, count(DISTINCT p_brand) AS templates FROM part GROUP BY 1
""")
def config_rollup(spark, sf_dir):
    """A template column counts as filled only where any template gives it a value."""
    filled = F.bool_or((F.col("p_size") % 50 == 0) & (F.col("p_retailprice") > 950) & (F.col("p_type") < "P"))
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("col")).agg(F.when(filled, "Template").otherwise("None").alias("lineage"), F.count_distinct("p_brand").alias("templates"))


@query("""
WITH new AS (SELECT o_custkey * 2 AS code, max(o_orderkey) AS last_header, arg_max(o_orderpriority, o_orderkey) AS last_no, arg_max(o_orderdate, o_orderkey) AS seen, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(c_custkey, code) AS code, c_name AS name, last_header, last_no, CASE WHEN c_custkey IS NULL THEN strftime(seen, '%Y-%m-%d') ELSE '1990-01-01' END AS first_seen,
  strftime(seen, '%Y-%m-%d') AS modified, coalesce(n, 0) AS uses FROM customer FULL JOIN new ON c_custkey = code
""")
def vendor_upsert(spark, sf_dir):
    """Master rows updated from the latest document of each code, or inserted."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    last = F.max_by(F.struct("o_orderpriority", "o_orderdate"), "o_orderkey")
    new = orders.groupBy((F.col("o_custkey") * 2).alias("code")).agg(F.max("o_orderkey").alias("last_header"), last.alias("last"), F.count("*").alias("n"))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.lit("1990-01-01").alias("first"))
    seen = F.date_format("last.o_orderdate", "yyyy-MM-dd")
    joined = old.join(new, "code", "full")
    return joined.select("code", "name", "last_header", F.col("last.o_orderpriority").alias("last_no"), F.coalesce("first", seen).alias("first_seen"), seen.alias("modified"), F.coalesce("n", F.lit(0)).cast("long").alias("uses"))


@query("""
WITH shell AS (SELECT *, o_orderkey - 1 AS target FROM orders WHERE o_orderkey % 10 = 7),
h AS (SELECT o.o_orderkey AS id, coalesce(s.o_totalprice, o.o_totalprice) AS amount, CASE WHEN s.o_orderpriority IS NOT NULL AND s.o_orderpriority NOT LIKE '4%' THEN s.o_orderpriority ELSE o.o_orderpriority END AS priority
  FROM orders o LEFT JOIN shell s ON s.target = o.o_orderkey WHERE o.o_orderkey NOT IN (SELECT o_orderkey FROM shell)),
c AS (SELECT CASE WHEN l_orderkey % 10 = 7 THEN l_orderkey - 1 ELSE l_orderkey END AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT id, amount, priority, coalesce(n, 0) AS n_lines FROM h LEFT JOIN c USING (id)
""")
def merge_shell(spark, sf_dir):
    """A new row's values over the old row's, its children re-parented, the empty shell dropped."""
    blank = F.startswith("o_orderpriority", F.lit("4"))
    heads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.when(~blank, F.col("o_orderpriority")).alias("priority"), F.col("o_orderpriority").alias("own"))
    moves = heads.where("id % 10 = 7").select(F.col("id").alias("shell"), (F.col("id") - 1).alias("target"))
    merged, children = absorb(heads, moves, "id", ["amount", "priority"], table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))
    counts = children.groupBy("id").agg(F.count("*").alias("n_lines"))
    return merged.join(counts, "id", "left").select("id", "amount", F.coalesce("priority", "own").alias("priority"), F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"))


#: Each month is a batch whose documents stand in some of these statuses.
_STATUSES = {
    0: "LOADED|POSTED|COMPLETED", 1: "POSTED|COMPLETED|EXCLUDED", 2: "COMPLETED|EXCLUDED|COMPLETED", 3: "EXCLUDED|EXCLUDED|EXCLUDED", 4: "READY TO LOAD|LOADED|REJECTED BY ACCOUNTS", 5: "READY TO LOAD|READY TO LOAD|DATA MISMATCH",
    6: "POSTED|POSTED|REJECTED BY ACCOUNTS", 7: "LOADED|DATA MISMATCH|PENDING IN SF", 8: "REJECTED BY ACCOUNTS|REJECTED BY ACCOUNTS|REJECTED BY ACCOUNTS", 9: "DUPLICATE|UNSUPPORTED|MANUALLY UPDATED", 10: "COMPLETED|NEW TEMPLATE|POSTED",
}
_BATCH_MONTH = "cast(year(o_orderdate) * 12 + month(o_orderdate) AS bigint)"
_STATUS = f"split_part(CASE {_BATCH_MONTH} % {len(_STATUSES)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _STATUSES.items()) + " END, '|', cast(o_orderkey % 3 + 1 AS int))"


@query(f"""
WITH t AS (SELECT {_BATCH_MONTH} AS m, {_STATUS} AS status FROM orders),
c AS (SELECT m, count(*) AS total, count(*) FILTER (status IN ('EXCLUDED', 'NEW TEMPLATE', 'DUPLICATE', 'DATA MISMATCH', 'PENDING IN SF', 'MANUALLY UPDATED', 'UNSUPPORTED')) AS u, count(*) FILTER (status = 'EXCLUDED') AS x,
  count(*) FILTER (status IN ('LOADED', 'REJECTED BY ACCOUNTS')) AS l, count(*) FILTER (status = 'POSTED') AS p, count(*) FILTER (status = 'COMPLETED') AS d FROM t GROUP BY m)
SELECT m AS batch, CASE WHEN x = total THEN 'EXCLUDED' WHEN d + x = total THEN 'COMPLETED' WHEN total > u AND l + p + d > 0 AND l + p + d = total - u THEN CASE WHEN l > 0 THEN 'LOADED' WHEN p > 0 THEN 'POSTED' ELSE 'COMPLETED' END
  WHEN m % 7 = 0 THEN 'DOWNLOADED' WHEN l + p + d > 0 THEN 'IN PROGRESS' WHEN m % 4 = 1 THEN 'DOWNLOADED' ELSE 'CREATED' END AS label, l + p + d > 0 AS locked FROM c
""")
def batch_tiers(spark, sf_dir):
    """Batch labels by all rules: excluded, completed, least advanced tier, re-included, locked, downloaded, created."""
    rows = table(spark, sf_dir, "orders").select(F.expr(_BATCH_MONTH).alias("batch"), F.expr(_STATUS).alias("status"))
    counts = rows.groupBy("batch").agg(*status_tallies("status"))
    label = tier_label(reincluded=F.col("batch") % 7 == 0, downloaded=F.col("batch") % 4 == 1)
    return counts.select("batch", label.alias("label"), (F.col("loaded") + F.col("posted") + F.col("completed") + F.col("rejected") > 0).alias("locked"))


@query("""
SELECT event_type AS bucket, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1
UNION ALL SELECT CASE WHEN json_extract_string(props, '$.k')::INTEGER < 50 THEN 'error: retry' ELSE 'error: final' END, count(*) FROM events WHERE event_type = 'error' GROUP BY 1
""")
def status_buckets(spark, sf_dir):
    """Counts by group, one group's count replaced by buckets of its own: one aggregate over the bucket's name."""
    retry = F.get_json_object("props", "$.k").cast("int") < 50
    bucket = F.when(F.col("event_type") != "error", F.col("event_type")).when(retry, "error: retry").otherwise("error: final")
    return table(spark, sf_dir, "events").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("""
SELECT user_id, CASE WHEN min(done) = 1 THEN 100 ELSE least(round(avg(part)), 99)::INTEGER END AS percent FROM (
  SELECT u.user_id, t.event_type, least(100, 5 * count(e.event_id)) AS part, (count(e.event_id) >= 20)::INTEGER AS done
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['signup', 'view', 'click', 'purchase']) AS event_type) t LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t.event_type GROUP BY 1, 2)
GROUP BY 1
""")
def progress_percent(spark, sf_dir):
    """Mean progress of the four segments, at most 99 until all are complete."""
    kinds = ("signup", "view", "click", "purchase")
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(*[count_if(F.col("event_type") == k).alias(k) for k in kinds])
    parts = [F.least(F.lit(100), 5 * F.col(k)) for k in kinds]
    whole = F.least(*[F.col(k) for k in kinds]) >= 20
    mean = F.least(F.round(sum(parts[1:], parts[0]) / len(kinds)), F.lit(99))
    return counts.select("user_id", F.when(whole, 100).otherwise(mean.cast("int")).alias("percent"))


ROLES = {"created": 97, "loaded": 89, "posted": 83, "completed": 79, "excluded": 73, "updated": 71}


@query("SELECT o_orderkey, " + ", ".join(f"{r}.s_name AS {r}_by" for r in ROLES) + " FROM orders " + " ".join(f"LEFT JOIN supplier {r} ON {r}.s_suppkey = o_orderkey % {m}" for r, m in ROLES.items()) + " WHERE o_orderstatus = 'P'")
def role_users(spark, sf_dir):
    """One dimension in six roles; each join is size-checked."""
    users = table(spark, sf_dir, "supplier")
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    for role, m in ROLES.items():
        rows = rows.withColumn("k", F.col("o_orderkey") % m).join(users.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias(f"{role}_by")), "k", "left").drop("k")
    return rows


@query("""
WITH r AS (SELECT o_custkey AS no, o_orderkey AS id, strftime(o_orderdate, '%Y%m') AS batch FROM orders)
SELECT a.no, a.id, min(b.id) AS partner FROM r a JOIN r b ON a.no = b.no AND a.id <> b.id AND a.batch <> b.batch GROUP BY 1, 2
""")
def collision_partner(spark, sf_dir):
    """For each row whose number also stands in another batch, the first such row: no pairs are made.

    The least row of a number, or the least of another batch than that one's, is everyone's partner.
    """
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("no"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyyMM").alias("batch"))
    first = rows.groupBy("no").agg(F.min(F.struct("id", "batch")).alias("a"))
    second = rows.join(first, "no").where("batch <> a.batch").groupBy("no").agg(F.first("a").alias("a"), F.min("id").alias("b"))
    found = rows.join(second, "no").withColumn("partner", F.when(F.col("batch") == F.col("a.batch"), F.col("b")).otherwise(F.col("a.id")))
    return found.select("no", "id", "partner")


@query("SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, json_extract_string(props, '$.colour') AS colour FROM events WHERE event_type = 'signup'")
def user_columns(spark, sf_dir):
    """User-defined columns kept in a map, shown as typed columns; unknown ones are null."""
    attrs = F.from_json("props", "map<string,string>")
    rows = table(spark, sf_dir, "events").where("event_type = 'signup'").withColumn("attrs", attrs)
    return rows.select("event_id", F.try_element_at("attrs", F.lit("k")).cast("int").alias("k"), F.try_element_at("attrs", F.lit("colour")).alias("colour"))


@query("SELECT doc_id, source || '/' || doc_id || '.txt' AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unprocessed_files(spark, sf_dir):
    """Files that no record mentions, with their path."""
    done = table(spark, sf_dir, "labels").select("doc_id")
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return files.join(done, "doc_id", "left_anti")


@query("SELECT o_orderkey, NULL::VARCHAR AS remark FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def missing_table(spark, sf_dir):
    """A table that isn't there yet reads as an empty one of its type."""
    remarks = table_or_empty(spark, sf_dir, "remarks", "o_orderkey long, remark string")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select("o_orderkey").join(remarks, "o_orderkey", "left")


@query("SELECT n_nationkey, n_name AS nation_name, NULL::VARCHAR AS remark FROM nation")
def evolve_columns(spark, sf_dir):
    """Columns added, renamed and dropped, each step only where it isn't done yet; done twice here."""
    steps = {"add": {"remark": "string"}, "rename": {"n_name": "nation_name"}, "drop": ["n_regionkey"]}
    return evolve(evolve(table(spark, sf_dir, "nation"), **steps), **steps)


@query("""
SELECT p_brand, p_name FROM part WHERE p_brand LIKE 'Brand#1_' AND p_name LIKE 're%' GROUP BY ALL
""")
def prefix_match(spark, sf_dir):
    """Values by a literal prefix; signs that patterns give a meaning have none here."""
    part = table(spark, sf_dir, "part")
    return part.where(F.startswith("p_brand", F.lit("Brand#1")) & (F.length("p_brand") == 8) & F.startswith("p_name", F.lit("re"))).select("p_brand", "p_name").distinct()


@query("""
SELECT p_type, p_name, (count(*) FILTER (ends_with(p_brand, '7')))::BIGINT AS sevens FROM part WHERE ends_with(p_name, 'et') AND NOT ends_with(p_brand, '_') GROUP BY 1, 2
""")
def suffix_names(spark, sf_dir):
    """Names with a wanted ending, and how many of their brands end in seven; endings are literal."""
    rows = table(spark, sf_dir, "part").where(F.endswith("p_name", F.lit("et")) & ~F.endswith("p_brand", F.lit("_")))
    return rows.groupBy("p_type", "p_name").agg(count_if(F.endswith("p_brand", F.lit("7"))).alias("sevens"))


@query("""
SELECT kind, doc_id, rank() OVER (PARTITION BY kind ORDER BY size, path, doc_id) AS turn FROM (
  SELECT doc_id, CASE WHEN contains(text, '|') THEN 1 WHEN n_chars < 500 THEN 2 ELSE 3 END AS kind, n_chars AS size, source AS path FROM documents)
""")
def work_order(spark, sf_dir):
    """The turn of each file within its kind, smaller ones first, then by path."""
    kind = F.when(F.contains("text", F.lit("|")), 1).when(F.col("n_chars") < 500, 2).otherwise(3)
    files = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.col("n_chars").alias("size"), F.col("source").alias("path"))
    return win.turns(files, "kind", ["size", "path"], "doc_id", "turn").select("kind", "doc_id", "turn")


@query(r"SELECT page_id, CASE WHEN length(trim(regexp_replace(regexp_extract(html, '(?s)<p>(.*?)</p>', 1), '<[^>]*>', '', 'g'))) >= 20 THEN 'text' ELSE 'other' END AS origin FROM pages")
def page_source(spark, sf_dir):
    """Whether a page's own text layer is used: it has one of some length."""
    layer = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?s)<p>(.*?)</p>", 1), "<[^>]*>", ""))
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.length(layer) >= 20, "text").otherwise("other").alias("origin"))


# Amounts


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax = 0 THEN '' ELSE printf('%.2f', l_extendedprice) END AS money, CASE WHEN igst > 0 AND igst <= 40 THEN igst WHEN half + half > 0 AND half + half <= 40 THEN half + half END AS rate
FROM (SELECT *, CASE WHEN l_partkey % 3 = 0 THEN round(l_tax * 100) WHEN l_partkey % 3 = 1 THEN 0.0 ELSE 90.0 END AS igst, round(l_tax * 100) * (1 + l_suppkey % 4) AS half FROM lineitem) WHERE l_returnflag = 'R'
""")
def money_and_rate(spark, sf_dir):
    """Amounts as text with two decimals, blank where there is none; the rate in (0, 40], whole tax or both halves."""
    third, tax = F.col("l_partkey") % 3, F.round(F.col("l_tax") * 100)
    igst = F.when(third == 0, tax).when(third == 1, 0.0).otherwise(90.0)
    half = tax * (1 + F.col("l_suppkey") % 4)
    plausible = lambda x: F.when((x > 0) & (x <= 40), x)
    text = F.when(F.col("l_tax") == 0, "").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("money"), F.coalesce(plausible(igst), plausible(half + half)).alias("rate"))


#: Half slabs in percent and the full ones.
FULL_SLAB = {2.5: 5.0, 6.0: 12.0, 9.0: 18.0, 14.0: 28.0}


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, rate, CASE WHEN s_nationkey % 5 = c_nationkey % 5 THEN CASE rate WHEN 2.5 THEN 5.0 WHEN 6 THEN 12.0 WHEN 9 THEN 18.0 WHEN 14 THEN 28.0 ELSE rate END ELSE rate END AS slab FROM (
  SELECT *, [2.5, 6.0, 9.0, 14.0, 18.0][(l_partkey % 5) + 1]::DOUBLE AS rate FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_linestatus = 'F')
""")
def slab_by_state(spark, sf_dir):
    """Half slabs become full ones where both parties are in one state."""
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = lines.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    buyers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rate = F.element_at(F.array(*map(F.lit, (2.5, 6.0, 9.0, 14.0, 18.0))), (F.col("l_partkey") % 5 + 1).cast("int"))
    full = F.create_map(*(F.lit(x) for pair in FULL_SLAB.items() for x in pair))
    same = F.col("s_nationkey") % 5 == F.col("c_nationkey") % 5
    rows = rows.join(buyers, "l_orderkey").withColumn("rate", rate)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rate", F.when(same, F.coalesce(F.try_element_at(full, F.col("rate")), "rate")).otherwise(F.col("rate")).alias("slab"))


# Keys and fields that come again


@query("""
WITH new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS old_key, o_custkey + 100000 AS new_key, o_orderpriority AS v FROM orders WHERE o_orderstatus = 'P'),
u AS (SELECT coalesce(old_key, new_key) AS key, max(o_orderkey) AS newest, arg_max(v, o_orderkey) AS v FROM new GROUP BY 1)
SELECT coalesce(c_custkey, key) AS key, coalesce(v, c_mktsegment) AS value, c_custkey IS NULL AS inserted, newest IS NOT NULL AS touched FROM customer FULL JOIN u ON key = c_custkey
""")
def upsert_old_or_new(spark, sf_dir):
    """Rows written under the key they had, or under a new one; the last write of a key wins."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    key = F.coalesce(F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey")), F.col("o_custkey") + 100000)
    new = orders.groupBy(key.alias("key")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("v"))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("old"), F.lit(True).alias("there"))
    joined = old.join(new, "key", "full")
    return joined.select("key", F.coalesce("v", "old").alias("value"), F.col("there").isNull().alias("inserted"), F.col("v").isNotNull().alias("touched"))


@query(f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS pos FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS pos FROM lineitem WHERE l_returnflag = 'A')
SELECT o.l_orderkey, o.pos, coalesce(n.l_suppkey, o.l_suppkey) AS code, CASE WHEN n.l_tax > 0 THEN n.l_tax ELSE o.l_tax END AS rate, o.l_quantity AS quantity FROM o LEFT JOIN n ON n.l_orderkey = o.l_orderkey AND n.pos = o.pos
""")
def resync_fields(spark, sf_dir):
    """Several fields patched by position, those of the service's lineage only; blanks never overwrite."""
    fields = {"code": ("l_suppkey", "Service"), "rate": ("l_tax", "Service"), "quantity": ("l_quantity", "PDF")}
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    lines = table(spark, sf_dir, "lineitem")
    old = lines.where("l_returnflag = 'R'").select("l_orderkey", place.alias("pos"), *[F.col(c).alias(n) for n, (c, _) in fields.items()])
    given = {n: F.when(F.col(c) > 0, F.col(c)) if n == "rate" else F.col(c) for n, (c, lineage) in fields.items() if lineage == "Service"}
    new = lines.where("l_returnflag = 'A'").select("l_orderkey", place.alias("pos"), *[v.alias(f"new_{n}") for n, v in given.items()])
    shown = [F.coalesce(f"new_{n}", n).alias(n) if n in given else F.col(n) for n in fields]
    return old.join(new, ["l_orderkey", "pos"], "left").select("l_orderkey", F.col("pos").cast("long").alias("pos"), *shown)


#: An address line as pages print it: in full, without its end, in other signs, or another one.
_LINE = "CASE event_id % 5 WHEN 0 THEN 'No. ' || (event_id % 3) || ', Main Road, Chennai' WHEN 1 THEN 'no ' || (event_id % 3) || ' main road' WHEN 2 THEN 'Chennai,' WHEN 3 THEN '--' ELSE 'Ward ' || (event_id % 7) END"
_SIGNS = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"


@query(f"""
WITH e AS (SELECT user_id, event_type, ts, event_id, json_extract_string(props, '$.k') AS k, {_LINE} AS line FROM events),
f AS (SELECT user_id, arg_min(k, (ts, event_id)) AS first_k FROM e GROUP BY 1),
v AS (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS seen FROM e GROUP BY 1, 2), m AS (SELECT user_id, arg_min(event_type, (-n, seen)) AS voted FROM v GROUP BY 1),
s AS (SELECT user_id, line, min((ts, event_id)) AS seen FROM e WHERE event_type <> 'click' GROUP BY 1, 2), l AS (SELECT user_id, list([line] ORDER BY seen) AS lines FROM s GROUP BY 1),
d AS (SELECT user_id, array_to_string(list_reduce(lines, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: contains(y, x[1]) OR ({_SIGNS.format('x[1]')} <> '' AND contains({_SIGNS.format('y')}, {_SIGNS.format('x[1]')})))) > 0 THEN kept ELSE kept || x END), ' | ') AS appended FROM l)
SELECT f.user_id, first_k, voted, coalesce(appended, '') AS appended FROM f JOIN m USING (user_id) LEFT JOIN d USING (user_id)
""")
def merge_fields(spark, sf_dir):
    """Fields of several pages in one: the first one's value, the most frequent one, or all in order that aren't held in
    one that is kept already, signs aside."""
    ship_package(spark)
    at = F.struct("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", at.alias("at"), F.get_json_object("props", "$.k").alias("k"), F.expr(_LINE).alias("line"))
    first = rows.groupBy("user_id").agg(F.min_by("k", "at").alias("first_k"))
    counts = rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("at").alias("seen"))
    voted = counts.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "seen")).alias("voted"))
    appended = fold_contained(rows.where("event_type <> 'click'"), "user_id", "line", "at", "appended")
    shown = F.coalesce(F.array_join("appended", " | "), F.lit("")).alias("appended")
    return first.join(voted, "user_id").join(appended, "user_id", "left").select("user_id", "first_k", "voted", shown)


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT, event_id) AS rn FROM events),
k AS (SELECT user_id, event_id, rn, t AS begun, 1::BIGINT AS grp FROM e WHERE rn = 1
  UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.t - k.begun > 21600 THEN e.t ELSE k.begun END, k.grp + (e.t - k.begun > 21600)::BIGINT FROM k JOIN e ON e.user_id = k.user_id AND e.rn = k.rn + 1)
SELECT user_id, event_id, grp FROM k
""")
def row_groups(spark, sf_dir):
    """Groups whose members are near their group's first one: sequential, so rows stream through in order."""
    ship_package(spark)
    rows = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    return groups_from_first(rows, "user_id", "at", "event_id", 21600, "grp").select("user_id", "event_id", "grp")
