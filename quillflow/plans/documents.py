"""Documents to invoices to items by table functions, and learned formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillflow.functions import money, tables
from quillflow.functions.text import let
from quillflow.operators import formats, joins, rules
from quillflow.operators.merge import save_with_children
from quillflow.operators.window import global_row_number
from quillflow.plans.registry import query
from quillflow.session import ship_package
from quillflow.sources.tables import profile, table


@query("""
SELECT user_id AS document, segment::INTEGER AS invoice, arg_min(v, (ts, event_id)) FILTER (v IS NOT NULL) AS number, arg_min(event_id, (ts, event_id)) AS first_page, arg_max(event_id, (ts, event_id)) AS last_page, count(*)::INTEGER AS n_pages FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT + 1 AS segment FROM (
    SELECT *, CASE WHEN v IS NOT NULL AND p IS NOT NULL AND v <> p THEN 1 ELSE 0 END AS new FROM (
      SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM (
        SELECT *, nullif(event_type, 'error') AS v FROM events)))) GROUP BY user_id, segment
""")
def document_invoices(spark, sf_dir):
    """The invoices of each document's pages, by a table function over partitions; as `page_segments` by windows."""
    tables.register(spark)
    pages = table(spark, sf_dir, "events").select(F.col("user_id").alias("document"), F.col("event_id").alias("page"), F.nullif("event_type", F.lit("error")).alias("number"), "ts")
    return spark.sql("SELECT * FROM invoices(TABLE({pages}) PARTITION BY document ORDER BY (ts, page))", pages=pages)


_ITEM = "l_linenumber || ') part ' || l_partkey || '   ' || cast(l_quantity AS bigint) || ' x ' || cast(cast(l_extendedprice AS decimal(18, 2)) AS string)"
_MORE = "CASE WHEN l_linenumber % 2 = 0 THEN chr(10) || '   colour ' || l_returnflag || ' ' ELSE '' END"


@query("""
SELECT l_orderkey, (10000 * row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate))::INTEGER AS line_no,
  'part ' || l_partkey || CASE WHEN l_linenumber % 2 = 0 THEN ' colour ' || l_returnflag ELSE '' END AS description, l_quantity::BIGINT AS quantity, l_extendedprice::DECIMAL(18, 2) AS rate, (l_quantity::BIGINT * l_extendedprice::DECIMAL(18, 2))::DECIMAL(18, 2) AS amount
FROM lineitem
""")
def invoice_items(spark, sf_dir):
    """The items of each invoice's text, by a table function in a lateral join."""
    tables.register(spark)
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", F.expr(f"{_ITEM} || {_MORE}").alias("text"))
    texts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["text"]), "\n").alias("text"))  # bounded by an order's lines
    texts = texts.select("l_orderkey", F.concat(F.lit("Sl Description Qty x Rate\nno item 5 x\n"), "text").alias("text"))
    return spark.sql("SELECT d.l_orderkey, i.* FROM {texts} d, LATERAL items(d.text) i", texts=texts)


_SAMPLES = """
u AS (SELECT user_id AS id, CASE WHEN user_id % 4 = 0 THEN 'T' || (user_id % 48) END AS tax_id, CASE WHEN user_id % 4 < 3 THEN 'Seller ' || (user_id % 25) END AS seller, list_sort(list(DISTINCT hour(ts)::VARCHAR) FILTER (user_id % 3 > 0 OR hour(ts) < 20)) AS fields FROM events GROUP BY 1),
f AS (SELECT row_number() OVER (ORDER BY id) AS no, * FROM u WHERE id % 5 = 0),
s AS (SELECT *, coalesce('t:' || tax_id, 's:' || regexp_replace(lower(seller), '[^a-z0-9]+', '', 'g'), 'l:' || array_to_string(fields, '|')) AS key, 'file' || lpad(id::VARCHAR, 6, '0') AS source FROM u WHERE id % 5 <> 0),
g AS (SELECT key, arg_min(tax_id, source) FILTER (tax_id IS NOT NULL) AS tax_id, arg_min(seller, source) FILTER (seller IS NOT NULL) AS seller, list_sort(list_distinct(flatten(list(fields)))) AS fields, count(*) AS n FROM s GROUP BY key),
t AS (SELECT key, (SELECT min(no) FROM f WHERE 't:' || f.tax_id = key) AS no FROM g WHERE key LIKE 't:%'),
keyed AS (SELECT 's:' || regexp_replace(lower(seller), '[^a-z0-9]+', '', 'g') AS key, 0 AS late, no, '' AS k FROM f WHERE seller IS NOT NULL
  UNION ALL SELECT 's:' || regexp_replace(lower(g.seller), '[^a-z0-9]+', '', 'g'), 1, NULL, key FROM t JOIN g USING (key) WHERE no IS NULL AND seller IS NOT NULL),
names AS (SELECT key, arg_min(struct_pack(no := no, k := k), (late, coalesce(no, 0), k)) AS m FROM keyed GROUP BY key),
l AS (SELECT key, arg_min(no, (-score, no)) AS no FROM (SELECT g.key, f.no, len(list_intersect(g.fields, f.fields)) / len(list_distinct(g.fields || f.fields)) AS score FROM g, f WHERE g.key LIKE 'l:%' AND len(f.fields) > 0) WHERE score >= 0.9 - 1e-12 GROUP BY key),
met AS (SELECT key, no, CASE WHEN no IS NULL THEN key END AS own FROM t UNION ALL SELECT g.key, m.no, CASE WHEN m.no IS NULL THEN coalesce(m.k, g.key) END FROM g LEFT JOIN names USING (key) WHERE g.key LIKE 's:%' UNION ALL SELECT g.key, no, CASE WHEN no IS NULL THEN g.key END FROM g LEFT JOIN l USING (key) WHERE g.key LIKE 'l:%'),
new AS (SELECT own, row_number() OVER (ORDER BY own) + (SELECT max(no) FROM f) AS no FROM (SELECT DISTINCT own FROM met WHERE own IS NOT NULL)),
parts AS (SELECT no, '' AS key, tax_id, seller, fields, 1 AS n FROM f UNION ALL SELECT coalesce(met.no, new.no), key, tax_id, seller, fields, n FROM g JOIN met USING (key) LEFT JOIN new USING (own))
"""


@query(f"""
WITH {_SAMPLES}
SELECT 'format' || no AS name, arg_min(tax_id, key) FILTER (tax_id IS NOT NULL) AS tax_id, arg_min(seller, key) FILTER (seller IS NOT NULL) AS seller, array_to_string(list_sort(list_distinct(flatten(list(fields)))), '|') AS fields, sum(n)::BIGINT AS n_sources FROM parts GROUP BY no
""")
def formats_learned(spark, sf_dir):
    """Known formats after a batch of samples: merged by tax id, seller or layout, or new."""
    ship_package(spark)
    shown = (F.col("user_id") % 3 > 0) | (F.hour("ts") < 20)
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(shown, F.hour("ts").cast("string")))).alias("fields"))  # at most 24
    users = users.select(
        "user_id", F.expr("CASE WHEN user_id % 4 = 0 THEN 'T' || (user_id % 48) END").alias("tax_id"), F.expr("CASE WHEN user_id % 4 < 3 THEN 'Seller ' || (user_id % 25) END").alias("seller"), "fields",
        F.concat(F.lit("file"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("source"),
    )
    known = global_row_number(users.where("user_id % 5 = 0"), "user_id", "no").select(F.concat(F.lit("format"), F.col("no").cast("string")).alias("name"), "tax_id", "seller", "fields", F.array("source").alias("sources"))
    learned, _ = formats.learn(known, users.where("user_id % 5 <> 0"))
    return learned.select("name", "tax_id", "seller", F.array_join("fields", "|").alias("fields"), F.size("sources").cast("long").alias("n_sources"))


_AMOUNT = "cast(cast(l_extendedprice * l_tax AS decimal(18, 2)) AS string)"
_RATE = "cast(cast(l_tax * 100 AS int) AS string)"
#: What an invoice's text says of its tax, each line in one of several forms.
TAXED = f"""CASE l_partkey % 10 WHEN 0 THEN 'Goods 18% extra' || chr(10) || 'Output IGST @' || {_RATE} || '%  ' || {_RATE} || ' %  ' || {_AMOUNT} WHEN 1 THEN 'CGST ' || {_RATE} || '% 10.00' || chr(10) || 'SGST ' || {_RATE} || ' % 1,' || lpad({_AMOUNT}, 6, '0')
  WHEN 2 THEN 'sgst 45%' || chr(10) || 'SGST again ' || {_RATE} || '.5% ' || {_AMOUNT} WHEN 3 THEN {_RATE} || '% 12.00 ' || {_RATE} || ' %  3,000.50' || chr(10) || 'Gst in all 5% 9.99' WHEN 4 THEN 'GST ' || {_RATE} || '%' || chr(10) || 'Total Tax Amount: ' || {_AMOUNT}
  WHEN 5 THEN 'igst 0% 0.00' || chr(10) || 'cgst @9% of 100.00 9.00' WHEN 6 THEN 'IGST nil' || chr(10) || 'igst ' || {_RATE} || '% ' || {_AMOUNT} || ' ' || chr(10) || 'IGST 28% 1.00' WHEN 7 THEN '50% 1.00 50% 1.00' || chr(10) || '6% 1.00 6% 1.00' WHEN 8 THEN 'no tax here' END"""

#: The same with the amount's cents rounded as SQL's cast does it: the double's hundredfold, half away from zero, not its decimal digits.
_TAXED_NOTE = TAXED.replace(_AMOUNT, "cast(cast(cast(round(l_extendedprice * l_tax * 100) AS decimal(20, 0)) / 100 AS decimal(18, 2)) AS string)")


def _kinds(table_: str, *rest: str) -> str:
    near = lambda k: f"nullif(list_filter({table_}, lambda x: contains(x.low, '{k}'))[1].value, 0)"
    return f"coalesce({near('igst')}, {near('cgst')} + {near('sgst')}, {near('cgst')}, {near('sgst')}, " + ", ".join(r if "(" in r else near(r) for r in rest) + ")"


@query(rf"""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {TAXED} AS note FROM lineitem WHERE l_returnflag = 'R'),
l AS (SELECT *, list_transform(string_split(note, chr(10)), lambda x: {{'low': lower(x), 'rate': try_cast(regexp_extract(x, '(\d{{1,2}}(?:\.\d+)?)\s*%', 1) AS DOUBLE), 'amount': try_cast(replace(regexp_extract_all(x, '[\d,]+\.\d{{2}}')[-1], ',', '') AS DOUBLE)}}) AS ls,
  regexp_extract_all(note, '(\d{{1,2}}(?:\.\d+)?)\s*%\s+[\d,]+\.\d{{2}}\s+(\d{{1,2}}(?:\.\d+)?)\s*%\s+[\d,]+\.\d{{2}}', 1) AS one, regexp_extract_all(note, '(\d{{1,2}}(?:\.\d+)?)\s*%\s+[\d,]+\.\d{{2}}\s+(\d{{1,2}}(?:\.\d+)?)\s*%\s+[\d,]+\.\d{{2}}', 2) AS two FROM t),
v AS (SELECT *, list_transform(list_filter(ls, lambda x: x.rate > 0 AND x.rate <= 40), lambda x: {{'low': x.low, 'value': x.rate}}) AS rates, list_transform(list_filter(ls, lambda x: x.amount IS NOT NULL), lambda x: {{'low': x.low, 'value': x.amount}}) AS amounts,
  list_filter(list_transform(range(1, len(one) + 1), lambda i: CASE WHEN one[i]::DOUBLE = two[i]::DOUBLE AND 2 * one[i]::DOUBLE > 0 AND 2 * one[i]::DOUBLE <= 40 THEN 2 * one[i]::DOUBLE END), lambda x: x IS NOT NULL) AS halves FROM l)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_kinds('rates', '(halves[1])', 'gst')} AS rate, {_kinds('amounts', 'gst', 'total tax amount')} AS amount FROM v
""")
def tax_near_keyword(spark, sf_dir):
    """The tax rate and amount that an invoice's lines name beside each tax."""
    note = F.expr(_TAXED_NOTE)
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money.tax_rate_near(note).alias("rate"), money.tax_amount_near(note).alias("amount"))


#: A file's path of three to six parts, and the folders that have templates, on several levels.
_PATH = "'E' || (page_id % 3) || CASE WHEN page_id % 2 = 0 THEN '/PART' ELSE chr(92) || 'SERVICE' END || CASE WHEN page_id % 11 = 0 THEN '' ELSE '/n' || (page_id % 7) END || CASE WHEN page_id % 5 < 2 THEN '//deep' || (page_id % 4) ELSE '' END || CASE WHEN page_id % 13 < 3 THEN '/more' ELSE '' END || '/f' || page_id || '.pdf'"
_KEY = "'E' || (p_partkey % 3) || CASE WHEN p_partkey % 2 = 0 THEN '/PART' ELSE '/SERVICE' END || CASE WHEN p_partkey % 6 = 1 THEN '' ELSE '/n' || (p_partkey % 7) END || CASE WHEN p_partkey % 4 = 2 THEN '/deep' || (p_partkey % 4) ELSE '' END || CASE WHEN p_partkey % 9 = 2 THEN '/more' ELSE '' END"


@query(rf"""
WITH f AS (SELECT page_id, list_filter(string_split(replace({_PATH}, chr(92), '/'), '/'), lambda x: x <> '') AS ps FROM pages),
g AS (SELECT page_id, CASE WHEN len(ps) >= 4 THEN ps[:-2] END AS ps FROM f),
k AS (SELECT key FROM (SELECT {_KEY} AS key, p_size % 3 > 0 AS active FROM part) GROUP BY key HAVING bool_or(active)),
a AS (SELECT list(key) AS ks FROM k),
m AS (SELECT page_id, array_to_string(ps, '/') AS folder, list_filter(list_transform(range(len(ps), 1, -1), lambda n: array_to_string(ps[:n], '/')), lambda x: list_contains(ks, x)) AS found FROM g, a)
SELECT page_id, folder, CASE WHEN found[1] = folder THEN folder END AS exact, found[1] AS nearest FROM m
""")
def path_templates(spark, sf_dir):
    """The active template of each file's folder, and of the nearest folder above that has one."""
    files = table(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"))
    known = table(spark, sf_dir, "part").select(F.expr(_KEY).alias("key"), F.expr("p_size % 3 > 0").alias("active"))
    return joins.template_for_path(files, "page_id", "path", known)


_ORDER_NO = "CASE o_orderkey % 3 WHEN 0 THEN 'SPRPUR/' || o_orderkey WHEN 1 THEN '5prpur' || o_orderkey END"


@query(f"""
WITH h AS (SELECT o_orderkey, 'Invoice' AS type, 'D' || o_orderkey AS number, coalesce(regexp_replace({_ORDER_NO}, '(?i)^[S5]PRPUR/?', ''), '') AS ord FROM orders WHERE o_orderstatus = 'P'),
l AS (SELECT h.*, (l_linenumber * 10000)::VARCHAR AS line, CASE WHEN l_tax >= 0.08 THEN 'Charge (Item)' END AS charge, l_quantity::BIGINT AS units FROM h JOIN lineitem ON l_orderkey = o_orderkey),
c AS (SELECT o_orderkey, 'Purchase Header' AS sheet, unnest([{{'col': 'Document Type', 'value': type}}, {{'col': 'No.', 'value': number}}, {{'col': 'Consignment Note No.', 'value': ord}}]) AS c, 1 AS n FROM h
  UNION ALL SELECT o_orderkey, 'Purchase Line', unnest([{{'col': 'Document Type', 'value': type}}, {{'col': 'Document No.', 'value': number}}, {{'col': 'Line No.', 'value': line}}, {{'col': 'Type', 'value': charge}}]), 1 FROM l
  UNION ALL SELECT o_orderkey, 'Reservation Entry', unnest([{{'col': 'Source Type', 'value': '39'}}, {{'col': 'Source Subtype', 'value': '1'}}, {{'col': 'Source ID', 'value': number}}, {{'col': 'Source Ref. No.', 'value': line}}, {{'col': 'Quantity', 'value': '1'}}, {{'col': 'Quantity (Base)', 'value': '1'}}]), units FROM l)
SELECT o_orderkey, sheet, c.col AS col, c.value AS value, sum(n)::BIGINT AS n FROM c WHERE c.value IS NOT NULL GROUP BY ALL
""")
def link_keys(spark, sf_dir):
    """The keys that tie headers, lines and reservations (one a unit), with how many rows of its sheet hold each.

    A key stands in one order, so each order's cells are counted within its own row; they aren't grouped again.
    """
    heads = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy("o_orderkey").agg(F.count("*").alias("copies"))
    line = F.struct((F.col("l_linenumber") * 10000).cast("string").alias("line"), F.when(F.col("l_tax") >= 0.08, "Charge (Item)").alias("charge"), F.col("l_quantity").cast("long").alias("units"))
    lines = heads.join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(
        F.first("copies").alias("copies"), F.collect_list(F.when(F.col("l_orderkey").isNotNull(), line)).alias("lines"))  # bounded by an order's lines
    orders = lines.select("o_orderkey", "copies", "lines", F.lit("Invoice").alias("type"), F.expr("'D' || o_orderkey").alias("number"), F.expr(_ORDER_NO).alias("ord"))
    none = F.lit(None).cast("string")

    def cells(sheet, number, charge, rows):
        found = rules.linked_cells(sheet, F.col("type"), F.col("number"), F.col("ord"), number, charge)
        return F.transform(found, lambda c: F.struct(c.alias("key"), rows.alias("n")))

    def counted(sheet, every):
        def one(held, key):
            n = F.aggregate(F.filter(held, lambda c: c["key"] == key), F.lit(None).cast("long"), lambda n, c: F.coalesce(n + c["n"], n, c["n"]))
            return F.struct(F.lit(sheet).alias("sheet"), key["col"].alias("col"), key["value"].alias("value"), n.alias("n"))

        return let(every, lambda held: F.transform(F.array_distinct(F.transform(held, lambda c: c["key"])), lambda key: one(held, key)))

    of_lines = lambda sheet, n: F.flatten(F.transform("lines", lambda x: cells(sheet, x["line"], x["charge"], n(x))))
    copies = F.col("copies")
    sheets = (
        counted("Purchase Header", cells("Purchase Header", none, none, copies)), counted("Purchase Line", of_lines("Purchase Line", lambda x: copies)),
        counted("Reservation Entry", of_lines("Reservation Entry", lambda x: x["units"] * copies)),
    )
    return orders.select("o_orderkey", F.inline(F.concat(*sheets)))


_HEADS = "SELECT c_custkey AS id, c_custkey AS key, c_mktsegment AS name, c_custkey % 5 > 0 AS active FROM customer"
_KIDS = "SELECT o_custkey AS id, o_orderpriority AS col, max(o_orderkey)::VARCHAR AS value, max(o_orderkey) % 3 > 0 AS active FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2"


@query(f"""
WITH h AS ({_HEADS}), k AS ({_KIDS}),
p AS (SELECT o_custkey, CASE WHEN o_custkey % 4 = 0 THEN o_custkey END AS old_key, CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1000000 END AS key, o_orderkey, o_orderpriority AS col FROM orders WHERE o_orderstatus = 'P'),
s AS (SELECT key, max(old_key) AS old_key, 'saved ' || max(o_orderkey) AS name FROM p GROUP BY key),
v AS (SELECT key, col, CASE WHEN max(o_orderkey) % 2 = 0 THEN max(o_orderkey)::VARCHAR END AS value FROM p GROUP BY key, col),
f AS (SELECT s.*, h.id AS found FROM s LEFT JOIN h ON h.key = coalesce(s.old_key, s.key)),
n AS (SELECT key, row_number() OVER (ORDER BY key) + (SELECT max(id) FROM h) AS id FROM f WHERE found IS NULL),
t AS (SELECT f.key, f.name, coalesce(found, n.id) AS id FROM f LEFT JOIN n ON n.key = f.key),
g AS (SELECT t.id, v.col, v.value FROM v JOIN t ON t.key = v.key),
m AS (SELECT coalesce(k.id, g.id) AS id, coalesce(k.col, g.col) AS col, k.value AS old, k.active, g.value AS new, g.id IS NOT NULL AS given, k.id IS NOT NULL AS stood FROM k FULL JOIN g ON g.id = k.id AND g.col = k.col),
a AS (SELECT m.*, CASE WHEN given AND NOT stood THEN 'inserted' WHEN given AND (coalesce(old, '') <> coalesce(new, '') OR NOT active) THEN 'updated' WHEN NOT given AND t.id IS NOT NULL AND active THEN 'deactivated' ELSE 'kept' END AS action FROM m LEFT JOIN t ON t.id = m.id)
SELECT a.id, coalesce(t.key, h.key) AS key, coalesce(t.name, h.name) AS name, a.col, CASE WHEN action IN ('inserted', 'updated') THEN new ELSE old END AS value, CASE WHEN action IN ('inserted', 'updated') THEN true WHEN action = 'deactivated' THEN false ELSE a.active END AS active, action
FROM a LEFT JOIN t ON t.id = a.id LEFT JOIN h ON h.id = a.id
""")
def save_templates(spark, sf_dir):
    """Templates saved under the key they had or a new one, with their values merged: updated, inserted, deactivated."""
    orders, big = table(spark, sf_dir, "orders"), F.max("o_orderkey")
    heads = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "c_custkey as key", "c_mktsegment as name", "c_custkey % 5 > 0 as active")
    kids = orders.where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("col")).agg(big.cast("string").alias("value"), (big % 3 > 0).alias("active"))
    parts = orders.where("o_orderstatus = 'P'").selectExpr("CASE WHEN o_custkey % 4 = 0 THEN o_custkey END AS old_key", "CASE WHEN o_custkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1000000 END AS key", "o_orderkey", "o_orderpriority AS col")
    saves = parts.groupBy("key").agg(F.max("old_key").alias("old_key"), F.concat(F.lit("saved "), big.cast("string")).alias("name"))
    values = parts.groupBy("key", "col").agg(F.when(big % 2 == 0, big.cast("string")).alias("value"))
    saved, children = save_with_children(heads, kids, saves, values)
    return children.join(saved.drop("active"), "id").select("id", "key", "name", "col", "value", "active", "action")


PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderpriority": "string"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS col, {k} AS position, '{_TYPES[c]}' AS type, count({c}) AS n_values, min({c})::VARCHAR AS least, max({c})::VARCHAR AS most FROM orders" for k, c in enumerate(PROFILED, 1)))
def column_profile(spark, sf_dir):
    """The catalogue's entry of each column with its values' number and ends, all from one scan."""
    return profile(table(spark, sf_dir, "orders").select(*PROFILED))


@query("""
SELECT CASE WHEN grouping(o_orderstatus) = 0 AND grouping(o_orderpriority) = 0 THEN 'both' WHEN grouping(o_orderstatus) = 0 THEN 'status' WHEN grouping(o_orderpriority) = 0 THEN 'priority' ELSE 'all' END AS result, o_orderstatus AS status, o_orderpriority AS priority,
  count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS amount FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())
""")
def result_sets(spark, sf_dir):
    """Four result sets of one call from one scan: by status and priority, by each, and in all."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    sets = orders.groupingSets([["status", "priority"], ["status"], ["priority"], []], "status", "priority")
    name = F.when((F.grouping("status") == 0) & (F.grouping("priority") == 0), "both").when(F.grouping("status") == 0, "status").when(F.grouping("priority") == 0, "priority").otherwise("all")
    found = sets.agg(name.alias("result"), F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))
    return found.select("result", "status", "priority", "n", "amount")
