"""Queries on codes and free text: order numbers, tax ids, vendor codes, addresses, labels, format matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillflow.functions import codes, dates, fuzzy
from quillflow.operators import joins as ops
from quillflow.operators.joins import best_overlap
from quillflow.plans.registry import query
from quillflow.session import ship_package
from quillflow.sources.tables import table

#: Texts with an order number of each form, in SQL that Spark and DuckDB both read.
_DATED = "year(o_orderdate) || '{0}' || lpad(cast(month(o_orderdate) AS string), 2, '0') || '{0}' || lpad(cast(day(o_orderdate) AS string), 2, '0')"
_DAY, _SERIAL = "lpad(cast(day(o_orderdate) AS string), 2, '0')", "lpad(cast(o_orderkey % 100000 AS string), 5, '0')"
NOTE = f"""CASE o_orderkey % 11 WHEN 0 THEN 'Buyer Order SPRPUR/' || {_DATED.format('/')} || '-' || {_SERIAL} || ' net 30'
  WHEN 1 THEN 'order no 5prpur / ' || {_DATED.format(' / ')} || ' -  ' || {_SERIAL} || '.'
  WHEN 2 THEN 'Order SPRPUR/' || {_DATED.format('/')} || '-' || {_SERIAL} || {_DAY} || '-Oct-26 by road'
  WHEN 3 THEN 'Ref SPRPUR/' || {_DATED.format('/')} || '-' || chr(10) || 'GSTIN:29LLZPS1935B1ZA     ' || {_SERIAL} || chr(10) || '99999'
  WHEN 4 THEN 'hand note SPRPUR/205/ann/20-8z' || (o_orderkey % 90 + 10) WHEN 5 THEN 'po SPRPUE/' || {_DATED.format('/')} || '-' || {_SERIAL} || ' ok' WHEN 6 THEN 'po SPRRUR-' || {_DATED.format('-')} || '-' || {_SERIAL}
  WHEN 7 THEN 'INV/2026/04/27-1234 and INVOICE/2026/04/27-1234 only' WHEN 8 THEN 'INVS/2026/04/27-1234 and sppur/' || {_DATED.format('/')} || '-' || {_SERIAL}
  WHEN 9 THEN 'no po written here' END"""
_GAPS = r"\s*/\s*"
_MISSPELT = rf"(?:^|[^A-Za-z0-9])(([A-Za-z0-9]{{4,8}})\s*[/\\-]\s*\d{{4}}\s*[/\\-]\s*\d{{2}}\s*[/\\-]\s*\d{{2}}\s*[-–]\s*\d{{4,6}})(?:[^0-9]|$)"
#: The longest common stretch of a and b as [length, -place in a, -place in b]; the earliest of equals.
_STRETCH = """list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: flatten(list_transform(range(1, length(b) + 1), lambda j:
  list_transform(range(1, least(length(a) - i, length(b) - j) + 2), lambda k: CASE WHEN substr(a, i, k) = substr(b, j, k) THEN [k, -i, -j] END))))))"""


@query(rf"""
WITH RECURSIVE n AS (SELECT o_orderkey, {NOTE} AS note FROM orders),
t AS (SELECT o_orderkey, note, regexp_extract(note, '(?i)([S5]PRPUR{_GAPS}\d{{4}}{_GAPS}\d{{2}}{_GAPS}(\d{{2}})\s*-\s*(\d{{4,6}}))((\d{{0,2}})-[A-Za-z]{{3}}-\d{{2}}\b)?', ['token', 'day', 'serial', 'tail', 'rest']) AS s,
  regexp_extract(note, '(?is)([S5]PRPUR{_GAPS}\d{{4}}{_GAPS}\d{{2}}{_GAPS}\d{{2}}\s*-)(.*)', ['head', 'after']) AS h,
  regexp_extract(note, '(?i)[S5]PRPUR{_GAPS}[A-Za-z0-9]{{1,6}}{_GAPS}[A-Za-z0-9]{{1,4}}{_GAPS}[A-Za-z0-9]{{1,4}}\s*-\s*[A-Za-z0-9]{{1,8}}') AS loose,
  regexp_extract_all(note, '{_MISSPELT}', 1) AS near, regexp_extract_all(note, '{_MISSPELT}', 2) AS words FROM n),
f AS (SELECT o_orderkey, CASE WHEN s.tail <> '' AND length(s.rest) < 2 AND 2 - length(s.rest) <= length(s.serial) - 4 AND right(s.serial, 2 - length(s.rest)) || s.rest = s.day
    THEN left(s.token, length(s.token) - 2 + length(s.rest)) ELSE s.token END AS strict,
  h.head || coalesce(nullif(regexp_extract(split_part(h.after, chr(10), 1), '^\s*(\d{{4,6}})\b', 1), ''), regexp_extract_all(split_part(h.after, chr(10), 2), '\d{{4,6}}')[-1]) AS anchored, loose, near, words FROM t),
p AS (SELECT DISTINCT upper(unnest(words)) AS w FROM t),
r AS (SELECT w, w AS a, 'SPRPUR' AS b FROM p
  UNION ALL SELECT w, side[1], side[2] FROM (SELECT w, unnest([[left(a, -m[2] - 1), left(b, -m[3] - 1)], [substr(a, m[1] - m[2]), substr(b, m[1] - m[3])]]) AS side FROM (SELECT w, a, b, {_STRETCH} AS m FROM r) WHERE m IS NOT NULL) WHERE side[1] <> '' AND side[2] <> ''),
likely AS (SELECT w FROM (SELECT w, {_STRETCH} AS m FROM r) GROUP BY w HAVING 2 * sum(m[1]) / (length(w) + 6) >= 0.6),
ok AS (SELECT list(w) AS ws FROM likely),
z AS (SELECT o_orderkey, nullif(strict, '') AS strict, nullif(anchored, '') AS anchored, nullif(loose, '') AS loose, near[list_position(list_transform(words, lambda x: list_contains(ws, upper(x))), true)] AS near FROM f, ok)
SELECT o_orderkey, upper(regexp_replace(coalesce(strict, anchored, loose, near, ''), '\s+', '', 'g')) AS value, CASE WHEN coalesce(strict, anchored) IS NOT NULL THEN 'confident' WHEN coalesce(loose, near) IS NOT NULL THEN 'doubtful' ELSE 'none' END AS confidence FROM z
""")
def order_number(spark, sf_dir):
    """The order number of a free text: whole, cut at its line's end, misread or misspelt, with its confidence."""
    ship_package(spark)
    return table(spark, sf_dir, "orders").select("o_orderkey", codes.order_number(F.expr(NOTE)).alias("f")).select("o_orderkey", "f.value", "f.confidence")


_CONSIGNMENT = f"CASE o_orderkey % 4 WHEN 0 THEN 'SPRPUR/' WHEN 1 THEN '5prpur' WHEN 2 THEN '55PRPUR/' ELSE '' END || {_DATED.format('/')} || '-' || {_SERIAL}"


@query(f"SELECT o_orderkey, regexp_replace({_CONSIGNMENT}, '(?i)^[S5]PRPUR/?', '') AS bare FROM orders")
def strip_prefix(spark, sf_dir):
    """Order numbers without their constant prefix; another one stays."""
    return table(spark, sf_dir, "orders").select("o_orderkey", codes.strip_prefix(F.expr(_CONSIGNMENT)).alias("bare"))


_CORE = "'AABCP' || lpad(cast(c_custkey % 10000 AS string), 4, '0') || 'C' || (c_custkey % 9 + 1)"
_STATE = "lpad(cast(c_custkey % 37 + 1 AS string), 2, '0')"
TAX = f"""CASE c_custkey % 6 WHEN 0 THEN 'GSTIN: ' || {_STATE} || {_CORE} || 'Z' || (c_custkey % 10) || ' INVOICE' WHEN 1 THEN 'GSTIN: ' || {_STATE} || {_CORE} || '2C. India' WHEN 2 THEN 'GSTIN/UIN  ' || {_CORE} || 'ZZ ' || {_STATE}
  WHEN 3 THEN 'gstin ' || {_STATE} || ' ' || {_CORE} || ' 2K' WHEN 4 THEN 'uin ' || {_CORE} || '2A none' ELSE 'GSTIN: not registered 12' END"""


@query(rf"""
WITH t AS (SELECT c_custkey, {TAX} AS note FROM customer),
c AS (SELECT c_custkey, coalesce(nullif(regexp_extract(note, '\b(\d{{2}}[A-Z]{{5}}\d{{4}}[A-Z][A-Z0-9][Z2][A-Z0-9])\b', 1), ''), regexp_extract(replace(note, ' ', ''), '\b(\d{{2}}[A-Z]{{5}}\d{{4}}[A-Z][A-Z0-9][Z2][A-Z0-9])\b', 1)) AS whole,
  replace(replace(regexp_replace(upper(note), '[^A-Z0-9]', '', 'g'), 'GSTIN', ''), 'UIN', '') AS signs FROM t),
d AS (SELECT *, regexp_extract(signs, '[A-Z]{{5}}\d{{4}}[A-Z][A-Z0-9][Z2][A-Z0-9]') AS core FROM c)
SELECT c_custkey, CASE WHEN whole <> '' THEN left(whole, 13) || 'Z' || right(whole, 1) WHEN core <> '' THEN regexp_extract(replace(signs, core, ''), '\d{{2}}') || left(core, 11) || 'Z' || right(core, 1) ELSE '' END AS tax_id FROM d
""")
def tax_id(spark, sf_dir):
    """Tax ids from text: as they stand, across blanks, or put together from a core and the state code that stands apart."""
    return table(spark, sf_dir, "customer").select("c_custkey", codes.tax_id(F.expr(TAX)).alias("tax_id"))


CANON = "translate(upper({0}), '0OUD1ILJF^|!2Z5S6G8B9P', '0000111111112255668899')"
#: A vendor's name of three words, and its code by each of the shapes in use, written and misread.
_NAME = "p_name || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'infotech' WHEN 1 THEN 'traders ltd' ELSE 'of Guru' END"
_FIRST, _SECOND = "upper(split_part(p_name, ' ', 1))", "upper(split_part(p_name, ' ', 2))"
_WRITTEN = f"""CASE p_partkey % 9 WHEN 0 THEN {_FIRST} || '001' WHEN 1 THEN left({_FIRST}, 3) || left({_SECOND}, 3) || '0215' WHEN 2 THEN left({_FIRST}, 3) || left({_SECOND}, 4) || '12' WHEN 3 THEN left({_FIRST}, 3) || 'INFO' || '813'
  WHEN 4 THEN left({_FIRST}, 1) || substr({_FIRST}, 3, 1) || right({_FIRST}, 1) || left({_SECOND}, 3) || '07' WHEN 5 THEN left({_FIRST}, 4) || '101' WHEN 6 THEN 'ABCDEF12' WHEN 7 THEN left({_FIRST}, 3) || left({_SECOND}, 3) || '1X5' ELSE '' END"""
_READ = f"CASE p_partkey % 4 WHEN 0 THEN {_WRITTEN} WHEN 1 THEN translate({_WRITTEN}, 'OISP01', '0159UI') WHEN 2 THEN '1 ' || lower({_WRITTEN}) || ' ' ELSE left({_WRITTEN}, 4) || ' ' || translate(substr({_WRITTEN}, 5, 20), '0125', 'oIZs') END"


@query(rf"""
WITH t AS (SELECT p_partkey, {_READ} AS raw, {_NAME} AS name FROM part),
w AS (SELECT p_partkey, raw, regexp_replace(raw, '^\s*[1:;]\s+', '') AS clean, list_filter(list_transform(regexp_extract_all(name, '[A-Za-z]+'), lambda x: upper(x)), lambda x: length(x) >= 3) AS ws FROM t),
s AS (SELECT *, upper(regexp_replace(clean, '\s+', '', 'g')) AS read, coalesce(ws[1], '') AS w1, {CANON.format("regexp_replace(clean, '\\s+', '', 'g')")} AS c, {CANON.format("coalesce(ws[1], '')")} AS c1 FROM w),
h AS (SELECT *, [w1] || flatten(list_transform(ws[2:3], lambda x: list_transform(range(3, length(x) + 1), lambda n: left(w1, 3) || left(x, n))))
  || [left(w1, CASE WHEN len(list_filter(range(1, least(length(read), length(w1)) + 1), lambda n: left(c, n) = left(c1, n))) >= 3 THEN len(list_filter(range(1, least(length(read), length(w1)) + 1), lambda n: left(c, n) = left(c1, n))) ELSE 0 END)]
  || CASE WHEN length(read) >= 6 AND left(c, 1) = left(c1, 1) AND regexp_matches(substr(c1, 2), '^[^' || c[2] || ']*' || c[2] || '.*' || c[3]) AND len(list_filter(ws[2:3], lambda x: left({CANON.format('x')}, 1) = c[4] AND regexp_matches(substr({CANON.format('x')}, 2), '^[^' || c[5] || ']*' || c[5] || '.*' || c[6]))) > 0 THEN [left(read, 6)] ELSE [] END AS heads FROM s),
b AS (SELECT *, list_min(list_transform(list_filter(range(1, len(heads) + 1), lambda i: heads[i] <> '' AND length(heads[i]) <= length(read)), lambda i:
  {{'miss': list_sum(list_transform(range(1, length(heads[i]) + 1), lambda j: (c[j] <> {CANON.format('heads[i][j]')})::INTEGER)) / length(heads[i]), 'size': -length(heads[i]), 'i': i}})) AS best FROM h),
d AS (SELECT *, coalesce(best.miss = 0, false) AS sure, CASE WHEN coalesce(best.miss = 0, false) THEN heads[best.i] ELSE left(read, 6) END AS head FROM b),
e AS (SELECT *, substr(c, length(head) + 1) AS tail FROM d)
SELECT p_partkey, raw, CASE WHEN trim(raw) = '' THEN '' WHEN length(read) < 4 THEN trim(clean) ELSE head || regexp_replace(tail, '[^0-9]', '', 'g') END AS code,
  CASE WHEN trim(raw) = '' THEN 'none' WHEN length(read) >= 4 AND sure AND regexp_full_match(tail, '[0-9]+') THEN 'confident' ELSE 'doubtful' END AS confidence FROM e
""")
def vendor_code_candidates(spark, sf_dir):
    """A misread vendor code put right by the heads that its vendor's name allows; nothing is joined.

    The file is small for what its rows need, so they are dealt to all tasks first.
    """
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_READ).alias("raw"), F.expr(_NAME).alias("name")).repartition("p_partkey")
    return rows.withColumn("f", codes.vendor_code(F.col("raw"), F.col("name"))).select("p_partkey", "raw", "f.code", "f.confidence")


ADDRESS = """
SELECT c_custkey, 'Plot ' || (c_custkey % 90) || ', Main Road, ' || CASE WHEN c_custkey % 5 = 0 THEN 'Nowhere' ELSE p_name || CASE WHEN c_custkey % 2 = 0 THEN ' east' ELSE '' END END
  || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ', ' || n_name END || ' - ' || (100000 + (c_custkey * 7919) % 800000) AS address FROM customer JOIN part ON p_partkey = c_custkey JOIN nation ON n_nationkey = c_nationkey
"""


@query(rf"""
WITH a AS ({ADDRESS}), w AS (SELECT c_custkey, list_filter(regexp_split_to_array(lower(address), '[^a-z0-9_]+'), lambda x: x <> '') AS ws FROM a),
g AS (SELECT c_custkey, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS name FROM w UNION ALL SELECT c_custkey, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w),
z AS (SELECT DISTINCT lower(p_name) AS name FROM part UNION SELECT DISTINCT lower(p_name) || ' east' FROM part WHERE p_size = 2),
city AS (SELECT c_custkey, arg_min(name, (-length(name), name)) AS city FROM g SEMI JOIN z USING (name) GROUP BY 1),
state AS (SELECT c_custkey, min(n_name) AS state FROM (SELECT c_custkey, unnest(ws) AS word FROM w UNION ALL SELECT * FROM g) JOIN nation ON lower(n_name) = word GROUP BY 1)
SELECT a.c_custkey, coalesce(city, '') AS city, regexp_extract(address, '([1-9][0-9]{{5}})$', 1) AS pin, coalesce(state, ['NORTH', 'NORTH', 'CENTRE', 'WEST', 'SOUTH', 'SOUTH', 'EAST', 'EAST', 'ARMY'][regexp_extract(address, '([1-9])[0-9]{{5}}$', 1)::INTEGER]) AS state
FROM a LEFT JOIN city ON city.c_custkey = a.c_custkey LEFT JOIN state ON state.c_custkey = a.c_custkey
""")
def address_parts(spark, sf_dir):
    """City, state and PIN of an address: the longest gazetteer name of two or three words and a state's name of up to
    three, found by equi-joins on word n-grams; else the state by the PIN's first digit."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    names = table(spark, sf_dir, "customer").join(part.select(F.col("p_partkey").alias("c_custkey"), "p_name"), "c_custkey").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    key = F.col("c_custkey")
    place = F.when(key % 5 == 0, "Nowhere").otherwise(F.concat("p_name", F.when(key % 2 == 0, " east").otherwise("")))
    address = F.concat(F.lit("Plot "), (key % 90).cast("string"), F.lit(", Main Road, "), place, F.when(key % 3 == 0, "").otherwise(F.concat(F.lit(", "), "n_name")), F.lit(" - "), (100000 + key * 7919 % 800000).cast("string"))
    rows = names.select("c_custkey", address.alias("address"))
    words = rows.select("c_custkey", F.filter(F.split(F.lower("address"), "[^a-z0-9_]+"), lambda x: x != "").alias("ws"))
    gazetteer = part.select(F.lower("p_name").alias("name")).union(part.where("p_size = 2").select(F.concat(F.lower("p_name"), F.lit(" east")))).distinct()
    grams = words.select("c_custkey", F.explode(F.concat("ws", codes.word_grams(F.col("ws"), 2), codes.word_grams(F.col("ws"), 3))).alias("name"))
    city = grams.where("instr(name, ' ') > 0").join(gazetteer, "name", "left_semi").groupBy("c_custkey").agg(F.min_by("name", F.struct(-F.length("name"), "name")).alias("city"))
    state = grams.join(nation.select(F.lower("n_name").alias("name"), "n_name"), "name").groupBy("c_custkey").agg(F.min("n_name").alias("state"))
    pin = F.regexp_extract("address", "([1-9][0-9]{5})$", 1)
    zone = F.element_at(F.array(*map(F.lit, codes.PIN_ZONES)), F.substring("pin", 1, 1).cast("int"))
    out = rows.withColumn("pin", pin).join(city, "c_custkey", "left").join(state, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("city", F.lit("")).alias("city"), "pin", F.coalesce("state", zone).alias("state"))


LABEL = "licensed under"


@query()
def label_lines(spark, sf_dir):
    """The value behind a label, line by line: the label as written, else the line whose beginning resembles it by
    0.6 or more (matched characters of both), best first. Lines whose letters can't reach that aren't compared."""
    ship_package(spark)
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    exact = F.regexp_extract("line", r"(?i)^\s*licensed under\s+(?:the\s+)?([A-Za-z0-9. -]+)", 1)
    begin = F.lower(F.substring(F.ltrim("line"), 1, len(LABEL)))
    # No order of the letters matches more of them than both hold.
    held = sum((F.least(F.length(begin) - F.length(F.replace(begin, F.lit(c), F.lit(""))), F.lit(LABEL.count(c))) for c in sorted(set(LABEL))), F.lit(0))
    near = F.when((exact == "") & (2 * held >= 0.6 * (F.length(begin) + len(LABEL))), begin)
    hits = lines.withColumn("exact", exact).withColumn("near", near).where("exact <> '' or near is not null")
    found = hits.withColumn("score", F.when(F.col("exact") != "", 1.0).otherwise(fuzzy.sequence_ratio("near", F.lit(LABEL)))).where("score >= 0.6")
    value = F.when(F.col("exact") != "", F.col("exact")).otherwise(F.trim(F.expr(f"substring(ltrim(line), {len(LABEL) + 1})")))
    best = found.withColumn("value", F.trim(value)).groupBy("doc_id").agg(F.min_by(F.struct("value", "score"), F.struct(-F.col("score"), "idx")).alias("f"))
    return best.select("doc_id", "f.value", "f.score")


FORMATS = """
WITH u AS (SELECT user_id AS id, CASE WHEN user_id % 4 = 0 THEN 'T' || (user_id % 40) END AS tax_id, 'seller ' || (user_id % 25) AS seller, list_sort(list(DISTINCT hour(ts))) AS ls FROM events GROUP BY 1),
f AS (SELECT id AS fid, tax_id, seller, ls FROM u WHERE id % 5 = 0), d AS (SELECT * FROM u WHERE id % 5 <> 0),
t1 AS (SELECT d.id, min(fid) AS fid FROM d JOIN f ON d.tax_id = f.tax_id GROUP BY 1),
t2 AS (SELECT d.id, min(fid) AS fid FROM d JOIN f ON d.tax_id IS NULL AND d.seller = f.seller GROUP BY 1),
t3 AS (SELECT id, fid, len(list_intersect(d.ls, f.ls)) / len(list_distinct(d.ls || f.ls)) AS score FROM d, f)
"""


@query(f"""
{FORMATS}
SELECT d.id, coalesce(t1.fid, t2.fid, b.fid) AS fid, CASE WHEN t1.fid IS NOT NULL THEN 'tax id' WHEN t2.fid IS NOT NULL THEN 'name' ELSE 'labels' END AS how, CASE WHEN coalesce(t1.fid, t2.fid) IS NULL THEN round(b.score, 6) ELSE 1.0 END::DOUBLE AS score
FROM d LEFT JOIN t1 USING (id) LEFT JOIN t2 USING (id) LEFT JOIN (SELECT id, max(score) AS score, arg_min(fid, (-score, fid)) AS fid FROM t3 GROUP BY 1) b USING (id) WHERE coalesce(t1.fid, t2.fid) IS NOT NULL OR b.score >= 0.9
""")
def format_tiers(spark, sf_dir):
    """The first format with the same trusted tax id; without one, with the same name; else the best label overlap
    of 0.90 or more, the first of equals."""
    events = table(spark, sf_dir, "events")
    tax = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("T"), (F.col("user_id") % 40).cast("string")))
    users = events.groupBy("user_id").agg(F.array_sort(F.collect_set(F.hour("ts"))).alias("labels"))  # at most 24
    users = users.select(F.col("user_id").alias("id"), tax.alias("tax_id"), F.concat(F.lit("seller "), (F.col("user_id") % 25).cast("string")).alias("seller"), "labels")
    formats, docs = users.where("id % 5 = 0").withColumnRenamed("id", "fid"), users.where("id % 5 <> 0")
    by_tax = ops.first_of(docs, formats, "tax_id").withColumn("how", F.lit("tax id"))
    by_name = ops.first_of(docs.where("tax_id is null"), formats, "seller").withColumn("how", F.lit("name"))
    rest = docs.join(by_tax.unionByName(by_name), "id", "left_anti")
    by_labels = best_overlap(rest.select("id", "labels"), formats.select("fid", "labels"), 0.9).withColumn("how", F.lit("labels"))
    return by_tax.unionByName(by_name).withColumn("score", F.lit(1.0)).unionByName(by_labels.withColumn("score", F.round("score", 6))).select("id", "fid", "how", "score")


#: Dates in spellings that Spark and DuckDB write alike, and texts that are none; months by their names' first letters.
_D, _M, _Y, _YY = "cast(day(o_orderdate) AS string)", "lpad(cast(month(o_orderdate) AS string), 2, '0')", "cast(year(o_orderdate) AS string)", "right(cast(year(o_orderdate) AS string), 2)"
_MONTH = "substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(o_orderdate) - 2, 3)"
SPELT = f"""CASE o_orderkey % 20 WHEN 0 THEN lpad({_D}, 2, '0') || '-' || {_M} || '-' || {_Y} WHEN 1 THEN {_D} || '-' || {_MONTH} || '-' || {_YY} WHEN 2 THEN {_D} || {_MONTH} || 'x.' || {_YY} WHEN 3 THEN {_D} || ' – ' || {_MONTH} || ' - ' || {_Y}
  WHEN 4 THEN {_D} || '/' || {_M} || '/' || {_YY} WHEN 5 THEN {_D} || '.' || cast(month(o_orderdate) AS string) || '.' || {_Y} WHEN 6 THEN upper({_MONTH}) || 'y ' || {_D} || ', ' || {_Y} WHEN 7 THEN {_Y} || '-' || {_M} || '-' || {_D} WHEN 8 THEN {_Y} || '/' || {_M} || '/' || {_D} || ' noon'
  WHEN 9 THEN '  ' || {_D} || ' ' || {_MONTH} || ' ' || {_Y} || ' ' WHEN 10 THEN {_D} || '-0ct-' || {_YY} WHEN 11 THEN '0-Jul-20' WHEN 12 THEN '31-02-2025' WHEN 13 THEN '32-13-2025' WHEN 14 THEN '03.0.7' WHEN 15 THEN {_D} || '-Xyz-2025' WHEN 16 THEN 'Xyz ' || {_D} || ', 2025' WHEN 17 THEN 'soon' WHEN 18 THEN '' END"""
_SQL_MONTH = "coalesce(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], replace(lower(left({0}, 3)), '0', 'o')), 0)"
_SQL_DATE = "lpad(try_cast({0} AS INTEGER)::VARCHAR, 2, '0') || '-' || lpad(try_cast({1} AS INTEGER)::VARCHAR, 2, '0') || '-' || CASE WHEN length({2}) = 2 THEN '20' || {2} ELSE {2} END"


@query(rf"""
WITH t AS (SELECT o_orderkey, {SPELT} AS spelt FROM orders),
x AS (SELECT *, regexp_extract(trim(spelt), '^(\d{{1,2}})[-/.–— ]*([A-Za-z][A-Za-z0]{{2,}}|0[A-Za-z][A-Za-z0]+)[-/.–— ]+(\d{{2,4}})', ['d', 'm', 'y']) AS a, regexp_extract(trim(spelt), '^(\d{{1,2}})[-/.–—](\d{{1,2}})[-/.–—](\d{{2,4}})', ['d', 'm', 'y']) AS b,
  regexp_extract(trim(spelt), '^([A-Za-z]{{3,}})[-/.–— ]+(\d{{1,2}}),?[-/.–— ]+(\d{{2,4}})', ['m', 'd', 'y']) AS c, regexp_extract(trim(spelt), '^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})\b', ['y', 'm', 'd']) AS e FROM t)
SELECT o_orderkey, spelt, CASE WHEN spelt IS NULL THEN '' WHEN a.d <> '' THEN CASE WHEN try_cast(a.d AS INTEGER) BETWEEN 1 AND 31 AND {_SQL_MONTH.format('a.m')} >= 1 THEN {_SQL_DATE.format('a.d', _SQL_MONTH.format('a.m'), 'a.y')} ELSE '' END
  WHEN b.d <> '' THEN CASE WHEN try_cast(b.d AS INTEGER) BETWEEN 1 AND 31 AND try_cast(b.m AS INTEGER) BETWEEN 1 AND 12 THEN {_SQL_DATE.format('b.d', 'b.m', 'b.y')} ELSE '' END
  WHEN c.m <> '' AND {_SQL_MONTH.format('c.m')} >= 1 THEN {_SQL_DATE.format('c.d', _SQL_MONTH.format('c.m'), 'c.y')} WHEN e.y <> '' THEN {_SQL_DATE.format('e.d', 'e.m', 'e.y')} ELSE '' END AS normal FROM x
""")
def date_spellings(spark, sf_dir):
    """Dates in every spelling that is read, and texts that are none, to one form."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(SPELT).alias("spelt"))
    return rows.select("o_orderkey", "spelt", dates.normalize(F.col("spelt")).alias("normal"))


_FOLDER = "CASE WHEN page_id % 9 = 0 THEN ' .. ' WHEN page_id % 9 = 1 THEN '. .' || url || '.x ' ELSE url || ' ..' END"


@query(rf"""
SELECT page_id, CASE WHEN clean = '' THEN 'Unknown' ELSE clean END AS folder, regexp_replace(source, '[^A-Za-z0-9]+', '_', 'g') AS suffix FROM (
  SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '' ELSE url END AS source, trim(regexp_replace({_FOLDER}, '[<>:"/\\|?*]+', '_', 'g'), ' .') AS clean FROM pages)
""")
def folder_name(spark, sf_dir):
    """Folder names without forbidden characters or dots at their ends, `Unknown` where nothing stays; batch suffixes."""
    suffix = F.regexp_replace(F.expr("CASE WHEN page_id % 9 = 0 THEN '' ELSE url END"), "[^A-Za-z0-9]+", "_")
    return table(spark, sf_dir, "pages").select("page_id", codes.folder_name(F.expr(_FOLDER)).alias("folder"), suffix.alias("suffix"))
