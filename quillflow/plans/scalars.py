"""Projection, nested, layout, text, date and amount queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillflow.functions import dates, fuzzy, money, text
from quillflow.operators.aggregate import money as total
from quillflow.plans.registry import query
from quillflow.session import ship_package
from quillflow.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


# Projection and nested rows


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'Charge (Item)' ELSE 'Item' END AS "Type", (l_linenumber * 10000)::VARCHAR AS "Line_No",
  'INR' AS "Currency", o_orderpriority AS "Priority" FROM lineitem JOIN orders ON o_orderkey = l_orderkey
""")
def mapped_projection(spark, sf_dir):
    """Columns by specification: an override first, then literals (=x), item fields, header fields."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    mapping = {"Type": "l_returnflag", "Line_No": "l_linenumber", "Currency": "=INR", "Priority": "o_orderpriority"}
    override = {"Type": F.when(F.col("l_returnflag") == "A", "Charge (Item)").otherwise("Item"), "Line_No": (F.col("l_linenumber") * 10000).cast("string")}
    shown = [override.get(k, F.lit(v[1:]) if v.startswith("=") else F.col(v)).alias(k) for k, v in mapping.items()]
    return lines.select("l_orderkey", "l_linenumber", *shown)


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'Service ' || (round(l_tax * 100)::INTEGER * 2) || '%' ELSE 'Goods ' || round(l_tax * 100)::INTEGER || '%' END AS tax_group FROM lineitem
""")
def tax_group_label(spark, sf_dir):
    """Group label with its rate; services take the full slab for a half one."""
    rate = F.round(F.col("l_tax") * 100).cast("int")
    service = F.concat(F.lit("Service "), (rate * 2).cast("string"), F.lit("%"))
    label = F.when(F.col("l_returnflag") == "A", service).otherwise(F.concat(F.lit("Goods "), rate.cast("string"), F.lit("%")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("tax_group"))


@query("""
SELECT p_partkey, CASE WHEN p_name LIKE 'a%' THEN 'PDF' WHEN p_size = 1 THEN 'System' WHEN trim(p_type) = '' OR p_type LIKE 'S%' THEN 'Template' WHEN p_retailprice > 1500 THEN 'Service' ELSE 'PDF' END AS lineage FROM part
""")
def field_source(spark, sf_dir):
    """Where a field's value comes from, by the first rule that holds."""
    rule = (
        F.when(F.startswith("p_name", F.lit("a")), "PDF").when(F.col("p_size") == 1, "System")
        .when((F.trim("p_type") == "") | F.startswith("p_type", F.lit("S")), "Template").when(F.col("p_retailprice") > 1500, "Service").otherwise("PDF")
    )
    return _parts(spark, sf_dir).select("p_partkey", rule.alias("lineage"))


@query("""
SELECT l_orderkey, unit::BIGINT AS unit, count(*) AS n, sum(l_extendedprice::DECIMAL(18,4))::DOUBLE AS amount
FROM (SELECT *, unnest(range(1, greatest(1, trunc(l_quantity))::INTEGER + 1)) AS unit FROM lineitem) GROUP BY 1, 2
""")
def shred_nested(spark, sf_dir):
    """Documents nested as header and lines, shredded to one row per unit and summed.

    A unit's sums are those of the lines with as many units, so they are found once for each quantity of a document and
    the units below it follow; no line's units are made and grouped again.
    """
    item = F.struct(F.greatest(F.lit(1), F.col("l_quantity").cast("int")).alias("qty"), F.col("l_extendedprice").cast("decimal(18,4)").alias("price"))
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))  # bounded by a document's lines
    levels = nested.select("l_orderkey", "items", F.array_sort(F.array_distinct("items.qty")).alias("levels"))

    def step(high, place):
        held = F.filter("items", lambda x: x["qty"] >= high)
        amount = F.aggregate(held, F.lit(None).cast("decimal(28,4)"), lambda a, x: F.coalesce(a + x["price"], a, x["price"]).cast("decimal(28,4)"))
        low = F.coalesce(F.get("levels", place - 1), F.lit(0)) + 1
        return F.struct(low.alias("low"), high.alias("high"), F.size(held).cast("long").alias("n"), amount.cast("double").alias("amount"))

    steps = levels.select("l_orderkey", F.inline(F.transform("levels", step)))
    return steps.select("l_orderkey", F.explode(F.sequence("low", "high")).alias("unit"), "n", "amount").withColumn("unit", F.col("unit").cast("long"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_type = 'purchase'")
def json_rowset(spark, sf_dir):
    """Typed columns of a JSON payload."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", F.from_json("props", "k long").alias("j")).select("event_id", "j.k")


@query("""
SELECT n_regionkey, string_agg(n_name || '=' || n_nationkey, ';' ORDER BY n_name) AS settings FROM nation GROUP BY 1
""")
def eav_to_map(spark, sf_dir):
    """Name and value rows folded to a map per owner, shown in order of names."""
    maps = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("n_regionkey", F.array_join(entries, ";").alias("settings"))


@query("""
SELECT doc_id, array_to_string(list_filter(['the', 'permission', 'license', 'rights', 'que'], lambda x: contains(lower(text), x)), ',') AS labels FROM documents
""")
def label_set(spark, sf_dir):
    """Which phrases a text contains."""
    labels = F.array(*map(F.lit, ("the", "permission", "license", "rights", "que")))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.filter(labels, lambda x: F.contains(F.lower("text"), x)), ",").alias("labels"))


@query("""
SELECT o_orderstatus, what, sum(v::DECIMAL(18,4))::DOUBLE AS total FROM (
  SELECT o_orderstatus, 'price' AS what, o_totalprice AS v FROM orders UNION ALL SELECT o_orderstatus, 'buyer', o_custkey FROM orders) GROUP BY 1, 2
""")
def unpivot_check(spark, sf_dir):
    """Columns turned to rows and summed."""
    wide = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("buyer"))
    return wide.unpivot("o_orderstatus", ["price", "buyer"], "what", "v").groupBy("o_orderstatus", "what").agg(total("v").alias("total"))


# Layout: documents as rows of lines

LINES = "SELECT doc_id, idx::BIGINT AS idx, line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(ls) WITH ORDINALITY u(line, idx)"


def _lines(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(text.first_lines(F.col("text"))).alias("idx", "line")).withColumn("idx", F.col("idx").cast("long") + 1)


@query(f"""
WITH l AS ({LINES}), s AS (SELECT doc_id, min(idx) FILTER (contains(line, '|')) AS begins FROM l GROUP BY 1)
SELECT l.doc_id, begins, coalesce(min(idx) FILTER (idx > begins AND NOT contains(line, '|')), max(idx) + 1) AS ends FROM l JOIN s ON s.doc_id = l.doc_id WHERE begins IS NOT NULL GROUP BY 1, 2
""")
def section_bounds(spark, sf_dir):
    """First table row, and the first later row that is none, of each document."""
    lines = _lines(spark, sf_dir)
    bar = F.contains("line", F.lit("|"))
    begins = F.min(F.when(bar, F.col("idx"))).over(Window.partitionBy("doc_id"))
    later = (F.col("idx") > F.col("begins")) & ~bar
    ends = F.coalesce(F.min(F.when(later, F.col("idx"))), F.max("idx") + 1)
    return lines.withColumn("begins", begins).where("begins is not null").groupBy("doc_id", "begins").agg(ends.alias("ends"))


@query(f"SELECT doc_id, arg_min(idx, (-length(line), idx)) AS idx, max(length(line)) AS score FROM ({LINES}) GROUP BY 1")
def argmax_row(spark, sf_dir):
    """The row with the best score, the first of equals."""
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.min_by("idx", F.struct(-F.length("line"), "idx")).alias("idx"), F.max(F.length("line")).cast("long").alias("score"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'left' WHEN l_quantity < 35 THEN 'middle' ELSE 'right' END AS band FROM lineitem")
def band_classify(spark, sf_dir):
    """A position's band."""
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(q < 10, "left").when(q < 35, "middle").otherwise("right").alias("band"))


@query(f"""
SELECT doc_id, item::BIGINT AS item, string_agg(line, ' ' ORDER BY idx) AS merged FROM (
  SELECT *, sum((length(line) > 80)::INTEGER) OVER (PARTITION BY doc_id ORDER BY idx) AS item FROM ({LINES})) GROUP BY 1, 2
""")
def continuation_merge(spark, sf_dir):
    """Lines that start an item and those that carry it on, joined."""
    item = F.sum((F.length("line") > 80).cast("int")).over(Window.partitionBy("doc_id").orderBy("idx"))
    marked = _lines(spark, sf_dir).withColumn("item", item)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"])
    return marked.groupBy("doc_id", "item").agg(F.array_join(ordered, " ").alias("merged"))


@query(f"""
SELECT doc_id, section, count(*) AS n FROM (
  SELECT doc_id, coalesce(last_value(CASE WHEN contains(line, 'icense') THEN 'license' WHEN contains(line, '|') THEN 'table' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx), 'body') AS section
  FROM ({LINES})) GROUP BY 1, 2
""")
def section_fill(spark, sf_dir):
    """Section markers carried forward over the lines below them."""
    marker = F.when(F.contains("line", F.lit("icense")), "license").when(F.contains("line", F.lit("|")), "table")
    filled = F.last(marker, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("idx"))
    return _lines(spark, sf_dir).select("doc_id", F.coalesce(filled, F.lit("body")).alias("section")).groupBy("doc_id", "section").agg(F.count("*").alias("n"))


# Text


@query(r"SELECT doc_id, md5(lower(regexp_replace(trim(text), '\s+', ' ', 'g'))) AS norm, regexp_replace(upper(source), '[^A-Z0-9]', '', 'g') AS code FROM documents")
def norm_text(spark, sf_dir):
    """White space collapsed and lower-cased; letters and digits upper-cased."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.collapse(F.col("text"))).alias("norm"), text.alnum_upper(F.col("source")).alias("code"))


@query("SELECT p_partkey, translate(upper(p_brand), '|81L26', 'IBIIZG') = translate(upper('Brand#' || (p_size % 60)), '|81L26', 'IBIIZG') AS same FROM part")
def confusable_eq(spark, sf_dir):
    """Whether two codes are equal up to characters that readers confuse."""
    other = F.concat(F.lit("Brand#"), (F.col("p_size") % 60).cast("string"))
    return _parts(spark, sf_dir).select("p_partkey", (text.canonical(F.col("p_brand")) == text.canonical(other)).alias("same"))


@query("""
SELECT p_partkey, coalesce(list_sum(list_transform(range(1, least(length(p_name), length(p_type)) + 1), lambda i: (translate(upper(p_name), '0OUD1ILJF^|!2Z5S6G8B9P', '0000111111112255668899')[i]
  = translate(upper(p_type), '0OUD1ILJF^|!2Z5S6G8B9P', '0000111111112255668899')[i])::INTEGER)), 0)::BIGINT AS score FROM part
""")
def confusable_score(spark, sf_dir):
    """Equal characters at equal places, confusable ones counted as equal."""
    return _parts(spark, sf_dir).select("p_partkey", text.confusable_score(F.col("p_name"), F.col("p_type")).alias("score"))


@query(r"SELECT doc_id, regexp_extract(text, '(?i)license(?:d under| [^\n]*?version)\s+(?:the\s+)?([A-Za-z0-9. ]+)', 1) AS value FROM documents WHERE contains(text, 'icense')")
def label_value(spark, sf_dir):
    """The value behind a label in a text line."""
    value = F.regexp_extract("text", r"(?i)license(?:d under| [^\n]*?version)\s+(?:the\s+)?([A-Za-z0-9. ]+)", 1)
    return _docs(spark, sf_dir).where(F.contains("text", F.lit("icense"))).select("doc_id", value.alias("value"))


@query("SELECT page_id, CASE WHEN regexp_matches(upper(string_split(url, '/')[-1]), '^[A-Z]+[0-9]+$') THEN upper(string_split(url, '/')[-1]) ELSE '' END AS code FROM pages")
def filename_code(spark, sf_dir):
    """The code in the last part of a path, if it has a code's form."""
    last = F.upper(F.element_at(F.split("url", "/"), -1))
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.rlike(last, F.lit("^[A-Z]+[0-9]+$")), last).otherwise("").alias("code"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}') THEN regexp_extract(text, '\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}')
  WHEN regexp_matches(text, '\+1 \(\d{3}\)') THEN regexp_extract(text, '\+1 \((\d{3})\)', 1) WHEN regexp_matches(text, 'ersion [0-9.]+') THEN regexp_extract(text, 'ersion ([0-9.]+)', 1) ELSE '' END AS value FROM documents
""")
def pattern_cascade(spark, sf_dir):
    """The strict pattern's value, else the looser ones' in turn."""
    tries = [F.nullif(F.regexp_extract("text", p, g), F.lit("")) for p, g in ((r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", 0), (r"\+1 \((\d{3})\)", 1), (r"ersion ([0-9.]+)", 1))]
    return _docs(spark, sf_dir).select("doc_id", F.coalesce(*tries, F.lit("")).alias("value"))


@query(r"SELECT doc_id, regexp_extract(text, '([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+)', 2) AS host FROM documents WHERE contains(text, '@')")
def regex_extract(spark, sf_dir):
    """A group of a pattern's first match."""
    return _docs(spark, sf_dir).where(F.contains("text", F.lit("@"))).select("doc_id", F.regexp_extract("text", r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+)", 2).alias("host"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))), ',') AS numbers FROM documents WHERE regexp_matches(text, '[0-9]')")
def regex_all(spark, sf_dir):
    """Distinct matches of a pattern, joined."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)"))))
    return _docs(spark, sf_dir).where(F.rlike("text", F.lit("[0-9]"))).select("doc_id", F.array_join(found, ",").alias("numbers"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(p_partkey || ' ' || p_name || ' 18%', '^' || p_partkey || '\s+', ''), '\s*[0-9]+%$', '')) AS clean FROM part")
def clean_desc(spark, sf_dir):
    """A description without its serial number and rate."""
    glued = F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name", F.lit(" 18%"))
    serial = F.regexp_replace(glued, F.concat(F.lit("^"), F.col("p_partkey").cast("string"), F.lit(r"\s+")), F.lit(""))
    return _parts(spark, sf_dir).select("p_partkey", F.trim(F.regexp_replace(serial, r"\s*[0-9]+%$", "")).alias("clean"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE regexp_replace(left(text, 50), '\s+\S*$', '') END AS capped FROM documents")
def word_cap(spark, sf_dir):
    """A text cut to 50 characters at a word's end (the cap is the feature)."""
    return _docs(spark, sf_dir).select("doc_id", text.word_cap(F.col("text"), 50).alias("capped"))


@query("SELECT doc_id, regexp_matches(text, '(" + "|".join(c * 4 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + ")') AS garbled FROM documents")
def garbled(spark, sf_dir):
    """Texts with a letter four times in a row."""
    return _docs(spark, sf_dir).select("doc_id", text.garbled(F.col("text")).alias("garbled"))


@query(r"""SELECT page_id, trim(regexp_replace(url, '[<>:"/\\|?*]+', '_', 'g')) AS name FROM pages""")
def safe_name(spark, sf_dir):
    """A name without the characters that paths forbid."""
    return table(spark, sf_dir, "pages").select("page_id", text.safe_name(F.col("url")).alias("name"))


@query(r"SELECT c_custkey, replace(regexp_replace('custName_' || c_mktsegment || 'Of' || c_custkey, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' ') AS label FROM customer")
def str_prettify(spark, sf_dir):
    """A column name as words."""
    return table(spark, sf_dir, "customer").select("c_custkey", text.prettify(F.concat(F.lit("custName_"), "c_mktsegment", F.lit("Of"), F.col("c_custkey").cast("string"))).alias("label"))


@query("SELECT p_partkey, contains(regexp_replace(upper(p_type || p_name), '[^A-Z0-9]', '', 'g'), regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g')) AS inside FROM part")
def near_dup_contains(spark, sf_dir):
    """Whether one text holds the other, letters and digits only."""
    return _parts(spark, sf_dir).select("p_partkey", F.contains(text.alnum_upper(F.concat("p_type", "p_name")), text.alnum_upper(F.col("p_name"))).alias("inside"))


@query("SELECT page_id, regexp_matches(html, '(?i)<nav|<footer') AND NOT regexp_matches(html, '(?i)copyright') AS is_page FROM pages")
def page_filter(spark, sf_dir):
    """Pages by a pattern they show and one they don't."""
    return table(spark, sf_dir, "pages").select("page_id", (F.rlike("html", F.lit("(?i)<nav|<footer")) & ~F.rlike("html", F.lit("(?i)copyright"))).alias("is_page"))


@query("""
WITH t AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part), g AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS w FROM part UNION SELECT DISTINCT lower(split_part(p_name, ' ', 1)) FROM part)
SELECT p_partkey, arg_min(w, (-length(w), w)) AS place FROM t SEMI JOIN g USING (w) GROUP BY 1
""")
def gazetteer_longest(spark, sf_dir):
    """The longest gazetteer name among a text's words: an equi-join on words."""
    part = _parts(spark, sf_dir)
    words = part.select("p_partkey", F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("w"))
    names = part.select(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("w")).union(part.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))))).distinct()
    return words.join(names, "w", "left_semi").groupBy("p_partkey").agg(F.min_by("w", F.struct(-F.length("w"), "w")).alias("place"))


@query()
def fuzzy_ratio(spark, sf_dir):
    """Matched characters of two texts over all their characters."""
    ship_package(spark)
    return _parts(spark, sf_dir).select("p_partkey", fuzzy.sequence_ratio("p_name", "p_type").alias("ratio"))


@query()
def desc_mismatch(spark, sf_dir):
    """Descriptions whose shared-token ratio is below 45; a blank catalogue text never fits."""
    ship_package(spark)
    ratio = fuzzy.token_set_ratio("p_name", "p_type")
    rows = _parts(spark, sf_dir).select("p_partkey", ratio.alias("ratio"), (F.trim("p_name") == "").alias("blank"))
    return rows.select("p_partkey", "ratio", (F.col("blank") | (F.col("ratio") < 45)).alias("mismatch"))


@query("""
WITH known AS (SELECT translate(upper(p_brand), '|81L26', 'IBIIZG') AS form, min(p_brand) AS known, count(DISTINCT p_brand) AS n FROM part GROUP BY 1),
read AS (SELECT p_partkey, translate(p_brand, '12', 'L2') AS read, translate(upper(translate(p_brand, '12', 'L2')), '|81L26', 'IBIIZG') AS form FROM part)
SELECT p_partkey, read, coalesce(known, read) AS code, coalesce(round(1.0::DOUBLE / n, 4), 0.0)::DOUBLE AS confidence FROM read LEFT JOIN known USING (form)
""")
def vendor_code_fix(spark, sf_dir):
    """A misread brand code replaced by the known code that reads the same, with a confidence."""
    part = _parts(spark, sf_dir)
    known = part.select(F.col("p_brand").alias("known"), text.canonical(F.col("p_brand")).alias("form")).distinct().groupBy("form").agg(F.min("known").alias("known"), F.count("*").alias("n"))
    read = part.select("p_partkey", F.translate("p_brand", "12", "L2").alias("read")).withColumn("form", text.canonical(F.col("read")))
    fixed = read.join(known, "form", "left")
    return fixed.select("p_partkey", "read", F.coalesce("known", "read").alias("code"), F.round(F.coalesce(1 / F.col("n"), F.lit(0.0)), 4).alias("confidence"))


# Dates and amounts


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 3 THEN '' ELSE strftime(o_orderdate, '%d-%m-%Y') END AS normal FROM orders
""")
def date_normalize(spark, sf_dir):
    """Dates in several spellings, one of them invalid, to one."""
    k = F.col("o_orderkey") % 5
    spelt = (
        F.when(k == 0, F.date_format("o_orderdate", "dd-MM-yyyy")).when(k == 1, F.date_format("o_orderdate", "MMM d, yyyy"))
        .when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 3, "32-13-2025").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.normalize(spelt).alias("normal"))


@query("""
SELECT o_orderkey, strftime(o_orderdate + to_days(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 45 WHEN 2 THEN 30 ELSE 30 END::INTEGER), '%d-%m-%Y') AS due FROM orders
""")
def due_date(spark, sf_dir):
    """Due date by payment terms."""
    terms = F.element_at(F.array(F.lit("100% ADVANCE PAYMENT"), F.lit("45 DAYS"), F.lit("AGAINST INVOICE"), F.lit("")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.add_days(F.date_format("o_orderdate", "dd-MM-yyyy"), dates.term_days(terms)).alias("due"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS parsed, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE round(o_totalprice, 0)::BIGINT END AS whole FROM orders")
def num_parse(spark, sf_dir):
    """Numbers written with commas and percent signs; others are null."""
    spelt = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.concat(F.lit(" ,"), F.col("o_totalprice").cast("string"), F.lit("%")))
    parsed = money.number(spelt)
    return table(spark, sf_dir, "orders").select("o_orderkey", parsed.alias("parsed"), F.round(parsed).cast("long").alias("whole"))


RECONCILED = """
SELECT l_orderkey, l_linenumber, l_partkey, q, r, a, CASE WHEN a = 0 AND r > 0 THEN 'free' WHEN NOT coalesce(q > 0 AND r > 0 AND a > 0, false) THEN 'incomplete' WHEN abs(q * r - a) <= n THEN 'agrees'
  {slabs}
  WHEN q * r < 0.98 * a AND q = 1 AND abs(a / r - round(a / r)) <= 0.005 AND round(a / r) BETWEEN 2 AND 100 THEN 'quantity misread' WHEN q * r < 0.98 * a THEN 'rate misread' ELSE 'discount' END AS why
FROM (SELECT *, greatest(0.5, a * 0.0005) AS n, greatest(greatest(0.5, a * 0.0005), a * 0.001) AS w FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN 1.0 ELSE l_quantity END AS q, 10.0 * (l_partkey % 50) AS r, round(10.0 * (l_partkey % 50) * l_quantity * (1 + (l_suppkey % 3) * 0.09), 2) AS a, l_tax * 100 AS t FROM lineitem))
"""
_STEPS = "\n  ".join(f"WHEN abs(q * r * (1 + {s} / 100) - a) <= w THEN 'amount held tax' WHEN abs(q * r / (1 + {s} / 100) - a) <= w THEN 'rate held tax'" for s in ("(CASE WHEN t > 0 AND t <= 40 THEN t END)", "5.0", "12.0", "18.0", "28.0"))


@query(f"SELECT l_orderkey, why, count(*) AS n FROM ({RECONCILED.format(slabs=_STEPS)}) GROUP BY 1, 2")
def reconcile_line(spark, sf_dir):
    """Lines whose quantity, rate and amount disagree, by what explains it."""
    rate = F.lit(10.0) * (F.col("l_partkey") % 50)
    amount = F.round(rate * F.col("l_quantity") * (1 + (F.col("l_suppkey") % 3) * 0.09), 2)
    quantity = F.when(F.col("l_partkey") % 7 == 0, 1.0).otherwise(F.col("l_quantity"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", quantity.alias("q"), rate.alias("r"), amount.alias("a"), (F.col("l_tax") * 100).alias("t"))
    lines = lines.select("l_orderkey", money.reconcile_code(F.col("q"), F.col("r"), F.col("a"), F.col("t")).alias("code"))
    return lines.groupBy("l_orderkey", "code").agg(F.count("*").alias("n")).select("l_orderkey", money.reason(F.col("code")).alias("why"), "n")


@query("""
SELECT l_orderkey, coalesce(max(l_tax) FILTER (l_linenumber = 7), sum(l_tax::DECIMAL(18,4))::DOUBLE) AS tax FROM lineitem GROUP BY 1
""")
def tax_total(spark, sf_dir):
    """The total row's tax where there is one, else the sum of the rows."""
    given = F.max(F.when(F.col("l_linenumber") == 7, F.col("l_tax")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.coalesce(given, total("l_tax")).alias("tax"))


@query("""
SELECT l_orderkey, CASE WHEN abs(goods * 0.18 - tax) <= abs((goods + charge) * 0.18 - tax) THEN 'goods only' ELSE 'with charges' END AS base FROM (
  SELECT l_orderkey, coalesce(sum(l_quantity::BIGINT) FILTER (l_returnflag <> 'A'), 0)::DOUBLE AS goods, coalesce(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'A'), 0)::DOUBLE AS charge,
    sum(l_linenumber::BIGINT)::DOUBLE AS tax FROM lineitem GROUP BY 1)
""")
def freight_tax(spark, sf_dir):
    """Which base explains the tax better: goods alone or goods with charges."""
    whole = F.col("l_quantity").cast("long")
    part = lambda c: F.coalesce(F.sum(F.when(c, whole)), F.lit(0)).cast("double")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        part(F.col("l_returnflag") != "A").alias("goods"), part(F.col("l_returnflag") == "A").alias("charge"), F.sum(F.col("l_linenumber").cast("long")).cast("double").alias("tax")
    )
    closer = F.abs(F.col("goods") * 0.18 - F.col("tax")) <= F.abs((F.col("goods") + F.col("charge")) * 0.18 - F.col("tax"))
    return sums.select("l_orderkey", F.when(closer, "goods only").otherwise("with charges").alias("base"))


_RATE = "l_quantity + (l_linenumber % 5) * 0.125 - 0.25"


@query(f"""
SELECT l_orderkey, l_linenumber, CASE WHEN s.s IN (3, 5, 12, 18, 28) AND s.d <= 0.3 THEN s.s END AS slab FROM (
  SELECT l_orderkey, l_linenumber, list_min(list_transform([0.1, 0.25, 3.0, 5.0, 12.0, 18.0, 28.0, 40.0], lambda s: {{'d': abs(s::DOUBLE - ({_RATE})), 's': s::DOUBLE}})) AS s FROM lineitem)
""")
def nearest_slab(spark, sf_dir):
    """The tax slab that an implied rate names, if it is near enough to one."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", money.nearest_slab(F.expr(_RATE)).alias("slab"))
