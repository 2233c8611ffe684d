"""Table functions, learned formats and versioned snapshots."""

import threading
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from quillflow.functions import tables
from quillflow.operators import formats
from quillflow.sources import versions

FORMAT = "name string, tax_id string, seller string, fields array<string>, sources array<string>"
SAMPLE = "source string, tax_id string, seller string, fields array<string>"


def test_invoices_of_documents(spark):
    tables.register(spark)
    pages = [(1, 1, None), (1, 2, "26|1TN"), (1, 3, "26I1TN"), (1, 4, ""), (1, 5, "B2"), (1, 6, None), (2, 1, None), (2, 2, None), (3, 9, "x")]
    df = spark.createDataFrame(pages, "document long, page long, number string").repartition(3)
    found = sorted(map(tuple, spark.sql("SELECT * FROM invoices(TABLE({p}) PARTITION BY document ORDER BY page)", p=df).collect()))
    assert found == [(1, 1, "26|1TN", 1, 4, 4), (1, 2, "B2", 5, 6, 2), (2, 1, None, 1, 2, 2), (3, 1, "x", 9, 9, 1)]


def test_items_of_texts(spark):
    tables.register(spark)
    texts = [(1, "Sl Item Qty\n1. Bolt M8  10 x 2.50\n  zinc\n\n2) Nut 3 x 1\nTotal"), (2, ""), (3, None), (4, "no items here 5 x 2")]
    df = spark.createDataFrame(texts, "id int, text string")
    found = sorted(map(tuple, spark.sql("SELECT d.id, i.* FROM {d} d, LATERAL items(d.text) i", d=df).collect()))
    assert found == [(1, 10_000, "Bolt M8 zinc", 10, Decimal("2.50"), Decimal("25.00")), (1, 20_000, "Nut Total", 3, Decimal("1.00"), Decimal("3.00"))]


def test_learned_formats(spark):
    known = spark.createDataFrame([("format1", "T1", "Alpha Ltd", ["a", "b"], ["k1"]), ("format2", None, "Beta", ["c"], ["k2"]), ("format7", None, None, list("abcdefghij"), ["k3"])], FORMAT)
    samples = [
        ("s1", "T1", "Other", ["c"]), ("s2", None, "ALPHA ltd.", ["d"]), ("s3", "T9", "Gamma", ["x"]), ("s4", None, "gamma", ["y"]), ("s5", None, "Delta", ["z"]), ("s6", " T9 ", None, ["w"]),
        ("s7", None, None, list("abcdefghi")), ("s8", "", "", ["q"]), ("s9", None, None, ["q"]), ("s10", None, "beta", []),
    ]
    found, answers = formats.learn(known, spark.createDataFrame(samples, SAMPLE))
    assert {r.source: (r.name, r.status) for r in answers.collect()} == {
        "s1": ("format1", "merged"), "s2": ("format1", "merged"), "s10": ("format2", "merged"), "s7": ("format7", "merged_by_layout"), "s8": ("format8", "learned_by_layout"), "s9": ("format8", "learned_by_layout"),
        "s5": ("format9", "learned"), "s3": ("format10", "learned"), "s6": ("format10", "learned"), "s4": ("format10", "merged")}
    rows = {r.name: (r.tax_id, r.seller, r.fields, r.sources) for r in found.collect()}
    assert rows["format1"] == ("T1", "Alpha Ltd", list("abcd"), ["k1", "s1", "s2"]) and rows["format7"][2] == list("abcdefghij")
    assert rows["format10"] == ("T9", "gamma", ["w", "x", "y"], ["s3", "s4", "s6"]) and rows["format9"] == (None, "Delta", ["z"], ["s5"])
    assert len(rows) == 6


def labels(df):
    return sorted(r.name for r in df.collect())


def test_versions_publish_restore_conflict(spark, tmp_path):
    folder = str(tmp_path / "formats")
    frame = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    assert versions.current(spark, folder) == 0
    with pytest.raises(FileNotFoundError):
        versions.read(spark, folder)
    assert versions.publish(frame("a"), folder, 0) == 1
    assert versions.publish(frame("a", "b"), folder, 1) == 2
    with pytest.raises(versions.Conflict):  # a writer that read version 1
        versions.publish(frame("a", "c"), folder, 1)
    assert labels(versions.read(spark, folder)) == ["a", "b"]
    assert versions.restore(spark, folder, 1, 2) == 3
    assert labels(versions.read(spark, folder)) == ["a"] and labels(versions.read(spark, folder, 2)) == ["a", "b"]
    with pytest.raises(versions.Conflict):
        versions.restore(spark, folder, 2, 2)
    with pytest.raises(FileNotFoundError):
        versions.restore(spark, folder, 9, 3)


def test_failed_publish_changes_nothing(spark, tmp_path):
    """A snapshot whose writing fails, and a pointer that was cut off while it was written."""
    folder = str(tmp_path / "formats")
    versions.publish(spark.createDataFrame([("a",)], "name string"), folder, 0)
    broken = spark.createDataFrame([("b",)], "name string").select(F.expr("raise_error(name)").cast("string").alias("name"))
    with pytest.raises(Exception, match="b"):
        versions.publish(broken, folder, 1)
    assert versions.current(spark, folder) == 1 and labels(versions.read(spark, folder)) == ["a"]
    (tmp_path / "formats/versions/.cut-off").touch()
    assert labels(versions.read(spark, folder)) == ["a"]
    assert versions.publish(spark.createDataFrame([("c",)], "name string"), folder, versions.current(spark, folder)) == 2
    assert labels(versions.read(spark, folder)) == ["c"]


def test_two_writers_merge_both(spark, tmp_path):
    """Writers that learn at once and try again after a conflict: nothing is lost."""
    folder = str(tmp_path / "formats")
    versions.publish(spark.createDataFrame([], FORMAT), folder, 0)
    conflicts = []

    def writer(source):
        sample = spark.createDataFrame([(source, f"T-{source}", None, [source])], SAMPLE)
        while True:
            at = versions.current(spark, folder)
            try:
                return versions.publish(formats.learn(versions.read(spark, folder, at), sample)[0], folder, at)
            except versions.Conflict:
                conflicts.append(source)

    threads = [threading.Thread(target=writer, args=(f"s{k}",)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert versions.current(spark, folder) == 4 and conflicts
    assert sorted(r.sources for r in versions.read(spark, folder).collect()) == [["s0"], ["s1"], ["s2"]]


def test_fold_contained_same_as_plain_loop(spark, monkeypatch):
    """Short lists and, with the bound at two values, streams."""
    import random
    import re

    from quillflow.operators import aggregate

    rng = random.Random(3)
    parts = ["12 Main Rd,", "12 main rd", "Main", "--", "-", "Chennai", "chennai.", "600 002", "600002", "x", "Ward 3"]
    rows = [(k % 7, at, " ".join(rng.choices(parts, k=rng.randint(1, 3))) if rng.random() < 0.9 else None) for at, k in enumerate(rng.choices(range(50), k=400))]
    wanted = {}
    for key, _, value in sorted(rows, key=lambda r: r[1]):
        if value is None:
            continue
        signs = lambda t: re.sub("[^a-z0-9]", "", t.lower())
        kept = wanted.setdefault(key, [])
        if not any(value in x or (signs(value) and signs(value) in signs(x)) for x in kept):
            kept.append(value)
    df = spark.createDataFrame(rows, "key long, at long, value string")
    for bound in (1_000, 2):
        monkeypatch.setattr(aggregate, "LONG_LIST", bound)
        assert {r.key: r.kept for r in aggregate.fold_contained(df, "key", "value", "at", "kept").collect()} == wanted


def test_tax_values(spark):
    from quillflow.functions import money

    texts = [
        ("Output IGST - TN | 3,060.00", None, 3060.0), ("Output IGST@18%  18 %  219.60", 18.0, 219.6), ("CGST 9% 90.00\nSGST 9 % 90.00", 18.0, 180.0), ("cgst 9%\nno", 9.0, None), ("igst 45%\nIGST 12%\nIGST 5%", 12.0, None),
        ("9% 1,000.00 9 % 1,000.00", 18.0, None), ("9% 1.00 6% 1.00\ngst 5% 2.00", 5.0, 2.0), ("Total Tax Amount 1,234.50 of 2.00", None, 2.0), ("IGST 0.00\nGST 7.00", None, None), ("CGST 0.00\nSGST 7.00", None, 7.0), ("plain 18% 5.00", None, None), ("", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(texts)], "k int, text string")
    for r in df.select("k", money.tax_rate_near(F.col("text")).alias("rate"), money.tax_amount_near(F.col("text")).alias("amount")).collect():
        assert (r.rate, r.amount) == texts[r.k][1:], texts[r.k]


def test_template_for_path(spark):
    from quillflow.operators.joins import template_for_path

    files = [(1, "PT/PART/a/b/f.pdf"), (2, "PT\\PART\\a\\f.pdf"), (3, "PT/PART/x/y/f.pdf"), (4, "PT/PART/f.pdf"), (5, None), (6, "/PT//SERVICE/z/f.pdf"), (7, "PT/PART/a/c/d/f.pdf")]
    known = [("PT/PART/a/b", True), ("PT/PART/a", True), ("PT/PART", True), ("PT/SERVICE/z", False), ("PT/PART/a/c/d", False), ("PT/PART/a/c/d", True), ("PT", True)]
    found = template_for_path(spark.createDataFrame(files, "id int, path string"), "id", "path", spark.createDataFrame(known, "key string, active boolean"))
    assert {r.id: (r.exact, r.nearest) for r in found.collect()} == {
        1: ("PT/PART/a/b",) * 2, 2: ("PT/PART/a",) * 2, 3: (None, "PT/PART"), 4: (None, None), 5: (None, None), 6: (None, None), 7: ("PT/PART/a/c/d",) * 2}


def test_labels_in_lines_same_as_boxes(spark):
    from quillflow.operators import layout

    texts = [(1, "No is 5\nx y z\nis"), (2, "a is\nb c\nd | is x\nis"), (3, "is\nis is\n"), (4, None), (5, "island"), (6, "a  is  b\n1 2 3 4")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")).where(~F.contains("line", F.lit("|")))
    boxes = lines.select("doc_id", (F.col("idx") + 1).cast("long").alias("idx"), F.posexplode(F.split("line", " ")).alias("x", "word")).withColumn("x", F.col("x").cast("long") + 1)
    wanted = layout.beside_or_below(boxes, ["doc_id"], "idx", "x", "word", F.col("word").isin("is")).select("doc_id", "idx", "x", F.col("word").alias("label"), "value", "side")
    found = layout.labels_in_lines(docs, "doc_id", "text", ("is",))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) and found.count() == 8


def test_numbers_by_ranges(spark):
    """Two million rows of few prefixes in twenty ranges, and turns by counted groups."""
    from pyspark.sql.window import Window

    from quillflow.operators import window

    rows = spark.range(2_000_000).select(F.pmod(F.col("id") * 7919, F.lit(2_000_003)).alias("id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("P"), (F.col("id") % 3).cast("string"))).alias("prefix"))
    last = spark.createDataFrame([("P0", 100), ("P1", 5)], "prefix string, last int")
    minted = window.mint(rows, "prefix", "id", last, "no", part_rows=100_000)
    assert "repartition" not in minted._jdf.queryExecution().toString().lower()
    checks = minted.groupBy("prefix").agg(F.count("*").alias("n"), F.countDistinct("no").alias("d"), F.min("no").alias("low"), F.max("no").alias("high")).collect()
    for r in checks:
        start = {"P0": 100, "P1": 5, "P2": 0, None: 0}[r.prefix]
        assert r.prefix is None or (r.n == r.d and r.low == f"{r.prefix}{start + 1:06d}" and int(r.high[2:]) == start + r.n)
    ordered = minted.where("prefix is not null").select("prefix", "id", F.substring("no", 3, 9).cast("long").alias("no"))
    assert ordered.withColumn("back", F.lag("no").over(Window.partitionBy("prefix").orderBy("id"))).where("no <= back").count() == 0
    bounds = window.range_bounds(rows, "id", 100_000)
    assert len(bounds) >= 15
    some = spark.createDataFrame([(v,) for v in (None, -1, *bounds, 3_000_000)], "v long")
    assert [r.p for r in some.select(window.range_of(F.col("v"), bounds).alias("p")).collect()] == [0, 0, *range(len(bounds)), len(bounds)]
    files = spark.range(3_000).select((F.col("id") % 2).alias("kind"), (F.col("id") % 7).alias("size"), F.when(F.col("id") % 4 > 0, "p").alias("path"), "id")
    wanted = files.select("id", F.row_number().over(Window.partitionBy("kind").orderBy("size", "path", "id")).alias("turn"))
    assert sorted(map(tuple, window.turns(files, "kind", ["size", "path"], "id", "turn", 500).select("id", "turn").collect())) == sorted(map(tuple, wanted.collect()))


def test_tax_amounts_round_as_sql_does(spark, tmp_path):
    # 0.285 * 100 is below 28.5 and 1.115 * 100 above 111.5, whatever their decimal digits say.
    from quillflow.plans import documents, registry

    rows = [(1, k, 4, 1, price, 1.0, "R") for k, price in enumerate((0.285, 1.005, 1.115, 8.575, 2.5, 1250.475, 2094.825))] + [(2, 1, 4, 1, None, 1.0, "R")]
    df = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_tax double, l_returnflag string")
    df.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    wanted = con.execute(registry.load()[1]["tax_near_keyword"]).fetchall()
    assert sorted(map(tuple, documents.tax_near_keyword(spark, str(tmp_path)).collect())) == sorted(wanted)
    assert {row[5] for row in wanted} >= {0.28, 1.12, 8.57}


def test_link_keys_counts_within_orders(spark, tmp_path):
    from quillflow.plans import documents, registry

    orders = [(3, "P"), (4, "P"), (5, "P"), (5, "P"), (6, "F")]
    lines = [(3, 1, 2.0, 0.08), (3, 1, 3.0, 0.0), (3, 2, 1.0, 0.08), (5, 1, 4.0, 0.0), (5, 2, None, 0.0), (6, 1, 1.0, 0.0), (7, 1, 1.0, 0.0)]
    con = duckdb.connect()
    for name, rows, schema in (("orders", orders, "o_orderkey long, o_orderstatus string"), ("lineitem", lines, "l_orderkey long, l_linenumber int, l_quantity double, l_tax double")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = documents.link_keys(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(registry.load()[1]["link_keys"]).fetchall())
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2  # orders and their lines; cells aren't grouped
