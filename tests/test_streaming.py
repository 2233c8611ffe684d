"""Stream operators as streams, against the same operators on the static table."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillflow.streaming import events as ops

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet(f"{FOLDER}/events.parquet").repartitionByRange(4, "ts").write.parquet(path)
    return path


def drained(spark, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_tumbling(spark, folder):
    static = ops.tumbling_counts(spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")))
    stream = drained(spark, ops.tumbling_counts(ops.event_stream(spark, folder), late="40 days"), "tumbling")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, static.collect()))


def test_sessions(spark, folder):
    static = ops.sessions(spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")))
    stream = drained(spark, ops.sessions(ops.event_stream(spark, folder), late="40 days"), "sessions")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, static.collect()))


def test_touches(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 1L, TIMESTAMP '2024-01-01 00:00:00'), (2, 1L, TIMESTAMP '2024-01-01 00:00:30'), (3, 1L, TIMESTAMP '2024-01-01 00:01:00'), (4, 2L, TIMESTAMP '2024-01-01 00:00:10') t(event_id, user_id, ts)")
    assert sorted(r.event_id for r in ops.sampled_touches(rows, 60).collect()) == [1, 3, 4]


def test_touches_as_stream(spark, folder):
    wanted = ops.sampled_touches(spark.read.parquet(folder), 3600).collect()
    df = ops.touches(ops.event_stream(spark, folder), 3600)
    query = df.writeStream.format("memory").queryName("touches").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert sorted((r.user_id, r.event_id) for r in spark.table("touches").collect()) == sorted((r.user_id, r.event_id) for r in wanted)


def test_upsert_batches(spark, folder, tmp_path):
    from quillflow.operators.merge import upsert_soft_delete
    from quillflow.sources.sinks import replace

    state = {"path": replace(spark.createDataFrame([], "user_id long, n long, active boolean"), str(tmp_path / "t"), 0)}

    def merge(batch, number):
        old = spark.read.parquet(state["path"])
        counts = batch.groupBy("user_id").agg(F.count("*").alias("m"))
        new = counts.join(old, "user_id", "left").select("user_id", (F.col("m") + F.coalesce("n", F.lit(0))).alias("n"))
        merged = upsert_soft_delete(old, new, ["user_id"], ["n"]).withColumn("active", F.lit(True))
        state["path"] = replace(merged, str(tmp_path / "t"), number + 1)

    ops.upsert_batches(ops.event_stream(spark, folder, 1), merge, str(tmp_path / "check")).awaitTermination(180)
    wanted = spark.read.parquet(folder).groupBy("user_id").count().collect()
    assert {r.user_id: r.n for r in spark.read.parquet(state["path"]).collect()} == {r.user_id: r["count"] for r in wanted}


def test_sinks(spark, tmp_path):
    from quillflow.sources import sinks, tables

    docs = spark.createDataFrame([("a", "x", [(1, "p"), (2, "q")]), ("b", "y", [])], "no string, kind string, items array<struct<qty:int,name:string>>")
    sinks.write_documents(docs, str(tmp_path / "json"), ["kind"])
    assert tables.files(spark, str(tmp_path / "json"), "*.json").count() >= 1
    back = tables.json_documents(spark, str(tmp_path / "json"))
    assert back.count() == 2
    header, lines = sinks.shred(docs, "no", "items")
    assert header.columns == ["no", "kind"] and [tuple(r) for r in lines.orderBy("line_no").collect()] == [("a", 10000, 1, "p"), ("a", 20000, 2, "q")]
    sinks.write_sheets({"Header": header}, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "Header")).count() == 2


@pytest.fixture
def slices(spark, tmp_path):
    """Events as four files, written one after another in order of time."""
    path = str(tmp_path / "slices")
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    for k in range(4):
        events.where(F.floor(F.dayofmonth("ts") / 8) == k).coalesce(1).write.mode("append").parquet(path)
    return path


def test_throttled_as_stream(spark, slices):
    from quillflow.operators.window import trailing_count

    events = spark.read.parquet(slices).withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    by = F.row_number().over(Window.partitionBy("user_id").orderBy("at", "event_id"))
    ordered = events.withColumn("rn", by).withColumn("n", trailing_count(["user_id"], F.col("at"), 43200))
    # rows of the same second: those that come later in the order don't count yet
    after = F.count("*").over(Window.partitionBy("user_id", "at").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing))
    wanted = ordered.withColumn("n", F.col("n") - after).where("n > 3").select("user_id", "event_id").collect()
    df = ops.throttled(ops.event_stream(spark, slices, 1), 3, 43200)
    df.writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
    found = spark.table("throttled").select("user_id", "event_id").collect()
    assert len(wanted) > 10 and sorted(map(tuple, found)) == sorted(map(tuple, wanted))


def test_expired_as_stream(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = [(1, "2024-01-01 00:00:00", 1), (2, "2024-01-01 00:00:00", 2), (3, "2024-01-05 00:00:00", 1), (4, "2024-01-20 00:00:00", 3), (5, "2024-01-30 00:00:00", 4)]
    for k, row in enumerate(rows):
        df = spark.createDataFrame([row], "event_id long, ts string, user_id long").selectExpr("event_id", "cast(ts AS timestamp_ntz) AS ts", "user_id", "'x' AS event_type", "1.0D AS value", "'' AS props")
        df.coalesce(1).write.mode("append").parquet(path)
    df = ops.expired(ops.event_stream(spark, path, 1), 10 * 86400)
    df.writeStream.format("memory").queryName("expired").outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    found = {r.user_id: r.last for r in spark.table("expired").collect()}
    last = {u: spark.sql(f"SELECT unix_timestamp(TIMESTAMP '{t}') AS t").first().t for u, t in ((1, "2024-01-05"), (2, "2024-01-01"))}
    assert found == last  # user 3 was last seen less than ten days before the watermark, user 4 is newest


def test_retry_pending(spark, folder, tmp_path):
    known = {0: [8], 1: [8, 46], 2: list(range(1000)), 3: list(range(1000))}
    calls = []

    def resolve(rows):
        number = len(calls)
        calls.append(number)
        lookup = spark.createDataFrame([(u,) for u in known[number]], "user_id long").withColumn("resolved", F.lit(True))
        return rows.join(lookup, "user_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))

    out = str(tmp_path / "out")
    ops.upsert_batches(ops.event_stream(spark, folder, 1), ops.retry_pending(resolve, out), str(tmp_path / "check")).awaitTermination(240)
    assert len(calls) == 4
    resolved = [{r.event_id for r in spark.read.parquet(f"{out}/resolved/{k}").collect()} for k in range(4)]
    assert resolved[0] and all(r.user_id == 8 for r in spark.read.parquet(f"{out}/resolved/0").collect())
    every = {r.event_id for r in spark.read.parquet(folder).collect()}
    assert sum(map(len, resolved)) == len(every) and set().union(*resolved) == every
    assert spark.read.parquet(f"{out}/pending/3").count() == 0 and spark.read.parquet(f"{out}/pending/1").count() > 0
