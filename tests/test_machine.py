"""The life cycle as a stream against its replay, restarts in mid-stream, late events, and the ledger's sinks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillflow.plans.streams import ACTION, TARGET
from quillflow.streaming import machine
from quillflow.streaming.events import event_stream

FOLDER = "/root/testdata/sf0.001"


def shaped(events):
    return events.select(F.col("user_id").alias("document"), "event_id", "ts", F.expr(ACTION).alias("action"), F.expr(TARGET).alias("target"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def folder(spark, tmp_path):
    """Events in four files, written one after the other in order of time."""
    path = str(tmp_path / "events")
    events = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("part", F.ntile(4).over(Window.orderBy("ts")))
    for part in range(1, 5):
        events.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(path)
    return path


def started(spark, folder, ledger, checkpoint, sink=None):
    stream = machine.lifecycle(shaped(event_stream(spark, folder, files_per_trigger=1)))
    return stream.writeStream.foreachBatch(sink or machine.ledger_sink(ledger)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def test_stream_same_as_replay_and_restart(spark, folder, tmp_path):
    """The stream fails after its second batch's sinks and before it is committed; the restart changes nothing twice."""
    wanted = rows(machine.replay(shaped(spark.read.parquet(folder))))
    kinds = Counter(r[3] for r in wanted)
    assert min(kinds[k] for k in ("created", "moved", "illegal", "duplicate", "reworked")) > 0
    ledger, checkpoint = str(tmp_path / "ledger"), str(tmp_path / "checkpoint")
    sink = machine.ledger_sink(ledger)

    def failing(batch, number):
        sink(batch, number)
        if number == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        started(spark, folder, ledger, checkpoint, failing).awaitTermination(300)
    assert machine.last_batch(spark, ledger) == 1
    started(spark, folder, ledger, checkpoint).awaitTermination(300)
    audit, refused, mirror = machine.ledger(spark, ledger)
    assert rows(audit.unionByName(refused)) == wanted
    latest = {}
    for r in sorted((r for r in wanted if r[3] in machine.CHANGED), key=lambda r: (r[2], r[1])):
        latest[r[0]] = r
    assert rows(mirror) == sorted(latest.values(), key=str)


def test_repeated_batch_changes_nothing(spark, tmp_path):
    """A batch that comes again, one that was cut off between its sinks, and late events."""
    events = [(1, 1, 10, "upload", None), (1, 2, 20, "run", "READY TO LOAD"), (2, 3, 30, "load", None), (1, 4, 40, "load", None)]
    df = spark.createDataFrame(events, "document long, event_id long, at long, action string, target string").withColumn("ts", F.timestamp_micros("at"))
    found = machine.replay(df)
    folder = str(tmp_path / "ledger")
    sink = machine.ledger_sink(folder)
    assert [t.count() for t in machine.ledger(spark, folder)] == [0, 0, 0]
    sink(found.where("event_id <= 2"), 0)
    found.where("event_id > 2").write.parquet(f"{folder}/audit/batch=1")  # cut off: never seen, overwritten later
    assert [t.count() for t in machine.ledger(spark, folder)] == [2, 0, 1]
    sink(found.where("event_id > 2"), 1)
    once = [rows(t) for t in machine.ledger(spark, folder)]
    sink(found.where("event_id > 2"), 1)
    sink(found, 0)
    assert [rows(t) for t in machine.ledger(spark, folder)] == once
    assert once[2] == [(1, 4, 40, "moved", "READY TO LOAD", "LOADED", 1)] and once[1] == [(2, 3, 30, "illegal", None, None, 0)]


def test_late_uploads_and_events():
    def played(*events):
        state, out = None, []
        for event_id, (at, action, target) in enumerate(events):
            state, row = machine.step(7, state, event_id, at, action, target)
            out.append(row[3:])
        return out

    begun = ((1, "upload", None), (2, "run", "PENDING IN SF"), (3, "upload", None), (4, "run", "UNSUPPORTED"), (5, "upload", None), (6, "run", "DATA MISMATCH"), (7, "upload", None))
    assert [r[0] for r in played(*begun)] == ["created", "moved", "renewed", "moved", "reworked", "moved", "duplicate"]
    assert played(*begun)[-1] == ("duplicate", "DATA MISMATCH", "DATA MISMATCH", 2)
    moves = ((1, "upload", None), (5, "run", "DATA MISMATCH"), (4, "mark", None), (6, "mark", None), (7, "exclude", None), (8, "include", None), (9, "revert", None), (10, "expire", None), (11, "upload", None), (12, "exclude", None))
    assert played(*moves) == [
        ("created", None, "INITIATED", 1), ("moved", "INITIATED", "DATA MISMATCH", 1), ("late", "DATA MISMATCH", "DATA MISMATCH", 1), ("moved", "DATA MISMATCH", "NEW TEMPLATE", 1), ("moved", "NEW TEMPLATE", "EXCLUDED", 1),
        ("moved", "EXCLUDED", "NEW TEMPLATE", 1), ("moved", "NEW TEMPLATE", "DATA MISMATCH", 1), ("moved", "DATA MISMATCH", "MANUALLY UPDATED", 1), ("duplicate", "MANUALLY UPDATED", "MANUALLY UPDATED", 1), ("illegal", "MANUALLY UPDATED", "MANUALLY UPDATED", 1),
    ]
    assert [r[0] for r in played((1, "load", None), (2, "upload", None), (3, "run", "READY TO LOAD"), (4, "load", None), (5, "reject", None), (6, "load", None), (7, "post", None), (8, "complete", None), (9, "load", None))] == [
        "illegal", "created", "moved", "moved", "moved", "moved", "moved", "moved", "illegal"]
