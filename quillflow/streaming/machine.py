"""Life cycle of documents as a keyed state machine: legal moves, late uploads, and a ledger of what each event did.

A document's state is its status, the statuses it was excluded or marked from, and its generation. Events are
uploads, results of runs and users' actions; each is answered by a row (kind) that tells what it did:

* created: the first upload; reworked: an upload over a status that asks for one, in place; renewed: an upload over
  one that waits for others, as a new generation; duplicate: any other upload, which changes nothing;
* moved: a legal move; illegal: one that the table of moves doesn't have; late: an event that is older than the
  last one that changed the document. Neither of the two changes anything.

Events without a document are left out. `lifecycle` is the stream, with `transformWithStateInPandas` keyed by document; `replay` is the same over a static
table, streamed through in order with one state in hand. Both use `step`. `ledger_sink` feeds an audit table, a
mirror of the current states and a table of refused events from one micro-batch, once for each batch number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a run may find, the moves of the life cycle, and the statuses of each rule.
RUN_RESULTS = ("DUPLICATE", "NEW TEMPLATE", "UNSUPPORTED", "BUYER ORDER NO DOESN'T EXIST", "PENDING IN SF", "DATA MISMATCH", "READY TO LOAD")
MOVES = {
    "load": (("READY TO LOAD", "REJECTED BY ACCOUNTS"), "LOADED"),
    "post": (("LOADED",), "POSTED"),
    "complete": (("POSTED",), "COMPLETED"),
    "reject": (("LOADED",), "REJECTED BY ACCOUNTS"),
    "expire": (("DATA MISMATCH", "EXCLUDED", "NEW TEMPLATE", "BUYER ORDER NO DOESN'T EXIST"), "MANUALLY UPDATED"),
}
REWORKABLE = ("EXCLUDED", "NEW TEMPLATE", "UNSUPPORTED")
WAITING = ("PENDING IN SF",)
MARKABLE = ("BUYER ORDER NO DOESN'T EXIST", "DATA MISMATCH")
STAYING = ("LOADED", "POSTED", "COMPLETED", "REJECTED BY ACCOUNTS", "EXCLUDED", "MANUALLY UPDATED")

CHANGED = ("created", "reworked", "renewed", "moved")
OUT = "document long, event_id long, at long, kind string, before string, after string, generation int"
_STATE = "status string, excluded string, marked string, generation int, at long, event_id long"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


class State(NamedTuple):
    """A document's state and the last event that changed it."""

    status: str
    excluded: str | None
    marked: str | None
    generation: int
    at: int
    event_id: int


def answer(state: State | None, action: str, target: str | None) -> tuple[str, str, str | None, str | None, int] | str:
    """(kind, status, excluded, marked, generation) of a change, or the kind of an event that changes nothing."""
    if action == "upload":
        if state is None:
            return "created", "INITIATED", None, None, 1
        if state.status in REWORKABLE:
            return "reworked", "INITIATED", None, None, state.generation
        return ("renewed", "INITIATED", None, None, state.generation + 1) if state.status in WAITING else "duplicate"
    if state is None:
        return "illegal"
    status, excluded, marked, generation = state[:4]
    if action == "run" and status == "INITIATED" and target in RUN_RESULTS:
        return "moved", target, excluded, marked, generation
    if action == "exclude" and status not in STAYING:
        return "moved", "EXCLUDED", status, marked, generation
    if action == "include" and status == "EXCLUDED" and excluded:
        return "moved", excluded, None, marked, generation
    if action == "mark" and status in MARKABLE:
        return "moved", "NEW TEMPLATE", excluded, status, generation
    if action == "revert" and status == "NEW TEMPLATE" and marked:
        return "moved", marked, excluded, None, generation
    if action in MOVES and status in MOVES[action][0]:
        return "moved", MOVES[action][1], excluded, marked, generation
    return "illegal"


def step(document: int, state: State | None, event_id: int, at: int, action: str, target: str | None) -> tuple[State | None, tuple]:
    """The state after an event, and the event's row."""
    before = state.status if state else None
    found = "late" if state and (at, event_id) <= (state.at, state.event_id) else answer(state, action, target)
    if isinstance(found, str):
        return state, (document, event_id, at, found, before, before, state.generation if state else 0)
    kind, *fields = found
    state = State(*fields, at, event_id)
    return state, (document, event_id, at, kind, before, state.status, state.generation)


def _shaped(events: DataFrame) -> DataFrame:
    return events.where("document is not null").select("document", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "action", "target")


def replay(events: DataFrame) -> DataFrame:
    """The rows of all events (document, event_id, ts, action, target), taken in order of time, then id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            rows = []
            for document, event_id, at, action, target in batch.itertuples(index=False):
                if document != now:
                    now, state = document, None
                state, row = step(document, state, event_id, at, action, target)
                rows.append(row)
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return _shaped(events).repartition("document").sortWithinPartitions("document", "at", "event_id").mapInPandas(run, OUT)


class _Lifecycle(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", _STATE)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = State(*self.state.get()) if self.state.exists() else None
        out = []
        # A key's rows of one micro-batch, in order; what came in earlier batches is in the state.
        for row in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples(index=False):
            state, found = step(key[0], state, row.event_id, row.at, row.action, row.target)
            out.append(found)
        if state:
            self.state.update(tuple(state))
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def lifecycle(events: DataFrame) -> DataFrame:
    """`replay` as a stream; the state of a document is kept in RocksDB."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return _shaped(events).groupBy("document").transformWithStateInPandas(_Lifecycle(), OUT, "Append", "None")


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def last_batch(spark: SparkSession, folder: str) -> int:
    """The number of the last batch that is wholly in the ledger, -1 for none."""
    path, files = _path(spark, f"{folder}/done")
    return max((int(f.getPath().getName()) for f in files.listStatus(path)), default=-1) if files.exists(path) else -1


def ledger_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: audit rows, refused events and the mirror of current states, each batch once.

    Batch n writes audit/batch=n, refused/batch=n and mirror/n, the last one from the mirror before it, and then
    marks itself done. A batch that comes again is left out if it is done; one that was cut off overwrites its own
    folders. Readers take batches up to the last one that is done, so they never see half of one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = last_batch(spark, folder)
        if number <= last:
            batch.write.format("noop").mode("overwrite").save()  # the stream's own state is still due
            return
        rows = batch.persist()
        changed = rows.where(F.col("kind").isin(*CHANGED))
        changed.write.mode("overwrite").parquet(f"{folder}/audit/batch={number}")
        rows.where(~F.col("kind").isin(*CHANGED)).write.mode("overwrite").parquet(f"{folder}/refused/batch={number}")
        newest = changed.groupBy("document").agg(F.max_by(F.struct(*_COLUMNS[1:]), F.struct("at", "event_id")).alias("f")).select("document", "f.*")
        if last >= 0:
            newest = newest.unionByName(spark.read.schema(OUT).parquet(f"{folder}/mirror/{last}").join(newest.select("document"), "document", "left_anti"))
        newest.write.mode("overwrite").parquet(f"{folder}/mirror/{number}")
        rows.unpersist()
        path, files = _path(spark, f"{folder}/done/{number}")
        files.create(path, True).close()
        for old in (f for f in files.listStatus(_path(spark, f"{folder}/mirror")[0]) if int(f.getPath().getName()) < last):
            files.delete(old.getPath(), True)

    return merge


def ledger(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(audit, refused, mirror) of all batches that are done."""
    last = last_batch(spark, folder)
    if last < 0:
        empty = spark.createDataFrame([], OUT)
        return empty, empty, empty
    audit, refused = (spark.read.schema(f"{OUT}, batch int").parquet(f"{folder}/{name}").where(F.col("batch") <= last).drop("batch") for name in ("audit", "refused"))
    return audit, refused, spark.read.schema(OUT).parquet(f"{folder}/mirror/{last}")
