"""Event streams: the same transformations on streaming and static tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Events appended as Parquet files to a folder, with event time as a timestamp."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per window and type; a stream drops what comes later than `late`."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("begins"), "event_type", "n")


def sessions(events: DataFrame, idle: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions per user closed after an idle time; they end when last seen."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("begins"), F.max("ts").alias("ends"))
    return grouped.select("user_id", "begins", "ends", "n")


def sampled_touches(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Events that refresh a user's last-seen time: at most one in `seconds`, each after the last kept one.

    Sequential per user; a user's events are streamed through in order with one number as state.
    """

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, last = None, 0.0
        for batch in batches:
            kept = []
            for who, at in zip(batch["user_id"], batch["at"], strict=True):
                if who != user or at - last >= seconds:
                    user, last = who, at
                    kept.append(True)
                else:
                    kept.append(False)
            yield batch[kept]

    rows = events.select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInPandas(keep, rows.schema)


def first_wins(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key; a stream forgets keys once they are older than `late`."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def touches(events: DataFrame, seconds: int = 60) -> DataFrame:
    """`sampled_touches` as a stateful stream: the state is the time of a user's last kept event."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        kept = []
        for event_id, at in zip(rows["event_id"], rows["at"], strict=True):
            if last is None or at - last >= seconds:
                last = int(at)
                kept.append((key[0], event_id, last))
        state.update((last,))
        yield pd.DataFrame(kept, columns=["user_id", "event_id", "at"])

    rows = events.select("user_id", "event_id", F.unix_timestamp("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, at long", "last long", "append", "NoTimeout")


def upsert_batches(events: DataFrame, merge, checkpoint: str):
    """Starts a stream that hands each micro-batch to `merge(batch, number)`, over what is there now."""
    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttled(events: DataFrame, limit: int = 10, seconds: int = 900) -> DataFrame:
    """The events over a user's limit in the trailing span, as a stateful stream: user_id, event_id, at.

    The state is the times of at most `limit` last events, which is all that the next one's verdict needs.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        over = []
        for event_id, at in zip(rows["event_id"], rows["at"], strict=True):
            recent = [t for t in recent if at - t <= seconds][-limit:]
            if len(recent) >= limit:
                over.append((key[0], event_id, int(at)))
            recent.append(int(at))
        state.update((recent[-limit:],))
        yield pd.DataFrame(over, columns=["user_id", "event_id", "at"])

    rows = events.select("user_id", "event_id", F.unix_timestamp("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, at long", "recent array<long>", "append", "NoTimeout")


def expired(events: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Users not seen for a time to live, as a stream with event-time timers: user_id and when last seen.

    The state is the last time; each event moves the timer, which fires once the watermark has passed it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], last)], columns=["user_id", "last"])
            return
        last = max(int(batch["at"].max()) for batch in batches)
        if state.exists:
            last = max(last, state.get[0])
        state.update((last,))
        state.setTimeoutTimestamp(max(1000 * (last + seconds), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([], columns=["user_id", "last"])

    rows = events.withWatermark("ts", late).select("user_id", "ts", F.unix_timestamp("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, last long", "last long", "append", "EventTimeTimeout")


def retry_pending(resolve, folder: str):
    """A `merge` for upsert_batches that tries pending rows again with each micro-batch.

    resolve(rows) joins rows with the lookup as it stands now and returns them with a boolean `resolved`.
    Resolved rows go to `folder`/resolved/n, the others to `folder`/pending/n, for batch n; a batch that
    runs again overwrites its own two folders and nothing else, so no row is lost or doubled.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/pending/{number - 1}"))
        tried = resolve(rows).persist()
        tried.where("resolved").drop("resolved").write.mode("overwrite").parquet(f"{folder}/resolved/{number}")
        tried.where("not coalesce(resolved, false)").select(batch.columns).write.mode("overwrite").parquet(f"{folder}/pending/{number}")
        tried.unpersist()

    return merge
