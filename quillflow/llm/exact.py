"""Exact dedup through a sharded cuckoo-filter index of live digests.

Texts are equal when identical after lower-casing A-Z. A text's key is the SHA-256 of its lower-cased
UTF-8. The index has one `CuckooIndex` per digest shard: a filter of 16-bit fingerprints, four to a
bucket, each beside the number of its record in the shard's content table (full digest, largest
doc_id, live count). A fingerprint hit counts only when the full digest in the record equals the
sought one; an insertion that finds no free slot after `MAX_KICKS` moves doubles the filter and
re-inserts the stored keys. Deleting a digest frees its slot.

Scale: each map task first merges its own rows in an index, so a text that makes up a third of all
rows sends one record per task (or each `shard_keys` distinct texts, after which a task sends and empties
its index); shards are then merged by digest prefix, each bounded by `shard_keys` distinct texts on
average. An update reads and shuffles the touched shards alone. The text itself is never shuffled for the
result.

Defined cases: a null text counts as empty; a null doc_id never wins over another; repeated rows each
count in group_size and each get a row, all of them `kept` when their id is the largest (ties); very long
texts are hashed whole; an empty table gives no rows; other columns are ignored by `dedup_exact` and kept by `drop_duplicates`.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillflow.llm.common import arrow_batches, own_name, texts, written

SLOTS = 4
MAX_KICKS = 200
SHARD_KEYS = 200_000
_PARTIAL = "shard int, digest binary, keep_id long, group_size long"


class CuckooIndex:
    """Fingerprints in a cuckoo filter, each pointing at a verified record [digest, largest id, count]."""

    def __init__(self, buckets: int = 1024):
        self.records: list[list | None] = []
        self.free: list[int] = []
        self.resizes = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.prints = array("H", bytes(2 * SLOTS * buckets))  # 0: free
        self.at = array("q", bytes(8 * SLOTS * buckets))

    @staticmethod
    def _print(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def _home(self, digest: bytes) -> int:
        return int.from_bytes(digest[:8], "little") & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def find(self, digest: bytes) -> int:
        """The record's number, -1 when the digest isn't live. A print alone never decides."""
        mark, home = self._print(digest), self._home(digest)
        for bucket in (home, self._other(home, mark)):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.prints[slot] == mark and self.records[self.at[slot]][0] == digest:
                    return self.at[slot]
        return -1

    def _place(self, digest: bytes, number: int) -> bool:
        mark, bucket = self._print(digest), self._home(digest)
        for kick in range(MAX_KICKS):
            for b in (bucket, self._other(bucket, mark)):
                for slot in range(SLOTS * b, SLOTS * b + SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.at[slot] = mark, number
                        return True
            bucket = self._other(bucket, mark)
            slot = SLOTS * bucket + kick % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            number, self.at[slot] = self.at[slot], number
            bucket = self._other(bucket, mark)
        return False

    def add(self, digest: bytes, doc_id: int | None, count: int = 1) -> int:
        """Inserts a digest or merges into its record (null is the least id); returns the record's number."""
        number = self.find(digest)
        if number >= 0:
            record = self.records[number]
            if record[1] is None or (doc_id is not None and doc_id > record[1]):
                record[1] = doc_id
            record[2] += count
            return number
        number = self.free.pop() if self.free else len(self.records)
        self.records[number : number + 1] = [[digest, doc_id, count]]
        if not self._place(digest, number):
            self._resize()
        return number

    def _resize(self) -> None:
        """Doubles the filter until all stored keys fit; also covers the key left over by the kicks."""
        while True:
            self.resizes += 1
            self._clear(2 * self.buckets)
            if all(self._place(r[0], k) for k, r in enumerate(self.records) if r is not None):
                return

    def remove(self, digest: bytes, count: int = 1) -> bool:
        """Takes `count` live rows off a digest; at none left its slot is freed. False if not live."""
        number = self.find(digest)
        if number < 0:
            return False
        self.records[number][2] -= count
        if self.records[number][2] <= 0:
            mark, home = self._print(digest), self._home(digest)
            for bucket in (home, self._other(home, mark)):
                for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                    if self.prints[slot] and self.at[slot] == number:
                        self.prints[slot] = 0
            self.records[number] = None
            self.free.append(number)
        return True

    def live(self) -> list[list]:
        """The live records."""
        return [r for r in self.records if r is not None]


def digests(array_: pa.Array) -> list[bytes]:
    """SHA-256 of each text, lower-cased in A-Z only."""
    lowered = pc.ascii_lower(array_).cast(pa.large_binary())
    return [hashlib.sha256(x.as_buffer()).digest() for x in lowered]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and digest of every document, as a table in the shared folder."""
    arrow_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(digests(texts(batch)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), found], names=["doc_id", "digest"])

    return written(docs.select("doc_id", "text").mapInArrow(hashed, "doc_id long, digest binary"), "keyed")


def _records(live: list[list]) -> Iterator[pa.RecordBatch]:
    """Live records as batches of (digest, keep_id, group_size)."""
    kinds = {"digest": pa.binary(), "keep_id": pa.int64(), "group_size": pa.int64()}
    for k in range(0, len(live), 10_000):
        part = live[k : k + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def _shard(digests_: list[bytes], shards: int) -> pa.Array:
    return pa.array([int.from_bytes(d[10:14], "little") % shards for d in digests_], pa.int32())


def _merge(df: DataFrame, shards: int, most: int | None = None) -> DataFrame:
    """Records of (digest, keep_id, group_size) rows merged through one index per task, which is sent and emptied at `most` records."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
            for batch in _records(index.live()):
                yield pa.RecordBatch.from_arrays([_shard(batch.column("digest").to_pylist(), shards), *batch.columns], names=["shard", *batch.schema.names])

        index = CuckooIndex()
        for batch in batches:
            for digest, doc_id, count in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                index.add(digest, doc_id, count)
            if most and len(index.records) >= most:
                yield from sent(index)
                index = CuckooIndex()
        yield from sent(index)

    return df.select("digest", "keep_id", "group_size").mapInArrow(merge, _PARTIAL)


def build_index(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The index's records, one per live digest: shard, digest, keep_id, group_size, and the number of shards."""
    least = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, -(-keys.count() // shard_keys))
    rows = keys.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return _merge(_merge(rows, shards, shard_keys).repartition(shards, "shard"), shards).withColumn("shards", F.lit(shards))


def update_index(index: DataFrame, members: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(index, members) after inserting the documents `added` and deleting the ids `removed`.

    `members` has (doc_id, digest) of the live rows. Only shards with a touched digest are read into a filter
    again: their rows alone are shuffled, the others stay where they lie. Deletions are taken off in the shard's
    filter, which frees slots at zero, and the largest remaining id of a touched digest comes from `members`.
    """
    shards = (index.select("shards").first() or [int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))])[0]
    gone = members.join(removed.select("doc_id").distinct(), "doc_id", "left_semi") if removed is not None else members.limit(0)
    live = members.join(removed.select("doc_id").distinct(), "doc_id", "left_anti") if removed is not None else members
    new = keyed(added) if added is not None else members.limit(0)
    live = live.unionByName(new)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_shard(batch.column("digest").to_pylist(), shards), *batch.columns], names=["shard", *batch.schema.names])

    changes = new.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).unionByName(
        gone.groupBy("digest").agg(F.lit(None).cast("long").alias("keep_id"), (-F.count("*")).alias("group_size"))
    )
    changes = written(changes.mapInArrow(placed, _PARTIAL), "changes")
    touched = F.broadcast(changes.select("shard").distinct())  # one number a shard
    rows = index.join(touched, "shard", "left_semi").drop("shards").unionByName(changes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[CuckooIndex, list[tuple[bytes, int]]]] = {}
        for batch in batches:
            for shard, digest, doc_id, count in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                index_, drops = held.setdefault(shard, (CuckooIndex(), []))
                if count < 0:
                    drops.append((digest, -count))
                else:
                    index_.add(digest, doc_id, count)
        for index_, drops in held.values():
            for digest, count in drops:
                index_.remove(digest, count)
            for batch in _records(index_.live()):
                yield pa.RecordBatch.from_arrays([_shard(batch.column("digest").to_pylist(), shards), *batch.columns], names=["shard", *batch.schema.names])

    merged = rows.repartition(shards, "shard").mapInArrow(apply, _PARTIAL)
    largest = live.join(changes.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("_max"), F.lit(True).alias("_touched"))
    merged = merged.join(largest, "digest", "left").withColumn("keep_id", F.when(F.col("_touched"), F.col("_max")).otherwise(F.col("keep_id")))
    same = index.join(touched, "shard", "left_anti")
    return same.unionByName(merged.drop("_max", "_touched").withColumn("shards", F.lit(shards))), live


def dedup_exact(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest: one row per document."""
    keys = keyed(docs)
    index = build_index(keys).drop("shard", "shards")
    found = keys.join(index, "digest")
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull()).alias("kept"), "digest")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns; of repeated rows of the largest id, one.

    Texts are shuffled once, by doc_id and digest, so an id that stands on several texts keeps a row of
    each text it is the largest id of. Of equal texts that have no id at all, one row stays; such rows
    are found by digest.
    """
    keys = keyed(docs)
    index = written(build_index(keys).select("digest", "keep_id"), "index")
    mark = own_name(docs, "_digest")
    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.BinaryType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(digests(texts(batch)), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, mark])

    stay = index.where("keep_id is not null").select(F.col("keep_id").alias("doc_id"), F.col("digest").alias(mark))
    named = docs.where("doc_id is not null").mapInArrow(hashed, schema)
    kept = named.join(stay, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    nameless = docs.where("doc_id is null").mapInArrow(hashed, schema)
    unclaimed = index.where("keep_id is null").select(F.col("digest").alias(mark))
    return kept.select(docs.columns).unionByName(nameless.join(unclaimed, mark, "left_semi").dropDuplicates([mark]).drop(mark))
