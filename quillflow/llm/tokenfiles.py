"""Token-id shard files with a minimal perfect hash index for constant-time access by document key.

A shard file holds, little-endian: the magic and seven counts; the keys of its documents in ascending
order (int64, first those without a key, as 0, whose number is a count); n + 1 offsets in ids (int64);
one displacement per bucket (int32) and, per hash slot, a 32-bit fingerprint and the key's first row
(uint32): the minimal perfect hash over the distinct keys; then the raw ids (uint16 when the vocabulary
allows, else uint32). A key hashes to a bucket, the bucket's displacement to a slot; the fingerprint rejects other
keys, and the row's two offsets give the payload: no search and no scan.

Writing: documents are range-partitioned by doc_id, then a hash of the text, and sorted, so rows without an id or of
one id spread over tasks; a task writes shards of about
`SHARD_IDS` ids through the file system that the shared folder's address names. File names are new for
each attempt and only the manifest that Spark commits counts, so lost or repeated tasks leave at most
unused files. Reading goes through Spark's binaryFile source.

Defined cases: a null or empty text is its end id alone; rows that repeat a doc_id follow each other in
the order of their texts' hashes and a shard's index points at the first there; null ids come
first and are in no index; an empty table writes no shard; very long texts are written whole; other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import arrow_batches, mix64, running_total, shared_path, texts, written
from quillflow.llm.encode import encoder

MAGIC = b"QFTOKEN2"
SHARD_IDS = 4 << 20
END_ID = 0
_HEAD = struct.Struct("<8s6q")
_MANIFEST = "part int, seq int, name string, first_key long, last_key long, n_docs long, n_ids long"


def _hashes(keys: np.ndarray) -> np.ndarray:
    return mix64(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _slots(hashed: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """The slot of each hash at a displacement; a negative one names its slot."""
    tried = mix64(hashed + shift.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(n)
    return np.where(shift < 0, -shift - 1, tried.astype(np.int64))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(displacements, fingerprints, first rows) of a minimal perfect hash over sorted keys.

    Hash and displace: buckets of about four keys, largest first, each tried with displacements until
    its keys fall in free slots; buckets of one key take a free slot by name.
    """
    distinct, first = np.unique(keys, return_index=True)
    n = len(distinct)
    hashed = _hashes(distinct)
    buckets = max(1, n // 4)
    bucket = (hashed >> np.uint64(33)).astype(np.int64) % buckets
    by = np.argsort(bucket, kind="stable")
    groups = np.split(by, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])
    shift, taken, rows = np.zeros(buckets, np.int32), np.zeros(n, bool), np.zeros(n, np.uint32)
    prints = np.zeros(n, np.uint32)
    order = sorted(range(buckets), key=lambda b: -len(groups[b]))
    free = None
    for b in order:
        members = groups[b]
        if not len(members):
            break
        if len(members) == 1:
            if free is None:
                free = iter(np.flatnonzero(~taken))
            at = np.array([next(free)])
            shift[b] = -int(at[0]) - 1
        else:
            d = 0
            while True:
                tries = np.arange(d, d + 32, dtype=np.int64)
                at = _slots(np.tile(hashed[members], (32, 1)), tries[:, None], n)
                ok = ~taken[at].any(axis=1)
                ok[ok] = [len(set(row)) == len(row) for row in at[ok].tolist()]
                if ok.any():
                    k = int(np.argmax(ok))
                    shift[b], at = tries[k], at[k]
                    break
                d += 32
        taken[at] = True
        rows[at] = first[members]
        prints[at] = (hashed[members] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return shift, prints, rows


def shard_bytes(keys: np.ndarray, nulls: int, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard file of documents in ascending key order, the first `nulls` of which have no key."""
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    shift, prints, rows = build_index(keys[nulls:])
    head = _HEAD.pack(MAGIC, len(keys), nulls, len(prints), len(shift), len(ids), wide)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype("<i8")
    parts = (keys.astype("<i8"), offsets, shift.astype("<i4"), prints.astype("<u4"), (rows + np.uint32(nulls)).astype("<u4"), ids.astype(f"<u{wide}"))
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard file's parts as views of its bytes; `get` returns a key's ids or None."""

    def __init__(self, data: bytes | memoryview):
        magic, n, self.nulls, distinct, buckets, total, wide = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size
        views = []
        for kind, count in (("<i8", n), ("<i8", n + 1), ("<i4", buckets), ("<u4", distinct), ("<u4", distinct), (f"<u{wide}", total)):
            views.append(np.frombuffer(data, kind, count, at))
            at += views[-1].nbytes
        self.keys, self.offsets, self.shift, self.prints, self.rows, self.ids = views

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 when the fingerprint or the key there is another's."""
        if not len(self.prints):
            return np.full(len(keys), -1)
        hashed = _hashes(keys)
        bucket = (hashed >> np.uint64(33)).astype(np.int64) % len(self.shift)
        slot = _slots(hashed, self.shift[bucket].astype(np.int64), len(self.prints))
        row = self.rows[slot].astype(np.int64)
        same = (self.prints[slot] == (hashed & np.uint64(0xFFFFFFFF)).astype(np.uint32)) & (self.keys[row] == keys)
        return np.where(same, row, -1)

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document."""
        row = int(self.find(np.array([key], np.int64))[0])
        return None if row < 0 else self.ids[self.offsets[row] : self.offsets[row + 1]]


def _open(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


def write_shards(docs: DataFrame, tokenizer: str, folder: str | None = None, shard_ids: int = SHARD_IDS) -> tuple[str, DataFrame]:
    """(folder, manifest): the ids of all documents in shard files in ascending doc_id order."""
    spark = docs.sparkSession
    arrow_batches(spark)
    folder = folder or shared_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _open(folder)
        files.create_dir(top, recursive=True)
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            keys, lengths, ids = (np.concatenate(c) for c in list(zip(*held, strict=True))[:3])
            nulls = sum(h[3] for h in held)
            name = f"{part:07d}-{seq:05d}-{uuid.uuid4().hex}.tok"
            with files.open_output_stream(f"{top}/{name}") as out:
                out.write(shard_bytes(keys, nulls, lengths, ids))
            first, last = (int(keys[nulls]), int(keys[-1])) if nulls < len(keys) else (None, None)
            row = (part, seq, name, first, last, len(keys), len(ids))
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["part", "seq", "name", "first_key", "last_key", "n_docs", "n_ids"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("doc_id").cast(pa.int64())
            ids, offsets = encoder(tokenizer, True).encode(texts(batch))
            ids = np.insert(ids, offsets[1:], np.uint32(END_ID))
            held.append((keys.fill_null(0).to_numpy(), np.diff(offsets) + 1, ids.astype(np.uint16) if ids.max() <= 0xFFFF else ids, keys.null_count))
            size += len(ids)
            if size >= shard_ids:
                yield flush()
                seq, held, size = seq + 1, [], 0
        if held:
            yield flush()

    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return folder, written(ordered.mapInArrow(write, _MANIFEST), "manifest")


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, looked up in the shard files by key."""
    spark = manifest.sparkSession
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(content.as_buffer())
                at = np.arange(len(shard.keys))
                again = np.concatenate(([False], shard.keys[1:] == shard.keys[:-1])) & (at != shard.nulls) | (at < shard.nulls)
                row = np.where(again, at, shard.find(shard.keys))  # repeated keys follow their first row
                if (row < 0).any():
                    raise ValueError(f"a key of {path} is not in its index")
                low, high = shard.offsets[row], shard.offsets[row + 1]
                crc = [zlib.crc32(shard.ids[a:b].astype("<u4").tobytes()) for a, b in zip(low, high, strict=True)]
                ids = pa.array(shard.keys, mask=at < shard.nulls)
                name = pa.array([path.rsplit("/", 1)[-1]] * len(row), pa.string())
                yield pa.RecordBatch.from_arrays([name, ids, pa.array(low), pa.array(high - low), pa.array(crc, pa.int64())], names=["name", "doc_id", "low", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder).select("path", "content")
    found = files.mapInArrow(look, "name string, doc_id long, low long, n_tokens long, ids_crc32 long")
    begin = running_total(manifest.select("part", "seq", "name", "n_ids"), "part", "seq", "n_ids", "begin").select("name", "begin")
    return found.join(begin, "name").select("doc_id", (F.col("begin") + F.col("low")).alias("start"), "n_tokens", "ids_crc32")


def lookup(folder: str, manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """doc_id and ids of the wanted keys (doc_id): each shard answers the keys in its range by index."""
    wanted = keys.select("doc_id").where("doc_id is not null").distinct()
    ranged = manifest.select("name", "first_key", "last_key").join(wanted, F.col("doc_id").between(F.col("first_key"), F.col("last_key")))
    asked = ranged.groupBy("name").agg(F.collect_list("doc_id").alias("keys"))  # bounded by a shard's documents
    files = keys.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(asked, "name")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, keys_ in zip(batch.column("content"), batch.column("keys").to_pylist(), strict=True):
                shard = Shard(content.as_buffer())
                found = [(k, ids.tolist()) for k in keys_ if (ids := shard.get(k)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return files.mapInArrow(answer, "doc_id long, ids array<long>")
