"""Best-fit packing of token pieces into sequences of at most `CAPACITY` ids.

Each task packs online with bounded space: at most `OPEN_BINS` bins are open, kept in a bitset keyed
by free space, so the tightest bin that holds a piece is the lowest set bit at or above its length.
When nothing fits and all bins are open, the fullest closes. Pieces as long as a sequence close at
once. The bins that a task leaves open (at most OPEN_BINS) go through a second, coarser round as
pieces of their own, so the number of tasks costs almost nothing in sequences.

Only lengths are shuffled, never ids or texts; partitions hold about `PACK_ROWS` pieces, so the work
of a task stays the same at any size, and a source with a third of the rows spreads by doc_id.

Defined cases: a null or empty text is its end id alone; a text of 4096 ids is one full piece, of
4097 two; very long texts are cut into as many as they need; of bins with equal space (ties) the last one
put there is taken; repeated rows are packed each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import arrow_batches, texts, written
from quillflow.llm.encode import encoder

CAPACITY = 4096
OPEN_BINS = 512
PACK_ROWS = 50_000
END_ID = 1
_SECOND_ROUND = 1 << 62

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Online best fit over at most `most` open bins; `place` returns (bin, offset, is it full now)."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.mask = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = defaultdict(list)
        self.open = self.count = 0

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its offset there."""
        fits = self.mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.most and length < self.capacity:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
                self.open -= 1
            bin_, free = self.count, self.capacity
            self.count += 1
            self.open += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.mask |= 1 << left
        else:
            self.open -= 1
        return bin_, self.capacity - free

    def left_open(self) -> dict[int, int]:
        """Used space of each bin that is still open."""
        return {b: self.capacity - free for free, bins in self.by_free.items() for b in bins}


def pieces_of(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of every document: where they start, how long they are, the CRC-32 of their ids."""
    arrow_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, offsets = encoder(tokenizer, False).encode(texts(batch))
            rows = []
            for doc_id, low, high in zip(batch.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                data = ids[low:high].tobytes() + end
                for piece, at in enumerate(range(0, len(data), 4 * CAPACITY)):
                    part = data[at : at + 4 * CAPACITY]
                    rows.append((doc_id, piece, at >> 2, len(part) >> 2, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _round(items: DataFrame, key: str, first: int) -> DataFrame:
    """Adds bin, offset and, for bins left open by a task, their used space; one packer a task."""
    names = items.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = BestFit()
        base = first + (TaskContext.get().partitionId() << 32)
        for batch in batches:
            found = [packer.place(n) for n in batch.column("length").to_pylist()]
            bins, offsets = (np.array(c, np.int64) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            arrays = [*batch.columns, pa.array(bins + base), pa.array(offsets), pa.nulls(len(bins), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "bin", "offset", "used"])
        rest = packer.left_open()
        if rest:
            nothing = [pa.nulls(len(rest), f.type) for f in batch.schema]
            arrays = [*nothing, pa.array(np.array(list(rest), np.int64) + base), pa.nulls(len(rest), pa.int64()), pa.array(list(rest.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "bin", "offset", "used"])

    parts = max(1, -(-items.count() // PACK_ROWS))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in items.schema)
    dealt = items.repartition(parts, key).sortWithinPartitions(*names)
    return dealt.mapInArrow(pack, f"{schema}, bin long, offset long, used long")


def pack(pieces: DataFrame) -> DataFrame:
    """The pieces with sequence_id and offset."""
    pieces = written(pieces, "pieces")
    first = written(_round(pieces, "doc_id", 0), "packed")
    loose = first.where("used is not null").select(F.col("bin").alias("loose"), F.col("used").alias("length"))
    second = _round(loose, "loose", _SECOND_ROUND).where("used is null")
    moved = written(second.select(F.col("loose").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("by")), "moved")
    placed = first.where("used is null").join(moved, "bin", "left")
    return placed.select(*pieces.columns, F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """All pieces of all documents with their places."""
    return pack(pieces_of(docs, tokenizer))
