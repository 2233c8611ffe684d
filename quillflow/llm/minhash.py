"""Near duplicates by banded MinHash, with odd sketches that weigh the candidates before whole sets are read.

A document's set holds the 64-bit hashes of its distinct five-word shingles (lower-cased in A-Z); documents
with equal sets form one node. Sets link if their Jaccard similarity J is 0.85 or more.

* MinHash: `SAMPLES` hash functions give a sample each; two sets agree in a sample with probability J.
* Bands: `ROWS` samples make a band's key; sets that share a key meet. At J = 0.85 none of the 32 bands of 4
  agrees with probability (1 - 0.85^4)^32 = 6e-11, the risk of a link that is never seen.
* Odd sketch: each sample toggles one bit of a bitmap of `BITS` bits, so the XOR of two sketches has an odd
  count's bit where samples differ. From its population count z, the number of differing samples is about
  -BITS/2 ln(1 - 2z/BITS), most precise where J is high. Pairs that differ in more than `DIFFER` samples by
  that estimate go: at J = 0.85 at least 79 of 128 samples agree but with probability 1e-10.
* Confirmation: what remains is compared on whole sets (48 bits a shingle), 100 common >= 85 union.

Band keys with few sets give their pairs. Keys with more sets chain them (in map tasks first, so that a key that
a third of all sets share sends a row or two per task): each set is paired with the smallest of its chain, a
linear number of pairs, and all sets that keys chain form a cluster. Pairs are confirmed nearest first, then
those whose ends are not yet connected. Of a cluster, only the sets that have a set of another component within
reach of their size are left; they are dealt to blocks of like sizes, whose pairs meet in one task each, where
sketches are compared as a matrix and whole sets only where a link would join two components. So no link between
different components is left out, nothing is capped, and no group is expanded into pair rows.

Defined cases: null or empty texts have no set, link with nothing and are their own component; one to four words
are a single shingle; texts of any length are read whole; repeated rows are documents of their own with one node;
of equal smallest ids (ties) each is kept; null ids never become a component's id unless it has no other; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm import near
from quillflow.llm.common import arrow_batches, discard, mix64, texts, written
from quillflow.llm.graph import components

PERCENT = 85
SAMPLES = 128
ROWS = 4
BITS = 512
DIFFER = 98
#: Shingles that one step of sampling holds for all hash functions.
STEP = 4_096
HELD_ENTRIES = 1_000_000

_MULTIPLIERS = (mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SCANNED = "kind int, doc_id long, node long, n long, samples binary"


def samples(s: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty: the least product with each multiplier, modulo 2^32."""
    high = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(SAMPLES, 2**32 - 1, np.uint32)
    for low in range(0, len(high), STEP):
        np.minimum(least, (_MULTIPLIERS[:, None] * high[None, low : low + STEP]).min(1), out=least)
    return least


def band_keys(rows: np.ndarray) -> np.ndarray:
    """The 64-bit band keys of sets, one row of samples each."""
    parts = rows.reshape(len(rows), SAMPLES // ROWS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(SAMPLES // ROWS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64((key ^ parts[:, :, k]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return key


def odd_sketches(rows: np.ndarray) -> np.ndarray:
    """The odd sketches of sets, one row of samples each: BITS / 64 words of parities."""
    at = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
    bit = mix64(rows.astype(np.uint64) + at + np.uint64(1)) & np.uint64(BITS - 1)
    flat = np.arange(len(rows), dtype=np.int64)[:, None] * BITS + bit.astype(np.int64)
    odd = (np.bincount(flat.ravel(), minlength=len(rows) * BITS) & 1).astype(bool)
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(len(rows), BITS // 64)


def sketch_of(s: np.ndarray) -> np.ndarray:
    """The odd sketch of one set."""
    return odd_sketches(samples(s)[None, :])[0]


def differing(count: np.ndarray) -> np.ndarray:
    """The estimated number of differing samples for population counts of XORed sketches."""
    return -BITS / 2 * np.log(np.maximum(1 - 2 * np.asarray(count, float) / BITS, 1e-9))


#: The largest population count whose estimate is within DIFFER.
MOST_ODD = int(np.flatnonzero(differing(np.arange(BITS // 2)) <= DIFFER)[-1])


def _scan(docs: DataFrame) -> DataFrame:
    """kind 0: each document's id, node and size; kind 1: each task's distinct sets with their samples."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            sets = near.shingle_sets(texts(batch))
            nodes = [near.node_of(s) if len(s) else None for s in sets]
            fresh = {node: s for node, s in zip(nodes, sets, strict=True) if node is not None and node not in seen}
            seen.update(fresh)
            k, m = batch.num_rows, len(fresh)
            yield pa.RecordBatch.from_pydict({
                "kind": np.repeat(np.array([0, 1], np.int32), (k, m)),
                "doc_id": pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.nulls(m, pa.int64())]),
                "node": pa.array([*nodes, *fresh], pa.int64()), "n": pa.array([*map(len, sets), *map(len, fresh.values())], pa.int64()),
                "samples": pa.array([None] * k + [samples(s).tobytes() for s in fresh.values()], pa.binary()),
            })

    return docs.select("doc_id", "text").mapInArrow(scan, _SCANNED)


def _sampled(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("samples").to_pylist()), np.uint32).reshape(-1, SAMPLES)


def _entries(sampled: DataFrame) -> DataFrame:
    """The band keys of all sets, chained where a map task meets many sets of one key."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bands = [], 0, SAMPLES // ROWS
        for batch in batches:
            node, n = (batch.column(c).to_numpy() for c in ("node", "n"))
            zero = np.zeros(len(node) * bands, np.int64)
            held.append((band_keys(_sampled(batch)).ravel().view(np.int64), np.repeat(node, bands), np.repeat(n, bands), zero, zero > 0))
            size += len(zero)
            if size > HELD_ENTRIES:
                yield near._chained(held)
                held, size = [], 0
        if held:
            yield near._chained(held)

    return sampled.select("node", "n", "samples").mapInArrow(emit, near._ENTRY)


def _sketched(sampled: DataFrame) -> DataFrame:
    """(node, bits): the odd sketch of each set."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = odd_sketches(_sampled(batch)) if batch.num_rows else ()
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["node", "bits"])

    return sampled.select("node", "samples").mapInArrow(emit, "node long, bits binary")


def _weighed(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(x, y, odd) of the pairs whose sketches let them link; odd is the XOR's population count."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("a", "b"))
            odd = np.bitwise_count(a ^ b).sum(1, dtype=np.int32)
            near_ = pa.array(odd <= MOST_ODD)
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(near_), batch.column("y").filter(near_), pa.array(odd).filter(near_)], names=["x", "y", "odd"])

    left, right = (sketches.select(F.col("node").alias(end), F.col("bits").alias(name)) for end, name in (("x", "a"), ("y", "b")))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "a", "b").mapInArrow(weigh, "x long, y long, odd int")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose whole sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                keep[k] = near._linked(near.unpacked(a), near.unpacked(b), PERCENT)
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    left, right = (sets.select(F.col("node").alias(end), F.col("tokens").alias(name)) for end, name in (("x", "a"), ("y", "b")))
    return pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "a", "b").mapInArrow(check, "x long, y long")


def _connect(table: pa.Table) -> pa.RecordBatch:
    """Links between the two blocks of a task that join different components."""
    node, root, n, block = (table.column(c).to_numpy().copy() for c in ("node", "root", "n", "block"))
    tokens = [near.unpacked(v) for v in table.column("tokens")]
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
    first = int(table.column("i")[0].as_py())
    out = []
    for a in np.flatnonzero(block == first).tolist():
        other = root != root[a]
        if block[-1] == first:
            other[: a + 1] = False
        else:
            other &= block != first
        other &= (100 * n >= PERCENT * n[a]) & (100 * n[a] >= PERCENT * n)
        rows = np.flatnonzero(other)
        odd = np.bitwise_count(bits[rows] ^ bits[a]).sum(1, dtype=np.int64)
        for b in rows[odd <= MOST_ODD][np.argsort(odd[odd <= MOST_ODD], kind="stable")].tolist():
            if root[a] != root[b] and near._linked(tokens[a], tokens[b], PERCENT):
                out.append((node[a], node[b]))
                root[root == root[b]] = root[a]
    x, y = np.array(out, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_pydict({"x": x, "y": y})


def _links(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Edges between nodes that connect exactly the documents connected by links."""
    sampled = scanned.where("kind = 1").select("node", "n", "samples")
    found = written(near._probe(_entries(sampled)), "candidates")
    hung = written(near._hung(found), "hung")
    reach = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * PERCENT
    ordered = found.where("kind = 0").where(reach).select("x", "y").unionByName(hung).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    sketches = _sketched(sampled).dropDuplicates(["node"])
    close = written(_weighed(ordered.distinct(), sketches), "close")
    clusters = written(near._clusters(hung), "clusters")
    discard(found, hung)

    owner = scanned.where("kind = 0 and node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    ends = close.unionByName(close.select(F.col("y").alias("x"), F.col("x").alias("y"), "odd"))
    sets = near._set_table(docs, owner.join(ends.select(F.col("x").alias("node")).distinct(), "node", "left_semi"), sketch_of)
    nearest = ends.groupBy("x").agg(F.min(F.struct("odd", "y")).alias("b")).select(F.least("x", "b.y").alias("x"), F.greatest("x", "b.y").alias("y"))
    links = written(_confirmed(nearest.distinct(), sets), "links")
    more = written(links.unionByName(_confirmed(near._across(close, components(links)), sets)), "links")
    discard(links, close, sets)
    roots = components(more)
    members = clusters.join(owner.select("node", "n"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = written(near._undecided(members), "open")
    sets = near._set_table(docs, owner.join(open_.select("node").distinct(), "node", "left_semi"), sketch_of)
    links = more.unionByName(written(near._cluster_links(open_, sets, _connect), "links"))
    discard(clusters, open_, sets)
    return links


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document with its component's id) of every document."""
    arrow_batches(docs.sparkSession)
    scanned = written(_scan(docs), "scanned")
    members = scanned.where("kind = 0").select("doc_id", "node", F.col("n").alias("n_shingles"))
    named = near._named(members, components(_links(docs, scanned)))
    found = members.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
