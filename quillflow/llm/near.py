"""Exact Jaccard self-join of word-shingle sets by token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct five-word shingles (lower-cased in A-Z).
Documents with equal sets form one node, so copies never meet pair by pair. Tokens have one global
order: rare ones first (by hash), then the frequent ones by rising count. If |x and y| / |x or y| >=
0.75, then x and y share at least t = ceil(0.75 |x|) tokens, and so:

* Token classes. Rare tokens are one class and indexed alone. Frequent tokens are dealt into G
  classes and indexed as pairs of tokens of one class (k = 2).
* Extended prefix. A prefix with f_i tokens of class i that may share k_i - 1 of them without a hit
  must satisfy  sum max(0, f_i - k_i + 1) >= |x| - t + 1;  the prefix is the shortest such one. Then
  any linking pair has a common single rare token or a common pair of frequent tokens.
* G depends on the size band of the smaller set (powers of two), so sets just above a band's lower
  end also index by the band below. Sets under 16 tokens index frequent tokens alone.

Frequent tokens: each block of documents counts its tokens and reports those it meets `LOCAL_COUNT`
times; tokens whose reports sum up to `OFTEN` are frequent, of which the table keeps the `FREQUENT`
largest sums. All documents are counted. The table only steers the order, never the result.

Candidates: an index entry with at most `SMALL` sets gives its pairs, which are counted: as all
common rare tokens of both prefixes are seen, overlap <= common + |x| - (rare tokens in x's prefix),
which drops pairs that share a stray token. Sets chained by larger entries form clusters (connected
components over the entries, no pairs). A map task that meets more than `SMALL` sets of one entry chains
them itself, in order of size, and sends one row per unbroken chain, so an entry that a third of all
sets share sends a row or two per task. A cluster's sets are dealt to blocks of like sizes, bounded by
sets and by tokens; pairs of blocks whose sizes let them link are found by an equi-join on size bands
and compared inside one task each; only links that join different components leave it.

Verification: bitmaps of four to eight bits a token first: a bit of x that y lacks is a token of x that
y lacks, so overlap <= |x| - |bits(x) not in bits(y)|, which never drops a link. Pairs and blocks meet as
bitmaps alone; whole sets are sent only of sets for which a pair is left then, and verified. No pair that can
link is left out, and no group is expanded into pair rows.

Disk: each step's shuffle files are deleted once its table is written, not when the driver collects garbage.

Hash collisions are the only source of error: 2**-64 per pair of different shingles or sets, and 2**-48 per pair
of shingles where whole sets are compared, for which their hashes are cut to six bytes.

Defined cases: null or empty texts have no set, link with nothing and are their own component; one to
four words are a single shingle; texts of any length are read whole; repeated rows are documents of
their own with one node; of equal smallest ids (ties) either names the component; null ids never become
a component's id unless it has no other; an empty table gives no rows; other columns are ignored by
`near_duplicates` and kept by `drop_near_duplicates`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillflow.llm.common import arrow_batches, bucketed, discard, mix64, own_name, texts, words_of, written
from quillflow.llm.graph import components

WORDS = 5
LOCAL_COUNT = 2
OFTEN = 6
COUNT_BLOCK = 2_000_000
FREQUENT = 1 << 18
SMALL = 16
#: Sets of a block, each counting as one and one more for every `BLOCK_TOKENS` tokens: two million tokens at most.
BLOCK = 2_048
BLOCK_TOKENS = 1_000
#: The same for blocks of bitmaps alone: sixteen million tokens, 16 MB of bitmaps at most.
BITMAP_BLOCK_TOKENS = 8_000
SINGLES_BELOW = 16
#: Entries that a map task holds before it chains and sends them.
HELD_ENTRIES = 1_000_000
#: Bytes of a token where whole sets are compared.
TOKEN_BYTES = 6
#: Bytes of sets that a bucket of their table holds, about.
BUCKET_BYTES = 256 << 20
#: Bits of the filter of wanted ids: about 16 an id; beyond MOST_BLOOM_BITS ids are joined instead.
MOST_BLOOM_BITS = 1 << 27
#: Spark's switch by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_ENTRY = "sig long, node long, n int, slack int, rare boolean, other long, high int"
_FOUND = "kind int, sig long, x long, y long, nx int, ny int, sx int, sy int, rare boolean"


def shingle_sets(array: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, parent = words_of(pc.ascii_lower(array))
    code = words.dictionary_encode()
    names = code.dictionary.to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    hashes = mix64(hashes.astype(np.uint64))[code.indices.to_numpy(zero_copy_only=False)]
    ends = np.searchsorted(parent, np.arange(len(array) + 1))
    whole = np.zeros(max(0, len(hashes) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        whole = (whole ^ hashes[k : len(whole) + k]) * np.uint64(0x9E3779B97F4A7C15)
        whole ^= whole >> np.uint64(29)
    whole = mix64(whole)
    out = []
    for low, high in zip(ends[:-1], ends[1:], strict=True):
        if high - low >= WORDS:
            s = np.sort(whole[low : high - WORDS + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif high > low:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[low:high].tobytes(), seed=int(high - low))], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_of(s: np.ndarray) -> int:
    """The signed 64-bit identity of a set."""
    value = xxhash.xxh3_64_intdigest(s.tobytes())
    return value - (1 << 64) if value >> 63 else value


def bitmap(s: np.ndarray) -> np.ndarray:
    """A set's bitmap: a power of two of bits, at least 256 and four a token."""
    bits = max(256, 1 << (4 * len(s) - 1).bit_length())
    at = ((s >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64)
    out = np.zeros(bits, bool)
    out[at] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def packed(s: np.ndarray) -> bytes:
    """The upper six bytes of each token of a sorted set; they keep its order."""
    return (s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def unpacked(value: pa.BinaryScalar) -> np.ndarray:
    """The tokens of `packed`."""
    data = np.frombuffer(value.as_buffer(), np.uint8).reshape(-1, TOKEN_BYTES)
    out = np.zeros((len(data), 8), np.uint8)
    out[:, :TOKEN_BYTES] = data
    return out.view("<u8")[:, 0].astype(np.uint64)


def may_link(a: np.ndarray, n: int, b: np.ndarray, m: int) -> bool:
    """False only if sets of n and m tokens with these bitmaps can't link; wider ones are folded."""
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    most = min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))
    return 100 * most >= 75 * (n + m - most)


def schemes(n: int) -> list[int]:
    """The size bands that a set of n tokens is indexed by: 0 for small sets, else floor(log2)."""
    if n < SINGLES_BELOW:
        return [0]
    band = n.bit_length() - 1
    return [band] + ([band - 1 if band > 4 else 0] if 3 * n <= 4 * ((1 << band) - 1) else [])


def signatures(s: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int]:
    """The index keys of a set, single rare tokens first, and how many those are."""
    n = len(s)
    budget = n - (3 * n + 3) // 4 + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        often = frequent[at] == s
    else:
        at, often = np.zeros(n, np.int64), np.zeros(n, bool)
    single = s[~often][:budget]
    need = budget - len(single)
    if not need:
        return single, len(single)
    tail = s[often][np.argsort(rank[at[often]])]
    keys = [single]
    for band in schemes(n):
        if not band:
            keys.append(tail[:need])
            continue
        group = ((tail >> np.uint64(20)) % np.uint64((1 << band) // 16)).astype(np.int64)
        by = np.argsort(group, kind="stable")
        first = np.zeros(len(tail), bool)
        first[by[np.concatenate(([True], np.diff(group[by]) != 0))]] = True
        used = int(np.searchsorted(np.cumsum(~first), need)) + 1
        inside = by[by < used]
        tokens, group = tail[inside], group[inside]
        for gap in range(1, len(tokens)):
            same = np.flatnonzero(group[gap:] == group[:-gap])
            if not len(same):
                break
            a, b = tokens[same], tokens[same + gap]
            keys.append(mix64(np.minimum(a, b) * np.uint64(0x9E3779B97F4A7C15) + mix64(np.maximum(a, b) + np.uint64(band))))
    return np.concatenate(keys), len(single)


def _scan(docs: DataFrame) -> DataFrame:
    """kind 0: each document's id, node and size; kind 1: tokens that a block of documents repeats."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def repeated() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= LOCAL_COUNT
            k = int(often.sum())
            return pa.RecordBatch.from_pydict({
                "kind": np.ones(k, np.int32), "doc_id": pa.nulls(k, pa.int64()), "node": token[often].view(np.int64), "n": count[often].astype(np.int64)
            })

        for batch in batches:
            sets = shingle_sets(texts(batch))
            nodes = [node_of(s) if len(s) else None for s in sets]
            for node, s in zip(nodes, sets, strict=True):
                if node is not None and node not in seen:
                    seen.add(node)
                    held.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_pydict({
                "kind": np.zeros(len(sets), np.int32), "doc_id": batch.column("doc_id").cast(pa.int64()),
                "node": pa.array(nodes, pa.int64()), "n": np.array([len(s) for s in sets], np.int64),
            })
            if size > COUNT_BLOCK:
                yield repeated()
                held, size = [], 0
        if held:
            yield repeated()

    return docs.select("doc_id", "text").mapInArrow(scan, "kind int, doc_id long, node long, n long")


def _entries(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """The index entries of all sets; a task emits a set once, however many copies it meets."""
    tokens = frequent["node"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, frequent["n"].to_numpy()))] = np.arange(len(tokens))
    table = docs.sparkSession.sparkContext.broadcast((tokens[order], rank[order]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = table.value
        seen, held, size = set(), [], 0
        for batch in batches:
            keys, head = [], []
            for s in shingle_sets(texts(batch)):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                seen.add(node)
                key, single = signatures(s, often, rank)
                keys.append(key)
                head.append((node, len(s), len(s) - single, single, len(key)))
            if not keys:
                continue
            node, n, slack, single, width = np.array(head, np.int64).T
            rare = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) < np.repeat(single, width)
            held.append((np.concatenate(keys).view(np.int64), np.repeat(node, width), np.repeat(n, width), np.repeat(slack, width), rare))
            size += len(rare)
            if size > HELD_ENTRIES:
                yield _chained(held)
                held, size = [], 0
        if held:
            yield _chained(held)

    return docs.select("doc_id", "text").mapInArrow(emit, _ENTRY)


def _chained(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """A task's entries. Those of an entry with more than SMALL sets become chains and links.

    A chain holds an entry's sets in order of size, each so near the next one's size that they may link:
    it is one row with its smallest set (node, n) and its largest (other, high). Links (node, other; no
    `high`) hang its sets on the smallest; each stands once, however many entries give it.
    """
    sig, node, n, slack, rare = (np.concatenate(c) for c in zip(*held, strict=True))
    by = np.argsort(sig, kind="stable")
    begin = np.flatnonzero(np.concatenate(([True], np.diff(sig[by]) != 0)))
    width = np.diff(np.append(begin, len(by)))
    big = np.zeros(len(by), bool)
    big[by] = np.repeat(width > SMALL, width)
    plain, rows = np.flatnonzero(~big), np.flatnonzero(big)  # plain rows stay in their sets' order, which packs well
    rows = rows[np.lexsort((node[rows], n[rows], sig[rows]))]
    joined = (np.diff(sig[rows]) == 0) & (3 * n[rows[1:]] <= 4 * n[rows[:-1]])
    opens = np.concatenate(([True], ~joined)) if len(rows) else np.zeros(0, bool)
    first, last = rows[opens], rows[np.append(opens[1:], True)] if len(rows) else rows
    pairs = np.stack([node[first][np.cumsum(opens) - 1], node[rows]], axis=1) if len(rows) else np.zeros((0, 2), np.int64)
    links = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    k, chains = len(links), len(first)
    nothing, zero = np.zeros(len(plain) + chains + k, bool), np.zeros(k, np.int64)
    single, open_ = nothing.copy(), nothing.copy()
    single[: len(plain)] = True
    open_[: len(plain)] = open_[len(plain) + chains :] = True
    pad = np.zeros(len(plain), np.int64)
    return pa.RecordBatch.from_pydict({
        "sig": np.concatenate((sig[plain], sig[first], mix64(links[:, 0].view(np.uint64) ^ links[:, 1].view(np.uint64)).view(np.int64))),
        "node": np.concatenate((node[plain], node[first], links[:, 0])), "n": np.concatenate((n[plain], n[first], zero)).astype(np.int32),
        "slack": np.concatenate((slack[plain], slack[first], zero)).astype(np.int32), "rare": np.concatenate((rare[plain], rare[first], zero > 0)),
        "other": pa.array(np.concatenate((pad, node[last], links[:, 1])), mask=single),
        "high": pa.array(np.concatenate((pad, n[last], zero)).astype(np.int32), mask=open_),
    })


def _found(kind: int, sig, x, y, nx, ny, sx, sy, rare) -> pa.RecordBatch:
    k = len(x)
    return pa.RecordBatch.from_pydict({
        "kind": np.full(k, kind, np.int32), "sig": sig, "x": x, "y": y, "nx": nx, "ny": ny, "sx": sx, "sy": sy, "rare": rare
    })


def _probe(entries: DataFrame) -> DataFrame:
    """kind 0: pairs of sets of small entries (no sig); kind 1: the chains (x, nx) to (y, ny) of larger entries, a single
    set being one too; kind 2: the links that map tasks found."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        names = ("sig", "node", "n", "slack", "rare", "other", "high")
        for batch in _then_none(batches):
            cols = None
            if batch:
                link = pc.and_(pc.is_null(batch.column("high")), pc.is_valid(batch.column("other")))
                links = batch.filter(link)
                if links.num_rows:
                    none = np.zeros(links.num_rows, np.int32)
                    yield _found(2, np.zeros(links.num_rows, np.int64), links.column("node"), links.column("other"), none, none, none, none, none > 0)
                rest = batch.filter(pc.invert(link))
                rest = rest.set_column(5, "other", pc.coalesce(rest.column("other"), rest.column("node"))).set_column(6, "high", pc.coalesce(rest.column("high"), pa.scalar(0, pa.int32())))
                cols = {c: rest.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                cols = {c: np.concatenate((held[c], cols[c])) for c in names} if cols else held
            held = None
            if cols is None or not len(cols["sig"]):
                continue
            sig, node = cols["sig"], cols["node"]
            new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))) | (cols["high"] > 0)
            cols = {c: v[new] for c, v in cols.items()}
            sig = cols["sig"]
            begin = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            width = np.diff(np.append(begin, len(sig)))
            chained = np.logical_or.reduceat(cols["high"] > 0, begin)
            if batch is not None:  # the last entry may go on in the next batch
                cut = begin[-1]
                if width[-1] > SMALL or chained[-1] or sig[cut] == large:
                    large = sig[cut]
                    held = {c: v[-1:] for c, v in cols.items()}  # its last set, so that a repeat is seen
                    width[-1] -= 1
                else:
                    held = {c: v[cut:] for c, v in cols.items()}
                    width[-1] = 0
            big = ((width > SMALL) | chained | (sig[begin] == large if large is not None else False)) & (width > 0)
            rows = np.concatenate([np.zeros(0, np.int64), *(np.arange(b, b + w) for b, w in zip(begin[big], width[big], strict=True))])
            if len(rows):
                r = {c: v[rows] for c, v in cols.items()}
                yield _found(1, r["sig"], r["node"], r["other"], r["n"], np.maximum(r["n"], r["high"]), r["slack"], r["slack"], r["rare"])
            for size in range(2, SMALL + 1):
                at = begin[(width == size) & ~big]
                if not len(at):
                    continue
                i, j = np.triu_indices(size, 1)
                a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                n, m = cols["n"][a].astype(np.int64), cols["n"][b].astype(np.int64)
                near = 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)
                a, b = a[near], b[near]
                if len(a):
                    yield _found(0, np.zeros(len(a), np.int64), cols["node"][a], cols["node"][b], cols["n"][a], cols["n"][b], cols["slack"][a], cols["slack"][b], cols["rare"][a])

    return entries.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(probe, _FOUND)


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _sets(docs: DataFrame, wanted: DataFrame, sketch: Callable[[np.ndarray], np.ndarray] = bitmap, whole: bool = True) -> DataFrame:
    """(node, n, bits and, if whole, tokens) of the documents whose ids are wanted, and of a few that the filter lets through; `sketch` gives a set's bits.

    The ids reach the tasks as a Bloom filter sized by their number, never as a list; where that filter
    would pass MOST_BLOOM_BITS, the documents are joined with the ids instead.
    """
    spark = docs.sparkSession
    bits = 1 << max(16, (16 * wanted.count() - 1).bit_length())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bloom = None
    if bits > MOST_BLOOM_BITS:
        docs = docs.join(wanted.select(F.col("doc_id").alias("id")).distinct(), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    else:
        bit = F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("doc_id")).bitwiseAND(bits - 1) for k in range(4)))).alias("b")
        words = wanted.select(bit).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toPandas()
        table = np.zeros(bits // 64, np.int64)
        table[words["w"]] = words["v"]
        bloom = spark.sparkContext.broadcast(table)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k in range(4) if bloom else ():
                b = batch.column(f"h{k}").to_numpy()
                keep &= (bloom.value[b >> 6] >> (b & 63)) & 1 == 1
            found = [(node_of(s), s) for s in shingle_sets(texts(batch.filter(pa.array(keep)))) if len(s)]
            found = [(node, s) for node, s in dict(found).items() if node not in seen]
            seen.update(node for node, _ in found)
            if found:
                nodes, sets = zip(*found, strict=True)
                columns = {"node": pa.array(nodes, pa.int64()), "n": pa.array(map(len, sets), pa.int32()), "bits": pa.array([sketch(s).tobytes() for s in sets], pa.binary())}
                if whole:
                    columns["tokens"] = pa.array([packed(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    hashed = [F.xxhash64(F.lit(k), F.col("doc_id")).bitwiseAND(bits - 1).alias(f"h{k}") for k in range(4)] if bloom else []
    return docs.select("text", *hashed).mapInArrow(emit, "node long, n int, bits binary" + ", tokens binary" * whole)


def _set_table(docs: DataFrame, owner: DataFrame, sketch: Callable[[np.ndarray], np.ndarray] = bitmap, whole: bool = True) -> DataFrame:
    """`_sets` of the documents that stand for nodes (node, doc_id, n), bucketed by node in as many buckets as their sizes need."""
    owner = written(owner.select("doc_id", "n"), "owner")
    tokens = owner.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = bucketed(_sets(docs, owner.select("doc_id"), sketch, whole), "node", -(-tokens * (TOKEN_BYTES * whole + 1) // BUCKET_BYTES))
    discard(owner)
    return out


def _sifted(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (x, y, common) whose bitmaps let them link."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_pylist() for c in ("n", "m"))
            a, b = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(c)] for c in ("a", "b"))
            keep = [may_link(*row) for row in zip(a, n, b, m, strict=True)]
            yield batch.select(["x", "y", "common"]).filter(pa.array(keep, pa.bool_()))

    left = sketches.select(F.col("node").alias("x"), F.col("bits").alias("a"), "n")
    right = sketches.select(F.col("node").alias("y"), F.col("bits").alias("b"), F.col("n").alias("m"))
    return pairs.select("x", "y", "common").join(left, "x").join(right, "y").mapInArrow(sift, "x long, y long, common long")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose whole sets link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
                keep[k] = _linked(unpacked(a), unpacked(b))
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    left = sets.select(F.col("node").alias("x"), F.col("tokens").alias("a"))
    right = sets.select(F.col("node").alias("y"), F.col("tokens").alias("b"))
    return pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "a", "b").mapInArrow(check, "x long, y long")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    rx = roots.select(F.col("node").alias("x"), F.col("root").alias("rx"))
    ry = roots.select(F.col("node").alias("y"), F.col("root").alias("ry"))
    joined = pairs.join(rx, "x", "left").join(ry, "y", "left")
    return joined.where(F.coalesce("rx", "x") != F.coalesce("ry", "y")).drop("rx", "ry")


def _hung(found: DataFrame) -> DataFrame:
    """Edges (x, y) that chain the sets of larger entries, neighbours in size within an entry.

    Of an entry's chains in order of their smallest sizes, one that is too large to link with any before
    begins a run, and the others are hung on their run's first; so any two sets of the entry whose sizes
    let them link are in one cluster. Sets of different clusters share no entry that matters.
    """
    order = Window.partitionBy("sig").orderBy("nx", "x", "ny", "y")
    far = F.max("ny").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chains = found.where("kind = 1").select("sig", "x", "nx", "y", "ny").withColumn("begins", F.coalesce(3 * F.col("nx").cast("long") > 4 * far.cast("long"), F.lit(True)).cast("int"))
    runs = chains.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first("x").over(Window.partitionBy("sig", "run").orderBy("nx", "x", "ny", "y"))
    edges = runs.select("x", first.alias("y")).where("x <> y").unionByName(found.where("kind = 2").select("x", "y"))
    return edges.distinct()


def _clusters(hung: DataFrame) -> DataFrame:
    """(node, cluster) of the sets that edges chain."""
    return components(hung).select("node", F.col("root").alias("cluster"))


def _band(size: str) -> Column:
    """The size band (powers of 4/3): of two sizes that may link, the larger is in the same band or the next."""
    return F.floor(F.log(F.col(size) + 0.5) / float(np.log(4 / 3)))


def _undecided(members: DataFrame) -> DataFrame:
    """The members (cluster, node, n, root) that have a member of another root in their size's reach.

    The others can't join components: all sets of their cluster that may link with them are in theirs.
    """
    banded = members.withColumn("band", _band("n"))
    near = banded.select("cluster", "root", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"))
    mixed = near.groupBy("cluster", "band").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("cluster", "band")
    return banded.join(mixed, ["cluster", "band"], "left_semi").drop("band")


def _blocks(members: DataFrame, tokens: int = 0) -> DataFrame:
    """(cluster, i, j, block, node, root): the sets of a cluster dealt to pairs of blocks of like sizes.

    A set's block follows from how much its cluster's smaller sets weigh and, among sets of its size, from
    its hash: only counts per cluster and size are put in order. A block weighs about BLOCK, a set one and one
    more for every `tokens` (BLOCK_TOKENS) tokens; blocks too far apart in size are not paired. Pairs are found by joining blocks on size bands (powers of 4/3): a
    block pairs with those that begin in a band from its own first to the one after its last.
    """
    weight = F.lit(1) + F.floor(F.col("n") / (tokens or BLOCK_TOKENS))
    sizes = members.groupBy("cluster", "n").agg((F.count("*") * F.first(weight)).alias("mass"))
    below = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("below", F.coalesce(F.sum("mass").over(below), F.lit(0)))
    spot = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / float(1 << 30)
    dealt = members.join(sizes, ["cluster", "n"]).withColumn("block", F.floor((F.col("below") + F.floor(spot * F.col("mass"))) / BLOCK)).drop("mass", "below")
    ranges = dealt.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left = ranges.select("cluster", F.col("block").alias("i"), "high", F.explode(F.sequence(_band("low"), _band("high") + 1)).alias("band"))
    right = ranges.select("cluster", F.col("block").alias("j"), "low", _band("low").alias("band"))
    tasks = left.join(right, ["cluster", "band"]).where("i <= j and 4L * high >= 3L * low").select("cluster", "i", "j")
    ends = tasks.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return dealt.join(ends, ["cluster", "block"]).select("cluster", "i", "j", "block", "node", "root")


def _compared(members: DataFrame, sets: DataFrame, compare: Callable[[pa.Table], pa.RecordBatch], schema: str, tokens: int = 0) -> DataFrame:
    """What `compare` gives for each pair of blocks of each cluster (cluster, node, n, root), which meet with their columns of `sets`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        task = None
        for batch in _then_none(batches):
            key = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j")), strict=True)) if batch else []
            cuts = [k for k in range(len(key)) if key[k] != (key[k - 1] if k else task)]
            for low, high in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if low in cuts or batch is None:
                    if held:
                        yield compare(pa.Table.from_batches(held))
                    held = []
                if high > low:
                    held.append(batch.slice(low, high - low))
            if key:
                task = key[-1]

    rows = _blocks(written(_undecided(members), "members"), tokens).join(sets, "node").select("cluster", "i", "j", "block", "node", "root", *(c for c in sets.columns if c != "node"))
    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "block", "node").mapInArrow(each, schema)


def _cluster_links(members: DataFrame, sets: DataFrame, connect: Callable[[pa.Table], pa.RecordBatch] | None = None) -> DataFrame:
    """Links that connect each cluster (cluster, node, n, root) as all its links do, found block by block by `connect`."""
    return _compared(members, sets, connect or _connect, "x long, y long")


def _open(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """The members (cluster, node, n, root) that by their bitmaps may link with one of their cluster with another root."""
    return members.join(_compared(members, sketches, _met, "node long", BITMAP_BLOCK_TOKENS).distinct(), "node", "left_semi")


def _close(table: pa.Table, wanted: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(a, rows) of a task: a set of its first block, and those of the other one (of a single one: after it) that by size and bitmap may link with it.

    `wanted` tells which rows are to be compared with a; it is asked again for each a.
    """
    n, block = (table.column(c).to_numpy() for c in ("n", "block"))
    bits = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("bits")]
    width = np.array([len(v) for v in bits])
    maps = {w: (np.flatnonzero(width == w), np.stack([b for b in bits if len(b) == w])) for w in np.unique(width).tolist()}
    for w in sorted(maps):  # each width also folded to the next smaller one
        rows, matrix = maps[w]
        maps[w] = rows, {w: matrix, w // 2: matrix[:, : w // 2] | matrix[:, w // 2 :]}
    first = int(table.column("i")[0].as_py())
    for a in np.flatnonzero(block == first).tolist():
        for w in (width[a] // 2, width[a], 2 * width[a]):
            if w not in maps:
                continue
            at = min(w, width[a])
            mine = bits[a] if at == width[a] else bits[a][:at] | bits[a][at:]
            rows, folded = maps[w]
            other = (4 * n[rows] >= 3 * n[a]) & (4 * n[a] >= 3 * n[rows]) & wanted(a, rows)
            if block[-1] == first:
                other &= rows > a
            else:
                other &= block[rows] != first
            if not other.any():
                continue
            rows, matrix = rows[other], folded[at][other]
            most = np.minimum(n[a] - np.bitwise_count(mine & ~matrix).sum(1, dtype=np.int64), n[rows] - np.bitwise_count(matrix & ~mine).sum(1, dtype=np.int64))
            yield a, rows[100 * most >= 75 * (n[a] + n[rows] - most)]


def _met(table: pa.Table) -> pa.RecordBatch:
    """The sets of the two blocks of a task that may link with one of another component."""
    root = table.column("root").to_numpy()
    met = np.zeros(len(root), bool)
    for a, rows in _close(table, lambda a, rows: (root[rows] != root[a]) & ~(met[a] & met[rows])):
        met[rows] = True
        met[a] |= len(rows) > 0
    return pa.RecordBatch.from_pydict({"node": table.column("node").to_numpy()[met]})


def _connect(table: pa.Table) -> pa.RecordBatch:
    """Links between the two blocks of a task that join different components."""
    node, root = (table.column(c).to_numpy().copy() for c in ("node", "root"))
    tokens = [unpacked(v) for v in table.column("tokens")]
    out = []
    for a, rows in _close(table, lambda a, rows: root[rows] != root[a]):
        for b in rows.tolist():
            if root[a] != root[b] and _linked(tokens[a], tokens[b]):
                out.append((node[a], node[b]))
                root[root == root[b]] = root[a]
    x, y = np.array(out, np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_pydict({"x": x, "y": y})


def _linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    both = np.sort(np.concatenate((a, b)), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _links(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Edges between nodes that connect exactly the documents connected by links."""
    frequent = scanned.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "node").limit(FREQUENT).toPandas()
    found = written(_probe(_entries(docs, frequent)), "candidates")
    # A pair that shares a larger entry meets in its cluster, so here all its common rare tokens are counted.
    needed = F.ceil((F.col("nx") + F.col("ny")) * 3 / 7 - 1e-9) - F.greatest("sx", "sy")
    pairs = found.where("kind = 0").groupBy("x", "y").agg(F.sum(F.col("rare").cast("int")).alias("common"), F.max(needed).alias("needed"))
    pairs = written(pairs.where("common >= needed").select("x", "y", "common"), "pairs")
    clusters = written(_clusters(_hung(found)), "clusters")
    discard(found)

    used = _ends(pairs).unionByName(clusters.select("node")).distinct()
    owner = scanned.where("kind = 0 and node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    sketches = _set_table(docs, owner.join(used, "node", "left_semi"), whole=False)
    close = written(_sifted(pairs, sketches), "close")
    discard(pairs)

    sets = _set_table(docs, owner.join(_ends(close).distinct(), "node", "left_semi"))
    ends = close.unionByName(close.select(F.col("y").alias("x"), F.col("x").alias("y"), "common"))
    nearest = ends.groupBy("x").agg(F.max(F.struct("common", "y")).alias("b")).select(F.least("x", "b.y").alias("x"), F.greatest("x", "b.y").alias("y"))
    links = written(_verify(nearest.distinct(), sets), "links")
    links = written(links.unionByName(_verify(_across(close, components(links)), sets)), "links")
    discard(close, sets)

    roots = components(links)
    members = clusters.join(owner.select("node", "n"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = written(members, "members")
    open_ = written(_open(members, sketches), "open")
    discard(sketches, clusters, members)
    sets = _set_table(docs, owner.join(open_.select("node"), "node", "left_semi"))
    links = links.unionByName(written(_cluster_links(open_, sets), "links"))
    discard(sets, open_)
    return links


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (x, y), with repeats."""
    return pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node")))


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends; after it the setting is as it was."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n_shingles) of every document, and (node, component) of every set."""
    arrow_batches(docs.sparkSession)
    with _cleaned(docs.sparkSession):
        scanned = written(_scan(docs), "scanned")
        members = scanned.where("kind = 0").select("doc_id", "node", F.col("n").alias("n_shingles"))
        named = _named(members, components(_links(docs, scanned)))
    return members, named


def _named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component, first) of every set: the least doc_id and the least node of its component (node, root)."""
    nodes = members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component"), F.min("node").alias("first"))
    return nodes.join(least, "root").select("node", "component", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    members, named = _labelled(docs)
    return members.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The document of each component whose id is smallest, with all its columns.

    Texts are shuffled once, by doc_id and node, so an id that stands on several texts keeps one row in
    each component where it is the smallest. A component without any id keeps a row of one set; an id
    keeps one of its rows without words; rows without id and without words all stay.
    """
    members, named = _labelled(docs)
    with _cleaned(docs.sparkSession):
        named = written(named, "named")
    mark = own_name(docs, "_node")
    schema = T.StructType([*docs.schema.fields, T.StructField(mark, T.LongType())])

    def noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array([node_of(s) if len(s) else None for s in shingle_sets(texts(batch))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, nodes], names=[*batch.schema.names, mark])

    # `first` tells components apart that have the same smallest id; no words stand as node 0.
    least = members.join(named, "node").where("doc_id = component").groupBy("first").agg(F.min("doc_id").alias("doc_id"), F.min("node").alias(mark)).drop("first")
    wordless = members.where("node is null and doc_id is not null").select("doc_id", F.lit(0).cast("long").alias(mark))
    stay = least.unionByName(wordless)
    with_id = docs.where("doc_id is not null").mapInArrow(noded, schema).withColumn(mark, F.coalesce(mark, F.lit(0).cast("long")))
    kept = with_id.join(stay, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark]).select(docs.columns)
    nameless = docs.where("doc_id is null").mapInArrow(noded, schema)
    unclaimed = named.where("component is null and node = first").select(F.col("node").alias(mark))
    single = nameless.join(unclaimed, mark, "left_semi").dropDuplicates([mark]).drop(mark)
    return kept.unionByName(single).unionByName(nameless.where(F.col(mark).isNull()).drop(mark))
