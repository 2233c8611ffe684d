"""Prefix trie of conversations: z-fast tries over ranges of the conversations' order, joined along their edges.

A conversation is a path of 16-byte symbols, one for each turn (MD5 of role and text). Paths are put in order
by ranges of (path, conv_id), so copies of one conversation and conversations with one common beginning spread
over as many tasks as they need. Each task grows a z-fast trie of the stretch it reads, batch by batch:

* Nodes are compacted: each covers the depths after its parent's to its own. A hash table has each node at its
  handle, the digest of its prefix at the two-fattest depth it covers (the multiple of the largest power of 2).
* A conversation's exit node is located by fat binary search: the two-fattest depth of what is left open is
  looked up, a hit goes on below the node, a miss above the handle; so log2(depth) look-ups each.
* The batch's conversations split the edges they leave in the middle and hang new nodes on what they leave at
  its end. After a batch, all nodes off the last path are complete: their edges are expanded into one row for
  each depth, and they leave the table, so a task holds a batch and one path at most.

A stretch knows how many turns it shares with the row before it and the row after it. Sums over subtrees
count a node that began earlier only for its new members, and a childless node only where it ends, so the rows
of nodes on a stretch's edges (the only ones that several tasks give) are added up by one aggregate.

The lists of ids whose conversations end at one node can be long: a batch's first and last such list are sent
as text in pieces, which a second step hashes in order, holding one piece at a time. A node's parent is found
by an equi-join of prefix digests (the adaptive skew join splits hot parents); inside an edge it is known.

Prefixes are told apart by chained 128-bit digests, the only source of error. One conversation's path (24 bytes
a turn) is held whole by a task.

Defined cases: rows without conv_id belong to no conversation; null roles and texts are empty; turns go by
`turn` (null first), then role and symbol, so ties and repeated rows have one order and stay; very long texts are
hashed whole; conversations without turns end at the root; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import arrow_batches, discard, written

#: Bytes of a turn's symbol.
WIDTH = 16
#: The digest of no ids.
NO_ENDS = hashlib.sha256(b"").hexdigest()

_ROW = "kind int, conv_id long, depth long, fp binary, up binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
_FINAL, _PARTIAL, _ENDS = range(3)


def conversation_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes) of each conversation: its turns' symbols in a row, and the UTF-8 bytes of their texts."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    symbol = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    one = F.struct("turn", role.alias("role"), symbol.alias("symbol"), F.octet_length(text).cast("long").alias("size"))
    listed = turns.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return listed.select("conv_id", F.unhex(F.array_join("t.symbol", "")).alias("path"), F.col("t.size").alias("sizes"))


def fattest(low: int, high: int) -> int:
    """The number above low and up to high that the largest power of 2 divides."""
    return high & -(1 << ((low ^ high).bit_length() - 1))


def shared(a: list[bytes], b: list[bytes], low: int, high: int) -> int:
    """The largest depth up to high at which two chains of prefix digests agree; they do at low."""
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[middle] == b[middle] else (low, middle - 1)
    return low


class Node:
    """A compacted node: covers the depths above `start` up to `depth` of a chain of prefix digests."""

    __slots__ = ("start", "depth", "chain", "sizes", "parent", "children", "n", "first", "kids", "seen", "leaves", "saved", "ends")

    def __init__(self, start: int, depth: int, chain: list[bytes], sizes: list[int], parent: Node | None):
        self.start, self.depth, self.chain, self.sizes, self.parent = start, depth, chain, sizes, parent
        self.children: dict[bytes, Node] = {}
        self.n = self.kids = self.leaves = self.saved = 0
        self.first = self.ends = None
        self.seen = False

    def handle(self) -> bytes:
        """The key of this node in the hash table."""
        return self.chain[fattest(self.start, self.depth)]

    def joined(self, n: int, first: int) -> None:
        """Counts further members, of which `first` is the least."""
        self.n += n
        self.first = first if self.first is None else min(first, self.first)


class ZFastTrie:
    """The trie of one stretch; `left` is the depth that the row before it shares with its first one, or -1."""

    def __init__(self, chain: list[bytes], left: int):
        self.root = Node(-1, 0, chain[:1], [], None)
        self.handles: dict[bytes, Node] = {}
        self.head, self.left = chain, left

    def locate(self, chain: list[bytes]) -> Node:
        """The deepest node whose handle is on the path: its exit node or that one's parent."""
        node, low, high = self.root, 0, len(chain) - 1
        while low < high:
            depth = fattest(low, high)
            hit = self.handles.get(chain[depth])
            if hit is None:
                high = depth - 1
            else:
                node, low = hit, hit.depth
        return node

    def insert(self, chain: list[bytes], sizes: list[int]) -> Node:
        """The node at which a path ends, made if it is not there."""
        node, length = self.locate(chain), len(chain) - 1
        while True:
            common = shared(chain, node.chain, max(node.start, 0), min(length, node.depth))
            if common < node.depth:
                node = self._split(node, common)
                break
            below = node.children.get(chain[common + 1]) if length > common else None
            if below is None:
                break
            node = below
        if length > node.depth:
            leaf = Node(node.depth, length, chain, sizes, node)
            node.children[chain[node.depth + 1]] = leaf
            self.handles[leaf.handle()] = leaf
            return leaf
        return node

    def _split(self, node: Node, depth: int) -> Node:
        """A new node that takes the upper part of a node's edge, down to depth."""
        del self.handles[node.handle()]
        upper = Node(node.start, depth, node.chain, node.sizes, node.parent)
        node.parent.children[node.chain[node.start + 1]] = upper
        upper.children[node.chain[depth + 1]] = node
        node.start, node.parent = depth, upper
        self.handles[node.handle()], self.handles[upper.handle()] = node, upper
        return upper

    def complete(self, rows: list[tuple], last: list[bytes], right: int | None) -> None:
        """Gives the rows of all nodes off the path `last`; of all nodes if `right`, the depth shared with the next row, is known."""
        stack = [(self.root, False)]
        while stack:
            node, done = stack.pop()
            if not done:
                stack.append((node, True))
                stack += [(child, False) for child in node.children.values()]
            elif right is not None or node.depth >= len(last) or node.chain[node.depth] != last[node.depth]:
                self._expand(node, rows, last, -1 if right is None else right)

    def _expand(self, node: Node, rows: list[tuple], last: list[bytes], right: int) -> None:
        chain, depth = node.chain, node.depth
        old, open_ = min(depth, self.left), min(depth, right)
        old = old if old >= 0 and chain[old] == self.head[old] else -1
        open_ = open_ if open_ >= 0 and chain[open_] == last[open_] else -1
        partial = max(old, open_)
        if not node.seen:
            node.leaves = int(not (open_ == depth == len(last) - 1))
        saved, kids, ends = node.saved, node.kids, node.ends
        for d in range(depth, node.start, -1):
            if d:
                saved += (node.n - (d > old)) * node.sizes[d - 1]
            inside = d - 1 > max(node.start, partial)  # then the parent has the same members, and all of them
            rows.append((
                _PARTIAL if d <= partial else _FINAL, node.first, d, chain[d], None if inside or not d else chain[d - 1],
                node.first if inside else None, node.n, kids, node.leaves, saved, ends,
            ))
            kids, ends = int(d > old), None
        if up := node.parent:
            up.joined(node.n, node.first)
            up.seen, up.kids = True, up.kids + (node.start + 1 > old)
            up.leaves, up.saved = up.leaves + node.leaves, up.saved + saved
            del up.children[chain[node.start + 1]]
            del self.handles[node.handle()]


def chain_of(path: bytes, before: list[bytes]) -> list[bytes]:
    """The digests of all prefixes of a path; `before` are those of the first ones, of none at least."""
    chain = before[:]
    digest = chain[-1]
    for at in range(WIDTH * (len(before) - 1), len(path), WIDTH):
        digest = xxhash.xxh3_128_digest(digest + path[at : at + WIDTH])
        chain.append(digest)
    return chain


def _common(a: bytes, b: bytes) -> int:
    """How many symbols two paths share at their beginning."""
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(v, np.uint64, n * WIDTH // 8) for v in (a, b))
    differ = np.flatnonzero(x != y)
    return int(differ[0]) // (WIDTH // 8) if len(differ) else n


def _ordered(paths: DataFrame) -> DataFrame:
    """The paths in order, with partition, row number in it and the depths shared with the rows before and after (-1 at its ends)."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, held, back = TaskContext.get().partitionId(), 0, None, -1

        def out(rows: pa.RecordBatch, shares: list[int]) -> pa.RecordBatch:
            n = rows.num_rows
            columns = {"part": np.full(n, part, np.int32), "at": np.arange(at, at + n), "back": np.array(shares[:-1], np.int32), "on": np.array(shares[1:], np.int32)}
            return pa.RecordBatch.from_pydict(dict(zip(rows.schema.names, rows.columns, strict=True)) | columns)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            path = batch.column("path").to_pylist()
            shares = [back, *(_common(a, b) for a, b in zip(path[:-1], path[1:], strict=True))]
            if batch.num_rows > 1:
                yield out(batch.slice(0, batch.num_rows - 1), shares)
            at, held, back = at + batch.num_rows - 1, batch.slice(batch.num_rows - 1), shares[-1]
        if held is not None:
            yield out(held, [back, -1])

    schema = "conv_id long, path binary, sizes array<long>, part int, at long, back int, on int"
    ranged = paths.select("conv_id", "path", "sizes").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ranged.mapInArrow(neighbours, schema)


def _edges(ordered: DataFrame) -> DataFrame:
    """(part, left, right): the depths that each partition shares with the last path before and the first one after it.

    One task reads the first and the last path of each partition.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[int]] = {}
        last, before = None, None
        for batch in batches:
            for part, path, back in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "back")), strict=True):
                if back == -1:
                    share = -1 if last is None else _common(last, path)
                    rows[part] = [share, -1]
                    if before is not None:
                        rows[before][1] = share
                last, before = path, part
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(rows, pa.int32()), "left": pa.array([r[0] for r in rows.values()], pa.int32()), "right": pa.array([r[1] for r in rows.values()], pa.int32())
        })

    ends = ordered.where("back = -1 or on = -1").select("part", "at", "path", "back")
    return ends.coalesce(1).sortWithinPartitions("part", "at").mapInArrow(compare, "part int, left int, right int")


def _grown(ordered: DataFrame) -> DataFrame:
    """The rows of all nodes, those on a stretch's edges in parts, and the pieces of long lists of ids."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, chain, spot, right = None, None, None, -1

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.string()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES)

        for batch in batches:
            rows: list[tuple] = []
            names = ("part", "at", "conv_id", "path", "sizes", "back", "on", "left", "right")
            part, at, ids, path, sizes, back, on, left, ends = (batch.column(c).to_pylist() for c in names)
            k, n = 0, batch.num_rows
            while k < n:
                if spot != (part[k], at[k]):
                    if trie:
                        trie.complete(rows, chain, right)
                    chain = [b""]
                    trie = ZFastTrie(chain, left[k] if back[k] == -1 else back[k])
                    fresh = True
                else:
                    fresh = False
                m = k + 1
                while m < n and path[m] == path[k] and (part[m], at[m]) == (part[k], at[k] + m - k):
                    m += 1
                chain = chain_of(path[k], chain[: 1 if fresh else back[k] + 1])
                if fresh:
                    trie.head = chain
                node = trie.insert(chain, sizes[k])
                node.joined(m - k, min(ids[k:m]))
                listed = ",".join(map(str, ids[k:m]))
                if fresh or k == 0 or m == n:  # the list may have begun before or go on
                    rows.append((_ENDS, ids[k], None, chain[-1], None, None, None, None, None, None, listed))
                else:
                    node.ends = hashlib.sha256(listed.encode()).hexdigest()
                spot, right = (part[m - 1], at[m - 1] + 1), ends[m - 1] if on[m - 1] == -1 else on[m - 1]
                k = m
            if trie:
                trie.complete(rows, chain, None)
            yield out(rows)
        if trie:
            rows = []
            trie.complete(rows, chain, right)
            yield out(rows)

    both = ordered.join(F.broadcast(_edges(ordered)), "part")  # three numbers a partition
    return both.mapInArrow(grow, _ROW)


def _hashed(pieces: DataFrame) -> DataFrame:
    """(fp, digest) of each node's list of ids, whose pieces go by their first id."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, ([], [])
        for batch in batches:
            for fp, listed in zip(batch.column("fp").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if fp != now:
                    if sha:
                        out[0].append(now)
                        out[1].append(sha.hexdigest())
                    now, sha = fp, hashlib.sha256()
                    sha.update(listed.encode())
                else:
                    sha.update(b"," + listed.encode())
        if sha:
            out[0].append(now)
            out[1].append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["fp", "digest"])

    ordered = pieces.select("fp", "conv_id", "ends").repartition("fp").sortWithinPartitions("fp", "conv_id")
    return ordered.mapInArrow(digest, "fp binary, digest string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the paths (conv_id, path, sizes), the empty one included.

    conv_id is the least member, depth its length; further columns: parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over the subtree, all members but one of each node times its last size) and
    ends_sha256 of the ids that end there.
    """
    arrow_batches(paths.sparkSession)
    ordered = written(_ordered(paths), "ordered")
    grown = written(_grown(ordered), "grown")
    discard(ordered)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = grown.where(f"kind = {_PARTIAL}").groupBy("fp").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("up", True).alias("up"), F.lit(None).cast("long").alias("parent_conv_id"), *sums, F.max("ends").alias("ends")
    )
    nodes = grown.where(f"kind = {_FINAL}").drop("kind").unionByName(merged)
    nodes = nodes.join(_hashed(grown.where(f"kind = {_ENDS}")), "fp", "left")
    parents = nodes.where("n_children > 0").select(F.col("fp").alias("up"), F.col("conv_id").alias("found"))
    return nodes.join(parents, "up", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "found").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", "ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
