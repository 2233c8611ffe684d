"""Maximal periodic runs of words in each text, by uniting suffix classes in order of falling LCP.

A run is a stretch of words with smallest period q (words q apart are identical), at least `LEAST` words
and `TIMES` periods long, that no neighbouring word extends. Each text is searched on its own:

* Suffixes: ranks of all stretches of 1, 2, 4, ... words (prefix doubling, all texts of a batch at once, as
  the first rank tells texts apart) give the suffix order, and the ranks of every doubling together give the
  longest common prefix (LCP) of any two positions by descent.
* Kruskal: neighbours in suffix order are edges that weigh their LCP. Edges are taken by falling LCP; each
  unites two classes of a union-find, which keep their positions in order, the smaller into the larger.
  Two positions that come to stand next to each other in the united class have exactly that LCP; if their
  distance d is within it (and d + LCP is long enough), they seed a run of period d.
* Seeds: of a run [s, e) of period q, s and s + q have the LCP e - s - q and no position of their class
  between them (it would give a smaller period), so that pair always seeds it. Neighbours at a multiple of a
  run's period never meet, as the positions between have a larger LCP. So the seeds whose words before don't
  match are the runs, each once, with their smallest period.

Only edges with LCP >= 2/3 LEAST can seed; texts in which no stretch of that many words comes twice (told by
the ranks) have no run and leave early. Classes are plain lists while small and lists of blocks beyond, so a
text of one repeated word costs n log n steps too. Memory is about 4 bytes a word for each doubling up to the
longest repeat. No shuffle; a lost task is simply run again.

Defined cases: null and empty texts have no words and no run; very long texts are searched whole; ties in the
order of runs go by start, then period; repeated rows are searched each; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillflow.llm.common import arrow_batches, texts, words_of

LEAST = 24
TIMES = 3
#: Positions that a class holds in one plain list; larger ones are lists of blocks of half to one such size.
PLAIN = 4_096

_OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Positions:
    """An ordered set of positions: a list of sorted blocks."""

    def __init__(self, at: int):
        self.blocks, self.size = [[at]], 1

    def add(self, at: int) -> None:
        """Puts a position in its place."""
        k = self._block(at)
        insort(self.blocks[k], at)
        self.size += 1
        if len(self.blocks[k]) > PLAIN:
            half = PLAIN // 2
            self.blocks[k : k + 1] = [self.blocks[k][:half], self.blocks[k][half:]]

    def _block(self, at: int) -> int:
        return max(0, bisect_left(self.blocks, at, key=lambda b: b[0] - 0.5) - 1)

    def around(self, at: int) -> tuple[int | None, int | None]:
        """The neighbours before and after a position that is in the set."""
        k = self._block(at)
        block = self.blocks[k]
        i = bisect_left(block, at)
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else None
        after = block[i + 1] if i + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def suffix_ranks(codes: np.ndarray, parent: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4, ... words from each position, until all differ.

    Positions of different texts (parent) never have the same rank; a stretch ends with its text.
    """
    n = len(codes)
    _, rank = np.unique(parent.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    levels = [rank.astype(np.int32)]
    step = 1
    while n and int(levels[-1].max()) < n - 1:
        rank = levels[-1].astype(np.int64)
        then = np.zeros(n, np.int64)
        same = parent[step:] == parent[:-step] if step < n else np.zeros(0, bool)
        then[: len(same)][same] = rank[step:][same] + 1
        _, rank = np.unique(rank * (n + 1) + then, return_inverse=True)
        levels.append(rank.astype(np.int32))
        step *= 2
    return levels


def common_prefix(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """LCP of positions a and b of the same text; `ends` is the end of each position's text."""
    out, last = np.zeros(len(a), np.int64), np.minimum(ends[a] - a, ends[b] - b)
    for k in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(out + (1 << k) <= last)
        same = levels[k][a[fits] + out[fits]] == levels[k][b[fits] + out[fits]]
        out[fits[same]] += 1 << k
    return out


def _seeds(a: list[int], b: list[int], lcp: list[int]) -> list[tuple[int, int, int]]:
    """(position, distance, lcp) of the newly adjacent pairs that are far enough within their LCP."""
    owner: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def find(x: int) -> int:
        root = x
        while (up := owner.setdefault(root, root)) != root:
            root = up
        while owner[x] != root:
            owner[x], x = root, owner[x]
        return root

    found = []
    for x, y, length in zip(a, b, lcp, strict=True):
        x, y = find(x), find(y)
        into, small = sets.pop(x, None) or Positions(x), sets.pop(y, None) or Positions(y)
        if into.size < small.size:
            x, y, into, small = y, x, small, into
        added = list(small)
        if into.size + len(added) <= PLAIN:
            into.blocks, into.size = [sorted(into.blocks[0] + added)], into.size + len(added)
        else:
            for p in added:
                into.add(p)
        for k, p in enumerate(added):
            before, after = into.around(p)
            if before is not None and (not k or before != added[k - 1]) and (TIMES - 1) * (p - before) <= length and p - before + length >= LEAST:
                found.append((before, p - before, length))
            if after is not None and (k + 1 == len(added) or after != added[k + 1]) and (TIMES - 1) * (after - p) <= length and after - p + length >= LEAST:
                found.append((p, after - p, length))
        owner[y] = x
        sets[x] = into
    return found


def runs_of(codes: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """(text, start, length, period) of all runs of the texts whose words (codes) stand in a row, in that order."""
    least = -(-LEAST * (TIMES - 1) // TIMES)
    codes, parent = codes.astype(np.int64), parent.astype(np.int64)
    repeats = _repeating(codes, parent, least)
    codes, parent = codes[repeats], parent[repeats]
    if not len(codes):
        return np.zeros((0, 4), np.int64)
    levels = suffix_ranks(codes, parent)
    begin = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
    width = np.diff(np.append(begin, len(codes)))
    ends, begins = np.repeat(begin + width, width), np.repeat(begin, width)
    order = np.argsort(levels[-1])
    a, b = order[:-1], order[1:]
    same = parent[a] == parent[b]
    a, b = a[same], b[same]
    lcp = common_prefix(levels, ends, a, b)
    edges = np.flatnonzero(lcp >= least)
    edges = edges[np.lexsort((-lcp[edges], parent[a[edges]]))]  # text by text, so that what the union-find holds is one text's
    cuts = np.flatnonzero(np.diff(parent[a[edges]])) + 1
    found = []
    for part in np.split(edges, cuts):
        found += _seeds(a[part].tolist(), b[part].tolist(), lcp[part].tolist())
    if not found:
        return np.zeros((0, 4), np.int64)
    at, period, length = np.array(found, np.int64).T
    begins_there = at == begins[at]
    begins_there |= codes[np.maximum(at - 1, 0)] != codes[np.maximum(at - 1, 0) + period]
    at, period, length = at[begins_there], period[begins_there], length[begins_there]
    out = np.stack((parent[at], at - begins[at], length + period, period), axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _repeating(codes: np.ndarray, parent: np.ndarray, words: int) -> np.ndarray:
    """For each position whether its text has a stretch of so many words twice (or may have, by a 64-bit hash)."""
    n = len(codes)
    if n < words:
        return np.zeros(n, bool)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    whole = np.zeros(n - words + 1, np.uint64)
    for k in range(words):
        whole = (whole ^ mixed[k : len(whole) + k]) * np.uint64(0xD6E8FEB86659FD93)
        whole ^= whole >> np.uint64(32)
    inside = np.flatnonzero(parent[: len(whole)] == parent[words - 1 :])
    key = whole[inside] ^ ((parent[inside].astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9))
    order = np.argsort(key)
    twice = np.flatnonzero(key[order][1:] == key[order][:-1])
    marked = np.zeros(int(parent[-1]) + 1, bool)
    marked[parent[inside[order[twice]]]] = True
    return marked[parent]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """For each of n words whether no run (start, length, period) holds it after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (in order of start, then period) and the text with each run cut to its first period."""
    arrow_batches(docs.sparkSession)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, parent = words_of(texts(batch))
            coded = words.dictionary_encode()
            found = runs_of(coded.indices.to_numpy(zero_copy_only=False), parent)
            ends = np.searchsorted(parent, np.arange(batch.num_rows + 1))
            cuts = np.searchsorted(found[:, 0], np.arange(batch.num_rows + 1))
            runs, collapsed = [], []
            for k, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                own = found[cuts[k] : cuts[k + 1], 1:]
                runs.append([dict(zip(("start", "length", "period"), row, strict=True)) for row in own.tolist()])
                part = words.slice(low, high - low)
                if len(own):
                    part = part.filter(pa.array(kept_words(high - low, own)))
                collapsed.append(" ".join(part.to_pylist()))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(ends), pa.int64()),
                pa.array(runs, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(collapsed, pa.string()),
            ], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(search, _OUT)
