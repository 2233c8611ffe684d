"""License scans: winnowed fingerprints pick candidate templates, banded alignment measures them.

Templates are normalised to tokens (lower-case letters and digits of each white-space word). Hashes of
`GRAM` tokens in a row are winnowed (the least of each `WINDOW` neighbours; of templates of at most
`SHORT` tokens every hash) into an inverted index from fingerprint to template positions, small and
fixed, so it is broadcast. A document's hashes are looked up in the index; hits vote for (template,
diagonal). Each cluster of near diagonals with enough hits is aligned token by token within a band of at
most `BAND` around it (match +1, mismatch or gap -1, local). A match reports the share of the template's
tokens that the alignment covers and its span in the document: whole matches from MIN_COVERAGE on, and
parts of at least `PART` tokens with the coverage they have. Of matches that overlap by half, the one
with more matched tokens stays.

A run of GRAM + WINDOW - 1 template tokens holds a fingerprint, one of `PART` tokens at least four, so
every such part meets the NEEDED hits. Documents are scanned whole in one pass without a shuffle; work
grows with a text's length and its hits, not with pairs of them.

Defined cases: null and empty texts have no match; texts of any length are scanned whole; repeated
licenses give a match each; matches of the same span and coverage (ties) are all reported; repeated rows
are each scanned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillflow.llm.common import arrow_batches, mix64, texts, words_of
from quillflow.llm.license_texts import TEMPLATES

GRAM = 3
WINDOW = 3
BAND = 8
MIN_COVERAGE = 0.7
SHORT = 20
PART = 15
#: Clusters that one alignment step takes at once, which bounds its memory.
AT_ONCE = 8_192
#: Fingerprint hits that a cluster needs for a template of more than SHORT tokens.
NEEDED = 3

MATCHES = "doc_id long, matches array<struct<template:string,start:int,end:int,coverage:double>>"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def token_hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word's lower-case letters and digits."""
    if not len(words):
        return np.zeros(0, np.uint64)
    bare = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\pL\pN]", "")
    return mix64(pd.util.hash_array(bare.to_numpy(zero_copy_only=False), categorize=False))


def gram_hashes(tokens: np.ndarray) -> np.ndarray:
    """A hash of each GRAM tokens in a row."""
    out = np.zeros(max(0, len(tokens) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = mix64(out + tokens[k : len(out) + k] * np.uint64(2 * k + 3))
    return out


def winnow(hashes: np.ndarray) -> list[int]:
    """Positions of the least hash (rightmost on ties) of each WINDOW neighbours."""
    last = max(1, len(hashes) - WINDOW + 1)
    found = {low + len(w) - 1 - int(np.argmin(w[::-1])) for low in range(last) if len(w := hashes[low : low + WINDOW])}
    return sorted(found)


class Index:
    """Inverted index from fingerprint to (template, position)."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.tokens = [token_hashes(pa.array(_WORDS.findall(templates[n]), pa.string())) for n in self.names]
        rows = []
        for k, tokens in enumerate(self.tokens):
            hashes = gram_hashes(tokens)
            rows += [(int(hashes[p]), k, p) for p in (winnow(hashes) if len(tokens) > SHORT else range(len(hashes)))]
        rows.sort()
        self.prints = np.array([r[0] for r in rows], np.uint64)
        self.postings = [r[1:] for r in rows]

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Where in a row of hashes a fingerprint of the index stands."""
        if not len(self.prints):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.prints, hashes), len(self.prints) - 1)
        return np.flatnonzero(self.prints[at] == hashes)


def align(template: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, diagonals: np.ndarray, band: int = BAND) -> np.ndarray:
    """(matched template tokens, first and last + 1 text token) of the best local alignment around each diagonal.

    All clusters of a template at once: cluster c aligns with text[low[c]:high[c]], within `band` of diagonals[c]
    (position in `text` minus position in the template). A step of the loop is a template token, a column a
    diagonal of the band; cells hold score, matches and the start of the text span. Of equal scores a diagonal step
    goes before one that skips a template token, and that before one that skips text tokens; the first best cell
    stays. A run of skipped text tokens is the running maximum of score + column over the row.
    """
    n, width = len(diagonals), 2 * band + 1
    column = np.arange(width, dtype=np.int32)
    at = (diagonals - band)[:, None] + column
    score, matches = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
    start = np.zeros((n, width + 1), np.int64)
    top, out = np.zeros(n, np.int32), np.zeros((n, 3), np.int64)
    rows = np.arange(n)
    for token in template:
        inside = (at >= low[:, None]) & (at < high[:, None])
        same = inside & (text[np.clip(at, 0, len(text) - 1)] == token)
        fresh = score[:, :-1] == 0
        here = score[:, :-1] + np.where(same, 1, -1).astype(np.int32)
        count = np.where(fresh, 0, matches[:, :-1]) + same
        begin = np.where(fresh, at, start[:, :-1])
        skip = score[:, 1:] - 1
        better = skip > here
        here = np.where(better, skip, here)
        count, begin = np.where(better, matches[:, 1:], count), np.where(better, start[:, 1:], begin)
        here = np.where(inside, here, -1_000)
        lifted = here + column
        most = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == most, column, 0), axis=1)
        here = most - column
        live = inside & (here > 0)
        score[:, :-1] = np.where(live, here, 0)
        matches[:, :-1] = np.where(live, np.take_along_axis(count, source, 1), 0)
        start[:, :-1] = np.where(live, np.take_along_axis(begin, source, 1), at + 1)
        last = score[:, :-1].argmax(1)
        reached = score[rows, last]
        won = np.flatnonzero(reached > top)
        if len(won):
            top[won] = reached[won]
            out[won] = np.stack((matches[won, last[won]], start[won, last[won]], at[won, last[won]] + 1), axis=1)
        at += 1
    return out


def clusters(index: Index, spots: np.ndarray, hashes: np.ndarray, text: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(template, band, texts, diagonals) of the clusters of near diagonals with enough fingerprint hits.

    `text` has the number of each position's text. Of each template's diagonals in one text, in order, a cluster
    takes all within the band from its first; the middle one stands for it.
    """
    begin = np.searchsorted(index.prints, hashes[spots])
    width = np.searchsorted(index.prints, hashes[spots], side="right") - begin
    posting = np.repeat(begin - np.cumsum(width) + width, width) + np.arange(width.sum())
    spot = np.repeat(spots, width)
    pairs = np.array(index.postings, np.int64).reshape(-1, 2)[posting]
    template, diagonal, owner = pairs[:, 0], spot - pairs[:, 1], text[spot]
    order = np.lexsort((diagonal, owner, template))
    template, diagonal, owner = template[order], diagonal[order], owner[order]
    for name in np.unique(template).tolist():
        low, high = np.searchsorted(template, (name, name + 1))
        size = len(index.tokens[name])
        band, needed = min(BAND, max(1, size // 3)), NEEDED if size > SHORT else 1  # narrower for short templates, so that repeats stay apart
        key = owner[low:high] * (1 << 40) + diagonal[low:high] + (1 << 20)
        ends = np.searchsorted(key, key + band, side="right")
        taken, k = [], 0
        while k < len(key):
            end = int(ends[k])
            if end - k >= needed:
                taken.append((k + end - 1) // 2)
            k = end
        if taken:
            yield name, band, owner[low:high][taken], diagonal[low:high][taken]


def find(index: Index, tokens: np.ndarray, spots: np.ndarray, hashes: np.ndarray, text: np.ndarray, ends: np.ndarray) -> dict[int, list[tuple[str, int, int, float]]]:
    """By text: (template, first token, last token + 1, coverage) of the matches around fingerprint hits.

    Text k's tokens are ends[k] to ends[k + 1] of all tokens.
    """
    found: dict[int, list[tuple[int, float, int, int, str]]] = defaultdict(list)
    for name, band, owner, diagonal in clusters(index, spots, hashes, text):
        size = len(index.tokens[name])
        for k in range(0, len(owner), AT_ONCE):
            own, near = owner[k : k + AT_ONCE], diagonal[k : k + AT_ONCE]
            met = align(index.tokens[name], tokens, ends[own], ends[own + 1], near, band)
            for row in np.flatnonzero((met[:, 0] >= MIN_COVERAGE * size) | (met[:, 0] >= PART)).tolist():
                matched, low, high = met[row].tolist()
                base = int(ends[own[row]])
                found[int(own[row])].append((matched, matched / size, low - base, high - base, index.names[name]))
    return {doc: best(rows) for doc, rows in found.items()}


def best(found: list[tuple[int, float, int, int, str]]) -> list[tuple[str, int, int, float]]:
    """The matches (matched tokens, coverage, start, end, name), by start, without those that overlap a better one by half.

    Better is more matched tokens, then higher coverage; equals at the same place all stay. Runs of
    overlapping matches are settled one by one, each match against its neighbours in reach only.
    """
    out = []
    run: list[tuple[int, float, int, int, str]] = []
    reach = -1
    for m in [*sorted(set(found), key=lambda m: m[2:]), None]:
        if run and (m is None or m[2] >= reach):
            kept: list[tuple[int, int, int, float, str]] = []
            longest = 0
            for size, coverage, low, high, name in sorted(run, key=lambda m: (-m[0], -m[1], m[2:])):
                k = bisect_right(kept, (low - longest,))
                clear = True
                while clear and k < len(kept) and kept[k][0] < high:
                    start, end, other, share, _ = kept[k]
                    shared = min(high, end) - max(low, start)
                    clear = 2 * shared < high - low or (start, end, other, share) == (low, high, size, coverage)
                    k += 1
                if clear:
                    insort(kept, (low, high, size, coverage, name))
                    longest = max(longest, high - low)
            out += [(name, low, high, round(coverage, 4)) for low, high, _, coverage, name in kept]
            run, reach = [], -1
        if m is not None:
            run.append(m)
            reach = max(reach, m[3])
    return out


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document with its matches: template, start, end (code points), coverage."""
    arrow_batches(docs.sparkSession)
    index = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))
    kind = pa.list_(pa.struct([("template", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = texts(batch)
            words, parent = words_of(array)
            coded = words.dictionary_encode()
            tokens = token_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
            hashes = gram_hashes(tokens)
            spots = index.value.hits(hashes)
            spots = spots[parent[spots] == parent[spots + GRAM - 1]]
            ends = np.searchsorted(parent, np.arange(len(array) + 1))
            found: list[list[dict]] = [[] for _ in range(len(array))]
            for doc, matches in find(index.value, tokens, spots, hashes, parent, ends).items():
                places = [m.span() for m in _WORDS.finditer(array[doc].as_py())]
                found[doc] = [{"template": n, "start": places[a][0], "end": places[b - 1][1], "coverage": c} for n, a, b, c in matches]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, kind)], names=["doc_id", "matches"])

    return docs.select("doc_id", "text").mapInArrow(scan, MATCHES)
