"""Token ids of whole texts by a public tokenizer, with a bounded cache of chunks.

Byte-level and word-level BPE both split a text before merging, so equal chunks between single
spaces and line ends give equal ids wherever they stand. `Encoder` cuts a batch of texts there, lets
the library encode the chunks that it has not met, and joins ids by chunk. Marks at the end of a chunk
that ends in a plain letter or digit before them are a chunk of their own: both split rules part them.
A text with white space of another kind or in a row, where the byte-level split looks around, goes to
the library whole; the ids are the library's own either way. Chunks are looked up in Arrow and kept
with their ids as flat arrays; when more than `CACHE` are known, those of the batch at hand stay, so a
worker's memory is bounded.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 600_000
GROUP = 500
CUT = "\0"
MARKS = ".,;:!?"
#: Before marks: letters and digits that no other character joins.
_PLAIN_END = r"[A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]$"
#: White space of any kind but the space, as Unicode has it.
_OTHER = "\\x09-\\x0d\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: Chunks of the byte-level split with white space but one space in front.
_ODD = f"(?s)^ ?$|^[{_OTHER}]|.[ {_OTHER}]"


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each of many runs, one run after another."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size)
    at += np.arange(len(at))
    return at


class Encoder:
    """Encodes texts with the tokenizer file `path`; `spaces` when a token holds the space before it."""

    def __init__(self, path: str, spaces: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.spaces = spaces
        self.mark = "\n" if spaces else " \x01 "  # between chunks: a token of its own that no chunk holds
        self.mark_id = self.library.encode(self.mark, add_special_tokens=False).ids[0]
        self.known = pa.array([], pa.string())
        self.pool = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)  # -1: texts with this chunk go to the library whole

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each text."""
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: pa.Array) -> None:
        """Adds new chunks: encodes them, many to a call, and parts their ids at the mark."""
        if self.spaces:
            alone = pc.equal(chunks, "\n").to_numpy(zero_copy_only=False)
            odd = pc.match_substring_regex(chunks, _ODD).to_numpy(zero_copy_only=False) & ~alone
        else:
            alone = pc.or_(pc.equal(chunks, ""), pc.match_substring(chunks, "\x01")).to_numpy(zero_copy_only=False)
            odd = np.zeros(len(chunks), bool)
        apart = chunks.filter(pa.array(alone))
        plain = chunks.filter(pa.array(~(alone | odd)))
        pools = self.whole(apart.to_pylist())
        sizes = [np.array([len(x) for x in pools], np.int64)]
        if len(plain):
            at = np.append(np.arange(0, len(plain), GROUP), len(plain)).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), plain), self.mark).to_pylist()
            for e in self.library.encode_batch_fast(joined, add_special_tokens=False):
                ids = np.array(e.ids, np.uint32)
                mark = ids == self.mark_id
                sizes.append(np.diff(np.concatenate(([-1], np.flatnonzero(mark), [len(ids)]))) - 1)
                pools.append(ids[~mark])
        size = np.concatenate(sizes)
        held = len(self.pool)
        self.known = pa.concat_arrays([self.known, apart, plain, chunks.filter(pa.array(odd))])
        self.start = np.concatenate((self.start, held + np.cumsum(size) - size, np.zeros(odd.sum(), np.int64)))
        self.size = np.concatenate((self.size, size, np.full(odd.sum(), -1, np.int64)))
        self.pool = np.concatenate((self.pool, *pools))

    def _forget(self, used: np.ndarray) -> None:
        """Keeps the chunks in use."""
        used = np.unique(used)
        size = self.size[used]
        kept = np.maximum(size, 0)
        self.pool = self.pool[gather(self.start[used], kept)]
        self.known, self.start, self.size = self.known.take(pa.array(used)), np.cumsum(kept) - kept, size

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """The number of each chunk among the known ones, after learning those that are new."""
        at = pc.index_in(chunks, value_set=self.known)
        if at.null_count:
            fresh = chunks.filter(at.is_null()).unique()
            before = len(self.known)
            self._learn(fresh)
            late = pc.index_in(chunks, value_set=self.known.slice(before))
            at = pc.if_else(at.is_null(), pc.add(late, before), at)
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def _chunk_ids(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start and size of each chunk's ids in them, whether it is odd) of distinct chunks."""
        stem = pc.utf8_rtrim(chunks, characters=MARKS)
        fits = pc.and_(pc.less(pc.binary_length(stem), pc.binary_length(chunks)), pc.match_substring_regex(stem, _PLAIN_END))
        head = pc.if_else(fits, stem, chunks)
        tail = pc.struct_field(pc.extract_regex(chunks.filter(fits), f"(?P<tail>[{MARKS}]+)$"), "tail")
        if not self.spaces:  # letters lose their case anyway; with other characters, marks could join them first
            head = pc.if_else(pc.string_is_ascii(head), pc.ascii_lower(head), head)
        n = len(chunks)
        number = self._numbers(pa.concat_arrays([head, tail]))
        second = np.zeros(n, np.int64)
        first, rows = number[:n], np.flatnonzero(fits.to_numpy(zero_copy_only=False))
        second[rows] = number[n:]
        one, two = self.size[first], np.zeros(n, np.int64)
        two[rows] = np.maximum(self.size[second[rows]], 0)
        odd = one < 0
        one = np.maximum(one, 0)
        runs = np.stack([self.start[first], self.start[second]], axis=1).ravel()
        width = np.stack([one, two], axis=1).ravel()
        ids = self.pool[gather(runs, width)]
        size = one + two
        if len(self.known) > CACHE:
            self._forget(number)
        return ids, np.cumsum(size) - size, size, odd

    def encode(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the n + 1 offsets of the texts in them."""
        n = len(array)
        alone = pc.match_substring(array, CUT).to_numpy(zero_copy_only=False)
        cut = pc.if_else(pa.array(alone), "", array)
        if self.spaces:
            cut = pc.replace_substring(pc.replace_substring(cut, "\n", f"{CUT}\n{CUT}"), " ", f"{CUT} ")
            lists = pc.split_pattern(cut, CUT)
        else:
            lists = pc.split_pattern(pc.replace_substring(cut, "\n", " "), " ")
        parts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        pool, start, size, odd = self._chunk_ids(coded.dictionary)
        owner = np.repeat(np.arange(n), parts)
        if self.spaces and odd.any():
            alone[owner[odd[code]]] = True
            alone &= pc.binary_length(array).to_numpy(zero_copy_only=False) > 0
        if alone.any():
            kept = ~alone[owner]
            code, owner = code[kept], owner[kept]
        width = size[code]
        ends = np.concatenate(([0], np.cumsum(np.bincount(owner, weights=width, minlength=n).astype(np.int64))))
        ids = pool[gather(start[code], width)]
        if not alone.any():
            return ids, ends
        rows = np.flatnonzero(alone)
        rest = dict(zip(rows.tolist(), self.whole(array.take(pa.array(rows)).to_pylist()), strict=True))
        pieces = [rest[k] if k in rest else ids[ends[k] : ends[k + 1]] for k in range(n)]
        return np.concatenate(pieces), np.concatenate(([0], np.cumsum([len(p) for p in pieces])))


@cache
def encoder(path: str, spaces: bool) -> Encoder:
    """The worker's encoder of a file."""
    return Encoder(path, spaces)
