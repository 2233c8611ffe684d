"""Quality rules: base counts and a hashed n-gram log-likelihood ratio, target against raw corpus.

Two multinomials over hashed 4-grams of UTF-8 bytes are estimated: one on trusted target texts
(all with labels.quality = 1, found by a join on doc_id), one on every document.
A text's score is the mean over its n-grams of log p_target - log p_raw, so it does not depend on
length. A document stays when it passes the base rules and its score is at least `threshold`.

Counts are summed in Spark: each task sends one row per bucket in use, at most 2**bits. Only the
2**bits weights reach the driver and are broadcast, whatever the size of the corpus.

Defined cases: a null or empty text has no words and no n-grams, scores 0 and fails the base rules;
texts under 4 bytes score 0; without target rows all scores are 0 and the base rules alone decide;
very long texts are counted whole; a score at the threshold (ties) stays; repeated rows are each judged; an
empty table gives no rows; other columns are ignored by `quality_scores`, kept by `quality_filter`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import arrow_batches, raw_bytes, texts, words_of

BITS = 16
#: Up to so many trusted ids are broadcast; more are met by a shuffle of the texts, into hashed ids, which sorts none.
BROADCAST_IDS = 1_000_000
THRESHOLD = -0.3
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

SCORES = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, llr double"
)
_COUNTS = "bucket int, n long"


def gram_buckets(data: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The bucket of the 4-gram that starts at each byte but the last three."""
    if len(data) < 4:
        return np.zeros(0, np.int64)
    word = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        word |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    word *= np.uint32(2654435761)  # Knuth's multiplicative hash
    return (word >> np.uint32(32 - bits)).astype(np.int64)


def _windows(offsets: np.ndarray, total: int, span: int) -> np.ndarray:
    """The text of each window of `span` bytes, -1 where it crosses into the next text."""
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    head, tail = owner[: max(0, total - span + 1)], owner[span - 1 :]
    return np.where(head == tail, head, -1)


def base_counts(array: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text, by the names of the result's columns."""
    n = len(array)
    words, parent = words_of(array)
    counts = {"n_words": np.bincount(parent, minlength=n)}
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    counts["word_chars"] = np.bincount(parent, weights=chars, minlength=n).astype(np.int64)

    data, offsets = raw_bytes(array)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    at = np.flatnonzero(symbol[data])
    counts["n_symbols"] = np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=n)

    dup = np.zeros(n, np.int64)
    for k, text in enumerate(array.to_pylist()):
        lines = text.split("\n")
        if len(lines) > len(set(lines)):
            filled = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
            dup[k] = len(filled) - len(set(filled))
    counts["n_dup_lines"] = dup

    repeated = np.zeros(len(words), bool)
    if len(words) > 2:
        code = words.dictionary_encode()
        size = max(1, len(code.dictionary))
        code = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        inside = np.flatnonzero(parent[:-2] == parent[2:])
        pair = pd.factorize(parent[inside] * size + code[inside])[0]  # a first word of a text
        pair = pd.factorize(pair * size + code[inside + 1])[0]
        window = pd.factorize(pair * size + code[inside + 2])[0]
        twice = inside[np.bincount(window)[window] > 1] if len(window) else inside
        for k in range(3):
            repeated[twice + k] = True
    counts["n_repeat_words"] = np.bincount(parent[repeated], minlength=n)
    return counts


def gram_weights(docs: DataFrame, labels: DataFrame, bits: int = BITS, broadcast_ids: int = BROADCAST_IDS) -> np.ndarray:
    """log p_target - log p_raw of each bucket, from all documents and all target texts; zeros without target texts."""
    arrow_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids.hint("shuffle_hash")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            data, offsets = raw_bytes(texts(batch))
            counts += np.bincount(gram_buckets(data, bits)[_windows(offsets, len(data), 4) >= 0], minlength=1 << bits)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": counts[used]})

    every = rows.mapInArrow(count, _COUNTS).select("bucket", F.col("n").alias("raw"), F.lit(0).cast("long").alias("target"))
    trusted = rows.join(ids, "doc_id", "left_semi").mapInArrow(count, _COUNTS).select("bucket", F.lit(0).cast("long").alias("raw"), F.col("n").alias("target"))
    found = every.union(trusted).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw = np.zeros(1 << bits)
    target = np.zeros(1 << bits)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    if not target.sum():
        return np.zeros(1 << bits, np.float32)
    half = 0.5 * (1 << bits)
    return (np.log((target + 0.5) / (target.sum() + half)) - np.log((raw + 0.5) / (raw.sum() + half))).astype(np.float32)


def judge(array: pa.Array, weights: np.ndarray, threshold: float = THRESHOLD) -> dict[str, np.ndarray]:
    """Counts, score and verdict of each text."""
    out = base_counts(array)
    data, offsets = raw_bytes(array)
    bits = len(weights).bit_length() - 1
    buckets, owner = gram_buckets(data, bits), _windows(offsets, len(data), 4)
    inside = owner >= 0
    grams = np.bincount(owner[inside], minlength=len(array))
    total = np.bincount(owner[inside], weights=weights[buckets[inside]], minlength=len(array))
    out["llr"] = np.round(total / np.maximum(grams, 1), 9)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    out["kept"] = ~out["base_failed"] & (out["llr"] >= threshold)
    return out


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the base counts, `base_failed`, `kept` and the score `llr`."""
    weights = docs.sparkSession.sparkContext.broadcast(gram_weights(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {"doc_id": batch.column("doc_id").cast(pa.int64())} | judge(texts(batch), weights.value, threshold)
            yield pa.RecordBatch.from_pydict({name: found[name] for name in (field.split()[0] for field in SCORES.split(", "))})

    return docs.select("doc_id", "text").mapInArrow(score, SCORES)


def quality_filter(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that pass, with all their columns, in one pass after the counts."""
    weights = docs.sparkSession.sparkContext.broadcast(gram_weights(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(texts(batch), weights.value, threshold)["kept"]))

    return docs.mapInArrow(keep, docs.schema)
