"""Quality classifier: overlapping heuristic labellers, EM on their votes, a hashed linear scorer.

Every document is voted on by heuristics about symbols, capitals, repetition, lines, bars, exclamation marks,
word and sentence lengths, echoed words and letters; no labels are read. Votes are counted per distinct vote row
over all documents in Spark (at most 3 ** labellers rows reach the driver), and expectation-maximisation
estimates the labellers' rates in both classes; the class of bad texts is a mixture of kinds of faults (`weak`),
as labellers that see one kind agree too often to be told from the class otherwise. Posterior labels of about
`train_rows` documents, drawn by a fixed hash threshold, train a logistic regression on the shares of byte
4-grams, hashed to 2**BITS buckets. Neither votes nor the ratios that the labellers look at are features. It
scores every whole text; a document is kept when its score is at least KEEP_SCORE.

Defined cases: null or empty texts have no gram and get the score of the bias; very long texts are read whole;
equal texts get equal scores (ties); repeated rows are each scored; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm import weak
from quillflow.llm.common import arrow_batches, raw_bytes, texts, words_of
from quillflow.llm.quality import base_counts, gram_buckets

TRAIN_ROWS = 8_000
BITS = 12
SCALE = 40.0
#: Words under which a text is too short to be faulted for repetition or shape.
SHORT = 50
#: Grams that a short text counts as at least, so that a few rare ones do not decide.
LEAST = 20
KEEP_SCORE = 0.4
SCORES = "doc_id long, score double, posterior double, kept boolean"
LABELLERS = ("symbols", "capitals", "repetition", "duplicate lines", "bars", "exclamations", "word length", "sentences", "echoes", "letters")


def ratios(array: pa.Array) -> np.ndarray:
    """Per text: shares of symbols, capitals, repeated words, duplicate lines, bars, exclamation marks, the mean word length, full stops a word, the number of words, the share of words that repeat the word before, the share of letters among bytes that aren't white space."""
    n = len(array)
    base = base_counts(array)
    data, offsets = raw_bytes(array)

    def share(flags: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(flags)
        return np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=n)

    words = np.maximum(1, base["n_words"])
    lines = np.maximum(1, pc.count_substring(array, "\n").to_numpy(zero_copy_only=False) + 1)
    upper, lower = share((data >= 65) & (data <= 90)), share((data >= 97) & (data <= 122))
    stops = share(data == 46)
    letters = upper + lower + share(data >= 128)
    chunks, parent = words_of(array)
    code = chunks.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    echoes = np.bincount(parent[1:][(code[1:] == code[:-1]) & (parent[1:] == parent[:-1])], minlength=n)
    return np.stack([
        base["n_symbols"] / words, upper / np.maximum(1, upper + lower), base["n_repeat_words"] / words, base["n_dup_lines"] / lines,
        share(data == 124) / words, share(data == 33) / words, base["word_chars"] / words, stops / words, base["n_words"],
        echoes / words, letters / np.maximum(1, share(data > 32)),
    ], axis=1)


def votes_of(r: np.ndarray, sized: np.ndarray) -> np.ndarray:
    """Votes (yes: good text) of the labellers; texts without words get none."""

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, weak.NO, np.where(good, weak.YES, weak.ABSTAIN))

    symbols, capitals, repeats, lines, bars, shouts, length, stops, words, echoes, letters = r.T
    enough = words >= SHORT
    votes = np.stack([
        vote(symbols > 0.5, symbols < 0.05), vote(capitals > 0.5, capitals < 0.25), vote((repeats > 0.5) & enough, repeats < 0.2), vote((lines > 0.5) & enough, lines < 0.2),
        vote(bars > 0.3, bars < 0.02), vote(shouts > 0.5, shouts < 0.05), vote((length > 12) & enough, (length > 2) & (length < 9)), vote((stops > 0.6) & enough, (stops > 0.01) & (stops < 0.5)),
        vote((echoes > 0.3) & enough, echoes < 0.05), vote(letters < 0.72, letters > 0.85),
    ], axis=1)
    return np.where(sized[:, None], votes, weak.ABSTAIN)


def _code(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def _decode(code: np.ndarray) -> np.ndarray:
    return code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def _grams(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, grams per text) of the 4-grams inside texts."""
    data, offsets = raw_bytes(array)
    owner = np.repeat(np.arange(len(array)), np.diff(offsets))
    head, tail = owner[: max(0, len(data) - 3)], owner[3:]
    inside = head == tail
    return head[inside], gram_buckets(data, BITS)[inside], np.bincount(head[inside], minlength=len(array))


def fit_labels(docs: DataFrame) -> weak.LabelModel:
    """The label model of the labellers' votes on all documents."""
    arrow_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(3 ** len(LABELLERS), np.int64)
        for batch in batches:
            r = ratios(texts(batch))
            tally += np.bincount(_code(votes_of(r, r[:, 6] > 0)), minlength=len(tally))
        used = np.flatnonzero(tally)
        yield pa.RecordBatch.from_pydict({"code": used, "n": tally[used]})

    rows = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()
    if not len(rows):
        rows = rows.reindex([0]).fillna(0)
    votes = _decode(rows["code"].to_numpy(np.int64))
    return weak.fit(votes, rows["n"].to_numpy(float), np.where((votes == weak.NO).any(axis=1), 0.1, 0.95), said=weak.NO)


def train(docs: DataFrame, model: weak.LabelModel, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights of the buckets and the bias, from posterior labels of about `train_rows` documents."""
    drawn = F.pmod(F.xxhash64(F.lit(10), "doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, train_rows / max(1, docs.count())) * (1 << 30))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = texts(batch)
            r = ratios(array)
            owner, bucket, grams = _grams(array)
            counts = np.bincount(owner * (1 << BITS) + bucket, minlength=len(array) << BITS).reshape(len(array), -1)
            x = SCALE * counts / np.maximum(LEAST, grams)[:, None]
            code = _code(votes_of(r, r[:, 6] > 0))
            yield pa.RecordBatch.from_pydict({"code": code, "x": pa.array([row.tobytes() for row in x.astype(np.float16)], pa.binary())})

    rows = docs.where(drawn).select("text").mapInArrow(read, "code long, x binary").toPandas()
    if not len(rows):
        return np.zeros((1 << BITS) + 1)
    x = np.stack([np.frombuffer(v, np.float16) for v in rows["x"]]).astype(np.float32).view(weak.Dense)
    soft = model.posterior(_decode(rows["code"].to_numpy(np.int64)))
    weight = np.where(soft >= 0.5, 0.5 / max(1.0, (soft >= 0.5).sum()), 0.5 / max(1.0, (soft < 0.5).sum()))
    return weak.logistic(x, soft, weight, penalty=1e-5)


def quality_classes(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score, posterior (of the labellers alone) and kept of every document."""
    model = fit_labels(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model, train(docs, model, train_rows)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_, w = shared.value
        for batch in batches:
            array = texts(batch)
            r = ratios(array)
            owner, bucket, grams = _grams(array)
            logit = w[-1] + SCALE * np.bincount(owner, weights=w[bucket], minlength=len(array)) / np.maximum(LEAST, grams)
            value = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
            posterior = model_.posterior(votes_of(r, r[:, 6] > 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(value), pa.array(posterior), pa.array(value >= KEEP_SCORE)], names=["doc_id", "score", "posterior", "kept"])

    return docs.select("doc_id", "text").mapInArrow(score, SCORES)
