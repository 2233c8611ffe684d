"""Toxicity by weak supervision: lexicon and pattern voters, a label model, a linear classifier.

Features are hashed: each distinct word of a text (lower-cased, without marks at its ends) gives
itself and its byte n-grams, the word's beginning counting as a byte. All of a batch's distinct words
are hashed at once in NumPy.

1. Sample. At most TOXIC_ROWS toxic and CLEAN_ROWS clean labelled documents and about FREE_ROWS without
   a label, picked by a fixed hash among those with crc32(doc_id) mod 5 not 0, are written as a table.
2. Lexicon. Spark counts in how many toxic and clean sample texts each feature stands in one or more,
   and in two or more words; the at most VOCABULARY features that mark toxic texts most are kept.
3. Voters. At most VOTERS of these are lexicon voters: the strongest, leaving out those that hit the same
   texts as a stronger one. Pattern voters look at shouting, masked words, drawn-out letters and commands.
4. The label model (`weak`) learns the voters' accuracies and, by kinds, their correlations from the
   votes; labelled rows keep their class, the others follow the votes.
5. Its posterior labels, from votes alone, train a logistic regression on counts of the whole vocabulary.

Scoring reads every whole text; labels, lang, source and ids are never inputs of a score. What reaches
the driver is bounded by the parameters above, whatever the size of the corpus.

Defined cases: null or empty texts get the score of no features; without usable labels of both classes
all scores are about 0; ties in the orders go by feature number; repeated rows are each scored; very
long texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm import weak
from quillflow.llm.common import arrow_batches, labelled_ids, mix64, raw_bytes, texts, words_of, written

TOXIC_ROWS = 4_000
CLEAN_ROWS = 8_000
FREE_ROWS = 4_000
VOCABULARY = 1 << 14
VOTERS = 60
#: Sample texts of the toxic class in which a feature must stand, and its least log odds.
LEAST_TEXTS = 4
LEAST_ODDS = 1.5
#: Least log odds times the root of the number of toxic texts, so that rare features mark by chance seldom.
LEAST_MARK = 6.0
#: A voter is left out when this share of its toxic texts are a stronger voter's and the reverse.
SAME = 0.8
#: What missing a toxic text costs, as against accusing a clean one.
MISS_COST = 1.5
BITS = 20
GRAMS = (4, 6, 8)
FOLDS = 5
MARKS = ".,;:!?\"'()[]{}<>|*#$%&_-~/\\"
PATTERNS = ("shouting", "masked words", "drawn-out letters", "exclamations")

SCORES = "doc_id long, held_out boolean, score double, predicted int"


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature number) of distinct words: each word and the n-grams of its bytes."""
    data, offsets = raw_bytes(words)
    size = np.diff(offsets)
    count = len(size)
    bare = np.zeros(len(data) + count, np.uint64)  # a zero byte before each word marks its beginning
    owner = np.repeat(np.arange(count), size + 1)
    bare[np.arange(len(data)) + np.repeat(np.arange(count), size) + 1] = data
    mask = np.uint64((1 << BITS) - 1)
    whole = mix64(pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) + np.uint64(1)) & mask if count else np.zeros(0, np.uint64)
    owners, numbers = [np.arange(count)], [whole.astype(np.int64)]
    for n in GRAMS:
        if len(bare) < n:
            continue
        packed = np.zeros(len(bare) - n + 1, np.uint64)
        for k in range(n):
            packed |= bare[k : len(packed) + k] << np.uint64(8 * k)
        inside = owner[: len(packed)] == owner[n - 1 :]
        numbers.append((mix64(packed[inside] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) & mask).astype(np.int64))
        owners.append(owner[: len(packed)][inside])
    return np.concatenate(owners), np.concatenate(numbers)


def distinct_words(array: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text number, word number) of the distinct words of each text, and the words."""
    chunks, parent = words_of(array)
    coded = chunks.dictionary_encode()
    trimmed = pc.utf8_lower(pc.utf8_trim(coded.dictionary, characters=MARKS)).dictionary_encode()
    words = trimmed.dictionary
    size = max(1, len(words))
    code = trimmed.indices.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if len(chunks) else np.zeros(0, np.int64)
    both = pd.unique(parent * size + code)
    return both // size, both % size, words


def counted(array: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, number of distinct words with it) of texts; only features with wanted >= 0, by that number."""
    owner, word, words = distinct_words(array)
    holder, number = word_features(words)
    once = pd.unique(holder * (1 << BITS) + number)
    holder, number = once >> BITS, once & ((1 << BITS) - 1)
    if wanted is not None:
        number = wanted[number]
        holder, number = holder[number >= 0], number[number >= 0]
    by = np.argsort(holder, kind="stable")
    number = number[by]
    width = np.bincount(holder, minlength=len(words))
    start = np.cumsum(width) - width
    spread = width[word]
    at = np.repeat(start[word] - (np.cumsum(spread) - spread), spread) + np.arange(spread.sum())
    both, times = np.unique(np.repeat(owner, spread) * (1 << BITS) + number[at], return_counts=True)
    return both >> BITS, both & ((1 << BITS) - 1), times


def length_of(words: np.ndarray) -> np.ndarray:
    """The length feature of texts by their numbers of distinct words: 0 up to some 150, then rising slowly."""
    return np.maximum(0, np.log1p(words) - 5) / 2


def patterns(array: pa.Array) -> np.ndarray:
    """For each text whether it shouts, masks words, draws letters out, exclaims."""
    data, offsets = raw_bytes(array)
    n, size = len(array), np.maximum(1, np.diff(offsets))

    def share(flags: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(flags)
        return np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=n) / size

    letter = (data >= 97) & (data <= 122) | (data >= 65) & (data <= 90)
    masked = np.zeros(len(data), bool)
    masked[1:-1] = letter[:-2] & ((data[1:-1] == 42) | (data[1:-1] == 36) | (data[1:-1] == 64)) & letter[2:]
    drawn = np.zeros(len(data), bool)
    drawn[3:] = letter[3:] & (data[3:] == data[2:-1]) & (data[3:] == data[1:-2]) & (data[3:] == data[:-3])
    drawn &= np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)) >= 3
    return np.stack([share((data >= 65) & (data <= 90)) > 0.3, share(masked) > 0, share(drawn) > 0, share(data == 33) > 0.02], axis=1)


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, float]:
    """The sample's texts and class (1, 0, -1: none) as a table, the ids of both classes, and the share of toxic labels."""
    usable = F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0
    toxic = labelled_ids(labels, usable & (F.col("toxic") == 1), TOXIC_ROWS)
    clean = np.setdiff1d(labelled_ids(labels, usable & (F.col("toxic") == 0), CLEAN_ROWS), toxic)
    rates = labels.where(usable).agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    ids = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": np.concatenate((toxic, clean)), "known": np.repeat([1, 0], [len(toxic), len(clean)])}), "doc_id long, known int")
    free = min(1.0, 2 * FREE_ROWS / max(1, docs.count()))  # of which labelled and held-out rows fall away
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < int(free * (1 << 30))
    rows = docs.select("doc_id", "text").where(usable).join(F.broadcast(ids), "doc_id", "left").where(F.col("known").isNotNull() | drawn)
    any_label = labels.select("doc_id").where(drawn).distinct().withColumn("_any", F.lit(1))
    rows = rows.join(any_label, "doc_id", "left").where("known is not null or _any is null")
    return written(rows.select("text", F.coalesce("known", F.lit(-1)).alias("known")), "sample"), toxic, clean, rates


def _vocabulary(sample: DataFrame, toxic: int, clean: int) -> pd.DataFrame:
    """The features that mark toxic texts: number, toxic and clean texts with it in one word or more (least 1) or two (least 2)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros((2, 2, 1 << BITS), np.int32)
        for batch in batches:
            known = batch.column("known").to_numpy()
            owner, number, times = counted(texts(batch))
            for side in (0, 1):
                mine = known[owner] == side
                tally[side, 0] += np.bincount(number[mine], minlength=1 << BITS).astype(np.int32)
                tally[side, 1] += np.bincount(number[mine & (times > 1)], minlength=1 << BITS).astype(np.int32)
        for least in (1, 2):
            used = np.flatnonzero(tally[:, least - 1].any(axis=0))
            yield pa.RecordBatch.from_pydict({"feature": used, "least": np.full(len(used), least, np.int32), "t": tally[1, least - 1, used].astype(np.int64), "c": tally[0, least - 1, used].astype(np.int64)})

    found = sample.mapInArrow(count, "feature long, least int, t long, c long").groupBy("feature", "least").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    marked = found.where(F.col("t") >= LEAST_TEXTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).withColumn("mark", F.col("odds") * F.sqrt("t")).where(F.col("mark") >= LEAST_MARK)
    return marked.orderBy(F.desc("mark"), "feature", "least").limit(VOCABULARY).toPandas()


def choose_voters(found: pd.DataFrame, owner: np.ndarray, number: np.ndarray, times: np.ndarray, weight: np.ndarray) -> list[int]:
    """Rows of `found` (strongest first) to vote; the entries are the toxic sample texts' features."""
    hits: list[np.ndarray] = []
    chosen = []
    order = np.argsort(number, kind="stable")
    ends = np.searchsorted(number[order], np.arange(int(number.max(initial=-1)) + 2))
    for row, (feature, least) in enumerate(zip(found["slot"], found["least"], strict=True)):
        if len(chosen) == VOTERS:
            break
        entries = order[ends[feature] : ends[feature + 1]] if feature + 1 < len(ends) else order[:0]
        mine = np.zeros(len(weight), bool)
        mine[owner[entries[times[entries] >= least]]] = True
        size = mine.sum()
        if size and not any((both := (mine & other).sum()) >= SAME * size and both >= SAME * other.sum() for other in hits):
            hits.append(mine)
            chosen.append(row)
    return chosen


def votes_of(n: int, owner: np.ndarray, number: np.ndarray, times: np.ndarray, voters: list[tuple[int, int]], marks: np.ndarray) -> np.ndarray:
    """The votes on n texts: yes or abstain, of the lexicon voters (feature, least words), then of the patterns."""
    out = np.zeros((n, len(voters) + marks.shape[1]), np.int64)
    for j, (feature, least) in enumerate(voters):
        out[owner[(number == feature) & (times >= least)], j] = weak.YES
    out[:, len(voters) :] = np.where(marks, weak.YES, weak.ABSTAIN)
    return out


class Model:
    """The lexicon (slot of each feature or -1), the classifier's weights (bias last), voters, label model."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, voters: list[tuple[int, int]], labels: weak.LabelModel | None):
        self.slots, self.weights, self.voters, self.labels = slots, weights, voters, labels
        used = np.flatnonzero(slots >= 0)
        self.by_feature = np.zeros(len(slots))
        self.by_feature[used] = weights[slots[used]] if len(used) else 0.0

    def score(self, array: pa.Array) -> np.ndarray:
        """The score of each text: the weights of all its distinct words' features and of its length."""
        owner, word, words = distinct_words(array)
        holder, number = word_features(words)
        once = pd.unique(holder * (1 << BITS) + number)
        per_word = np.bincount(once >> BITS, weights=self.by_feature[once & ((1 << BITS) - 1)], minlength=len(words))
        logit = self.weights[-1] + np.bincount(owner, weights=per_word[word], minlength=len(array))
        logit += self.weights[-2] * length_of(np.bincount(owner, minlength=len(array)))
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model learnt from labels of rows that aren't held out."""
    spark = docs.sparkSession
    arrow_batches(spark)
    nothing = Model(np.full(1 << BITS, -1), np.array([0.0, -50.0]), [], None)
    sample, toxic, clean, rate = _sample(docs, labels)
    if not len(toxic) or not len(clean):
        return nothing
    found = _vocabulary(sample, len(toxic), len(clean))
    if not len(found):
        return nothing
    features = np.unique(found["feature"].to_numpy(np.int64))
    slots = np.full(1 << BITS, -1)
    slots[features] = np.arange(len(features))
    found["slot"] = slots[found["feature"]]
    shared = spark.sparkContext.broadcast(slots)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            array = texts(batch)
            owner, number, times = counted(array, shared.value)
            ends = np.searchsorted(owner, np.arange(len(array) + 1))
            packed = np.stack([number, np.minimum(times, 1 << 20)], axis=1).astype("<i4")
            rows = [packed[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            sizes = np.bincount(distinct_words(array)[0], minlength=len(array))
            marks = patterns(array) @ (1 << np.arange(len(PATTERNS)))
            yield pa.RecordBatch.from_pydict({"known": batch.column("known"), "words": sizes.astype(np.int64), "marks": marks.astype(np.int64), "found": pa.array(rows, pa.binary())})

    rows = sample.mapInArrow(read, "known int, words long, marks long, found binary").toPandas()
    known, n = rows["known"].to_numpy(np.int64), len(rows)
    entries = np.frombuffer(b"".join(rows["found"]), "<i4").reshape(-1, 2).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(x) // 8 for x in rows["found"]])
    number, times = entries.T
    marks = rows["marks"].to_numpy()[:, None] >> np.arange(len(PATTERNS)) & 1 == 1

    of_toxic = known[owner] == 1
    chosen = choose_voters(found, owner[of_toxic], number[of_toxic], times[of_toxic], known)
    voters = list(zip(found["slot"].iloc[chosen].tolist(), found["least"].iloc[chosen].tolist(), strict=True))
    votes = votes_of(n, owner, number, times, voters, marks)
    # Each class counts as its labels' share of the labelled rows, which the sample's limits don't move.
    labelled = max(1, (known >= 0).sum())
    weight = np.where(known == 1, rate * labelled / max(1, (known == 1).sum()), np.where(known == 0, (1 - rate) * labelled / max(1, (known == 0).sum()), 1.0))
    start = np.where((votes[:, : len(voters)] == weak.YES).any(axis=1), 0.5, rate / 2)
    model = weak.fit(votes, weight, start, known)
    soft = model.posterior(votes)
    columns, at = np.append(number, np.full(n, len(features))), np.append(owner, np.arange(n))
    values = np.append(times.astype(float), length_of(rows["words"].to_numpy(float)))
    weights = weak.logistic(weak.Entries(n, len(features) + 1, at, columns, values), soft, weight * (1 + (MISS_COST - 1) * soft), penalty=1e-5)
    return Model(slots, weights, voters, model)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = model.value.score(texts(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held_out).mapInArrow(score, SCORES)
