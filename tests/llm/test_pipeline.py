"""The corpus pipeline, stage by stage, against brute-force versions on the smallest tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from test_near import brute  # noqa: E402

from quillflow.llm import encode, mixing, quality, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def packed_fully(rows, docs):
    """Asserts that the rows hold each document's ids whole, once per row of docs, in gapless sequences of 4096 at most."""
    library = encode.Encoder(queries.tokenizer("word_bpe_49k.json"), False)
    seen, sequences = defaultdict(Counter), defaultdict(list)
    for r in rows:
        seen[r.doc_id][r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    copies = Counter((r.doc_id, r.text) for r in docs)
    assert {d for d, _ in copies} == set(seen)
    for (doc_id, text), n in copies.items():
        ids = np.append(library.whole([text or ""])[0], np.uint32(1)).astype("<u4")
        wanted = {(k, 4096 * k, len(part), zlib.crc32(part.tobytes())): n for k, part in enumerate(np.split(ids, range(4096, len(ids), 4096)))}
        assert seen[doc_id] == wanted
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    return len(sequences)


def test_stages_same_as_brute_force(spark):
    docs = queries.table(spark, FOLDER, "documents")
    names = docs.columns
    assert [name for name, _ in pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    stages = [stage for _, stage in pipeline.STAGES]
    labels = queries.table(spark, FOLDER, "labels")

    good = stages[0](spark, docs, FOLDER)
    assert good.columns == names
    kept = {r.doc_id for r in quality.quality_scores(docs, labels).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert Counter(r.doc_id for r in good.collect()) == Counter(kept) and len(kept) < len(texts)

    single = stages[1](spark, good, FOLDER)
    best = {}
    for d in kept:
        best[ascii_lower(texts[d])] = max(d, best.get(ascii_lower(texts[d]), d))
    assert single.columns == names and sorted(r.doc_id for r in single.collect()) == sorted(best.values())

    distinct = stages[2](spark, single, FOLDER)
    components = {c for _, _, c in brute([(d, texts[d]) for d in best.values()])}
    assert distinct.columns == names and sorted(r.doc_id for r in distinct.collect()) == sorted(components)
    assert {r.doc_id: r.text for r in distinct.collect()} == {d: texts[d] for d in components}

    mixed = stages[3](spark, distinct, FOLDER)
    assert mixed.columns == names
    times, taken = Counter(r.doc_id for r in mixed.collect()), {r.doc_id: r for r in mixing.mix_sources(distinct).collect()}
    for d, r in taken.items():
        share = r.taken / max(1, r.size)
        assert int(share) <= times[d] <= min(3, int(np.ceil(share)))
    words, target = Counter(), {r.source: r.target for r in taken.values()}
    for d, n in times.items():
        words[taken[d].source] += n * taken[d].size
    # whole documents can't meet a target of a few documents' size exactly
    assert abs(sum(words.values()) - sum(target.values())) < 0.15 * sum(target.values())

    pieces = stages[4](spark, mixed, FOLDER).collect()
    rows = mixed.collect()
    sequences = packed_fully(pieces, rows)
    assert sequences <= 1.1 * sum(r.length for r in pieces) / 4096 + 2


def test_run_returns_the_last_stage(spark):
    found = pipeline.run(spark, FOLDER)
    assert set(found.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert found.count() > 0


def test_mixing_proportions(spark):
    """On a corpus with many documents a source, repeated documents come near the targets."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{j}" for j in range(int(rng.integers(5, 40)))), "abcd"[min(3, k % 7)]) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {r.source: r.target for r in mixing.mix_sources(df).select("source", "target").distinct().collect()}
    words = Counter()
    for r in pipeline.mix_sources(spark, df, FOLDER).collect():
        words[r.source] += len(r.text.split())
    assert all(abs(words[s] - target[s]) < 0.03 * target[s] for s in "abcd")


@pytest.mark.parametrize("stage", range(4))
def test_stages_take_empty_tables_nulls_and_repeats(spark, stage):
    docs = queries.table(spark, FOLDER, "documents")
    run = pipeline.STAGES[stage][1]
    assert run(spark, docs.limit(0), FOLDER).count() == 0
    odd = spark.createDataFrame(
        [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "word " * 60000, "en", "a", 1), (None, "word " * 60000, "en", "a", 1), (3, "one two three", "en", "a", 9), (3, "one two three", "en", "a", 9), (3, "another", "en", "b", 1)],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).selectExpr("*", "'x' AS size", "1 AS kept", "'y' AS component_id")
    found = run(spark, odd, FOLDER)
    assert found.columns == odd.columns
    rows = Counter((r.doc_id, r.text) for r in found.collect())
    assert stage != 0 or not rows  # too few words, or only repeats
    assert stage != 1 or rows == {(2, ""): 1, (None, "word " * 60000): 1, (3, "one two three"): 1, (3, "another"): 1}
    assert stage != 2 or (rows[None, "word " * 60000] == 1 and rows[3, "one two three"] + rows[3, "another"] == 2 and rows[1, None] == rows[2, ""] == 1)
    assert stage != 3 or max(rows.values(), default=0) <= 6


def test_packing_takes_empty_tables(spark):
    assert pipeline.STAGES[4][1](spark, queries.table(spark, FOLDER, "documents").limit(0), FOLDER).count() == 0


def test_packing_takes_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (None, "word " * 60000), (None, "word " * 60000), (3, "one two three"), (3, "one two three"), (6, "another"), (4, "a " * 4095), (5, "a " * 4096)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS piece", "1 AS offset", "'y' AS sequence_id", "2 AS length")
    assert packed_fully(pipeline.STAGES[4][1](spark, docs, FOLDER).collect(), docs.collect()) > 0
