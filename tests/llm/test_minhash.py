import numpy as np
import pytest

minhash = pytest.importorskip("quillflow.llm.minhash")
from test_near import brute, corpus  # noqa: E402

from quillflow.llm import near, queries  # noqa: E402


def pair(rng, n, similarity):
    """Two random sets of about n tokens with at least that Jaccard similarity."""
    x = rng.integers(0, 2**63, n, dtype=np.uint64)
    both = int(np.ceil(similarity * n))
    half = (n - both) // 2
    return np.sort(x[: both + half]), np.sort(np.concatenate((x[:both], x[both + half :])))


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def with_kept(rows):
    return sorted(((d, n, c, d == c) for d, n, c in rows), key=str)


def test_samples_agree_as_binomial():
    """Mean and spread of agreement, a shared band, and a sketch within its bound, at the threshold."""
    rng = np.random.default_rng(7)
    for n in (7, 20, 100, 800):
        similarity = np.ceil(0.85 * n) / n
        agree, odd = [], []
        for _ in range(400):
            a, b = pair(rng, n, similarity)
            rows = np.stack((minhash.samples(a), minhash.samples(b)))
            agree.append(int((rows[0] == rows[1]).sum()))
            keys, bits = minhash.band_keys(rows), minhash.odd_sketches(rows)
            assert (keys[0] == keys[1]).any()
            odd.append(int(np.bitwise_count(bits[0] ^ bits[1]).sum()))
            assert odd[-1] <= 2 * (minhash.SAMPLES - agree[-1]) and (odd[-1] - 2 * (minhash.SAMPLES - agree[-1])) % 2 == 0
        spread = np.sqrt(minhash.SAMPLES * similarity * (1 - similarity))
        assert abs(np.mean(agree) - minhash.SAMPLES * similarity) < spread / 4 and 0.8 < np.std(agree) / spread < 1.2
        assert max(odd) <= minhash.MOST_ODD
        assert abs(np.mean(minhash.differing(np.array(odd))) - 2 * minhash.SAMPLES * (1 - similarity)) < 2


def test_sketches_same_as_plain_parities():
    rows = np.random.default_rng(3).integers(0, 2**32, (5, minhash.SAMPLES), dtype=np.uint32)
    for row, bits in zip(rows, minhash.odd_sketches(rows), strict=True):
        plain = [0] * minhash.BITS
        for k, v in enumerate(row.tolist()):
            plain[int(near.mix64(np.array([v + (k << 32) + 1], np.uint64))[0]) % minhash.BITS] ^= 1
        assert np.unpackbits(bits.view(np.uint8), bitorder="little").tolist() == plain


@pytest.mark.parametrize(("seed", "hot", "small"), [(1, 0, 16), (2, 3, 2), (3, 2, 2)])
def test_same_as_brute_force(spark, monkeypatch, seed, hot, small):
    """With large keys and small blocks too."""
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "BLOCK", 7)
    rows = corpus(seed, 250, hot=hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(minhash.near_duplicates(docs)) == with_kept(brute(rows, 85))


def test_query_same_as_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert rows_of(queries.op13_minhash(spark, folder)) == with_kept(brute(docs, 85))


def test_edge_cases(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "A b c D"), (7, "a b c d e"), (None, "one"), (9, " \n "), (10, "One"), (10, "One"), (11, long), (12, long + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as node", "1 as component_id", "2 as kept")
    wanted = [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5), (7, 1, 7), (None, 1, 3), (9, 0, 9), (10, 1, 3), (10, 1, 3), (11, 59_996, 11), (12, 59_997, 11)]
    assert rows_of(minhash.near_duplicates(docs)) == with_kept(wanted)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
