import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

runs = pytest.importorskip("quillflow.llm.runs")
from quillflow.llm import queries  # noqa: E402


def brute(words):
    """All runs (start, length, period) by comparing every word with the one a period before."""
    n, out = len(words), []
    for q in range(1, n // runs.TIMES + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            if len(stretch) >= max(runs.LEAST, runs.TIMES * q) and all(any(stretch[k] != stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, q)):
                out.append((i, len(stretch), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts_with_runs(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            base = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 14))]
            parts += base * rng.randint(1, 30 // len(base) + 3) + base[: rng.randint(0, len(base))]
            if rng.random() < 0.4:
                parts += parts[-rng.randint(1, 40) :]
        yield parts


@pytest.mark.parametrize("plain", [4_096, 6])
def test_runs_same_as_brute_force(monkeypatch, plain):
    monkeypatch.setattr(runs, "PLAIN", plain)
    batch = list(texts_with_runs(plain, 400)) + [[], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 500, list("ab") * 12, list("abc") * 8 + ["a"]]
    names = {w: k for k, w in enumerate("abcdefgh")}
    codes = np.array([names[w] for words in batch for w in words])
    parent = np.repeat(np.arange(len(batch)), [len(words) for words in batch])
    found = [[] for _ in batch]
    for text, *run in runs.runs_of(codes, parent).tolist():
        found[text].append(tuple(run))
    for words, got in zip(batch, found, strict=True):
        assert got == brute(words)
    assert sum(map(len, found)) > 400


def test_very_long_texts():
    """A repeated word, a repeated passage and words of two letters, half a million words each."""
    n = 500_000
    rng = np.random.default_rng(2)
    begun = time.perf_counter()
    for codes, most in ((np.zeros(n, int), 1), (np.tile(np.arange(1_000), n // 1_000), 1), (rng.integers(0, 2, n), None)):
        found = runs.runs_of(codes, np.zeros(n, int))
        if most:
            assert found[:, 1:].tolist() == [[0, n, len(np.unique(codes))]]
    assert time.perf_counter() - begun < 120


def wanted(doc_id, text):
    """The digest row of a document by the stated rules."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if n and h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    found = brute(words)
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    row = (doc_id, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None)
    return (*row, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_same_as_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_periodic_runs(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    answer = con.execute(queries.OP11_SQL)
    at = [[d[0] for d in answer.description].index(c) for c in COLUMNS]
    assert {r[at[0]]: tuple(r[k] for k in at) for r in answer.fetchall()} == found
    short = [r for r in docs if len((r.text or "").split()) < 700]
    assert len(short) > 100
    for r in short:
        assert found[r.doc_id] == wanted(r.doc_id, r.text)


def test_edge_cases(spark):
    zero = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a " * 24), (5, "a " * 24), (6, "x y " * 30 + "z"), (zero, "p q r s"), (zero, ""), (None, "b " * 30), (7, " ".join(f"w{k % 9}" for k in range(200_000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as runs", "'x' as collapsed", "2 as n_words")
    key = lambda r: (str(r[0]), r[1])
    # The long text's own run is stated, as brute force is quadratic.
    found = sorted((tuple(r[c] for c in COLUMNS) for r in queries.run_digests(docs).collect() if r.doc_id != 7), key=key)
    plain = [(d, t) for d, t in rows if d not in (None, 7)]
    assert [f for f in found if f[0] is not None] == sorted((wanted(*r) for r in plain), key=key)
    assert [f[1:6] for f in found if f[0] is None] == [(1, 0, 30, 1, 30_000)]
    long = [r for r in runs.periodic_runs(docs).collect() if r.doc_id == 7][0]
    assert [tuple(r) for r in long.runs] == [(0, 200_000, 9)] and long.collapsed == " ".join(f"w{k}" for k in range(9))
    assert queries.run_digests(docs.limit(0)).count() == 0
