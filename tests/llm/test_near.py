import random
import re
import time
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

near = pytest.importorskip("quillflow.llm.near")


def brute(rows, percent=75):
    """(doc_id, n_shingles, component_id) by comparing all pairs of sets."""
    sets = {}
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    by_token = defaultdict(list)
    for d in ids:
        for t in sets[d]:
            by_token[t].append(d)
    for d in ids:
        met = defaultdict(int)
        for t in sets[d]:
            for e in by_token[t]:
                if e < d:
                    met[e] += 1
        for e, both in met.items():
            if 100 * both >= percent * (len(sets[d]) + len(sets[e]) - both):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def corpus(seed, n, words=300, hot=0):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)]
    passage = rng.choices(vocabulary, k=60)
    rows, base = [], []
    for k in range(n):
        kind = rng.random()
        if base and kind < 0.5:
            new = list(rng.choice(base))
            for _ in range(rng.randint(0, max(1, len(new) // 12))):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
        else:
            new = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 9, 14, 22, 40, 90, 300]))
            if kind > 0.8:
                new = passage + new[: rng.randint(0, 30)]
            if len(base) < hot or not hot:
                base.append(new)
        rows.append((k, " ".join(new)))
    return rows


@pytest.mark.parametrize(("seed", "hot", "small"), [(1, 0, 16), (2, 3, 2)])
def test_same_as_brute_force(spark, monkeypatch, seed, hot, small):
    monkeypatch.setattr(near, "SMALL", small)
    monkeypatch.setattr(near, "BLOCK", 7)
    rows = corpus(seed, 200, hot=hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near.near_duplicates(docs).collect())) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "a b c d"), (6, "A b c D"), (7, "a b c d e"), (None, "one"), (9, " \n "), (10, "One"), (10, "One")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as node", "1 as component_id")
    found = sorted(map(tuple, near.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5), (7, 1, 7), (None, 1, 3), (9, 0, 9), (10, 1, 3), (10, 1, 3)], key=str)
    assert sorted(r.doc_id for r in near.drop_near_duplicates(docs).collect()) == [1, 2, 3, 5, 7, 9]
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_one_id_on_two_texts(spark):
    one, other = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(7, one), (7, other), (7, one + " more"), (7, ""), (8, other + " more"), (9, one), (10, "c"), (10, "")]
    kept = [(r.doc_id, (r.text or "-")[0]) for r in near.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == [(7, "-"), (7, "a"), (7, "b"), (10, "-"), (10, "c")]


def test_prefix_shares_a_key():
    """Any two sets at the threshold share a key, whatever tokens are frequent."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        n = len(a)
        extra = int(rng.integers(0, n // 3 + 1))
        drop = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**63, extra, dtype=np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common < 75 * (len(a) + len(b) - common):
            continue
        both = np.union1d(a, b)
        frequent = np.sort(rng.permutation(both)[: int(rng.integers(0, len(both) + 1))])
        rank = rng.permutation(len(frequent))
        assert np.intersect1d(near.signatures(a, frequent, rank)[0], near.signatures(b, frequent, rank)[0]).size


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_") and name.endswith(".data")}


@pytest.mark.parametrize("query", ["near_duplicates", "drop_near_duplicates"])
def test_shuffle_files_go_with_each_step(spark, query):
    docs = spark.createDataFrame(corpus(3, 120), "doc_id long, text string").repartition(3)
    docs.count()
    before, setting = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    found = getattr(near, query)(docs)
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:  # executors delete them a little later
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    assert found.count() == (120 if query == "near_duplicates" else len({c for _, n, c in brute([tuple(r) for r in docs.collect()])}))


def test_whole_sets_are_sent_only_where_bitmaps_let_them_link(spark, monkeypatch):
    """Sixty sets of four passages, no two of the same four, and a near copy of two of them."""
    rng = random.Random(8)
    passages = [[f"p{k}_{i}" for i in range(40)] for k in range(14)]
    chosen = rng.sample(list(combinations(range(14), 4)), 60)
    texts = [sum((passages[p] for p in some), []) for some in chosen]
    texts += [texts[0] + ["more"], texts[1] + ["more"]]
    rows = [(k, " ".join(words)) for k, words in enumerate(texts)]
    sent, cluster_links, set_table = [], near._cluster_links, near._set_table

    def table(docs, owner, *args, whole=True, **kwargs):
        sent.extend([owner.count()] * whole)
        return set_table(docs, owner, *args, **kwargs, **({} if whole else {"whole": False}))

    monkeypatch.setattr(near, "SMALL", 4)
    monkeypatch.setattr(near, "_set_table", table)
    monkeypatch.setattr(near, "_cluster_links", lambda members, sets: sent.append(members.count()) or cluster_links(members, sets))
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(sent) <= 4
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_blocks_of_bitmaps_and_of_sets_find_the_same_links(spark, monkeypatch):
    """Families in clusters of many blocks, whose links are found by no pair before."""
    monkeypatch.setattr(near, "SMALL", 1)
    monkeypatch.setattr(near, "BLOCK", 5)
    monkeypatch.setattr(near, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(near, "BITMAP_BLOCK_TOKENS", 90)
    rows = corpus(6, 160, words=80, hot=4)
    assert sorted(map(tuple, near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())) == brute(rows)
