import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

trie = pytest.importorskip("quillflow.llm.trie")
from quillflow.llm import queries  # noqa: E402

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(turns):
    """The turns (role, text) of every conversation by the stated rules."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            by_conv[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(rows)] for c, rows in by_conv.items()}
    out = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - (abs(c) % 5) * (1 if c > 0 else -1), [])[:h] + rows[h:]
    return out


def brute(conversations):
    """All node rows from a plain list of all prefixes."""
    members = defaultdict(list)
    for c, rows in conversations.items():
        for d in range(len(rows) + 1):
            members[tuple(rows[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, found in members.items():
        gain = (len(found) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += gain
    rows = []
    for node, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(conversations[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        rows.append((min(found), len(node), up, len(found), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def conversations(seed, n, hot=0.0, deep=1):
    """Turns of n conversations that share beginnings; a part of them has one first turn or is one conversation."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < hot:
            texts = ["hot"] * (1 if rng.random() < 0.5 else 3)
        else:
            texts = ["hot"] * (rng.random() < hot) + [rng.choice(["a", "ä", "bb", "", None]) for _ in range(rng.randint(0, 7) * deep)]
        rows += [(c, k, ("user", "assistant")[k % 2] if rng.random() < 0.97 else None, t) for k, t in enumerate(texts)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "hot", "deep", "batch"), [(1, 0.0, 1, 10_000), (2, 0.5, 1, 7), (3, 0.2, 9, 3), (4, 0.9, 1, 5)])
def test_trie_same_as_brute_force(spark, seed, hot, deep, batch):
    """Small batches and files of few rows, so that nodes meet over the edges of batches, files and partitions."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.enabled")}
    try:
        for key, value in zip(before, (str(batch), "3000", "false"), strict=True):
            spark.conf.set(key, value)
        turns = conversations(seed, 300, hot, deep)
        df = spark.createDataFrame(turns, SCHEMA)
        assert found(trie.prefix_trie(queries.rebuilt_paths(df))) == brute(rebuilt(turns))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def test_query_same_as_brute_force_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    rows = found(queries.op12_conversation_trie(spark, folder))
    turns = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    assert rows == brute(rebuilt(turns))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    answer = con.execute(queries.OP12_SQL)
    at = [[d[0] for d in answer.description].index(c) for c in COLUMNS]
    assert sorted((tuple(r[k] for k in at) for r in answer.fetchall()), key=str) == rows


def test_edge_cases(spark):
    turns = [
        (None, 0, "user", "x"), (1, None, "user", "n"), (1, 0, "user", "y"), (2, 0, None, None), (2, 0, "user", "tie"), (2, 0, "user", "tie"), (2, 0, "user", "eit"), (3, 0, "user", "long " * 100_000),
        (3, 1, "user", ""), (-7, 0, "user", "y"), (5, 0, "user", "y"), (6, 9, "user", "y"), (7, 0, "", ""), (8, 0, None, None),
    ]
    turns += [(11, k, "user", "same") for k in range(300)] + [(12, k, "user", "same") for k in range(200)]
    df = spark.createDataFrame(turns, SCHEMA).selectExpr("*", "1 as depth", "'x' as path", "2 as up", "3 as sizes")
    assert found(trie.prefix_trie(queries.rebuilt_paths(df))) == brute(rebuilt(turns))
    assert trie.prefix_trie(queries.rebuilt_paths(df.limit(0))).count() == 0


def test_two_fattest():
    for low in range(0, 40):
        for high in range(low + 1, 60):
            best = max(range(low + 1, high + 1), key=lambda x: (x & -x, x))
            assert trie.fattest(low, high) & -trie.fattest(low, high) == best & -best


def test_locate_finds_the_exit_node():
    rng = random.Random(5)
    paths = sorted({bytes(b for s in (rng.choice("ab") for _ in range(rng.randint(0, 60))) for b in s.encode() * trie.WIDTH) for _ in range(300)})
    grown = trie.ZFastTrie([b""], -1)
    chains = [trie.chain_of(p, [b""]) for p in paths]
    for chain in chains:
        grown.insert(chain, [1] * (len(chain) - 1))
    for chain in chains + [trie.chain_of(p[: -trie.WIDTH] + b"c" * trie.WIDTH, [b""]) for p in paths if p]:
        node = grown.root
        while (below := node.children.get(chain[node.depth + 1]) if len(chain) > node.depth + 1 else None) and trie.shared(chain, below.chain, node.depth, min(len(chain) - 1, below.depth)) == below.depth:
            node = below
        exit_node = (node.children.get(chain[node.depth + 1]) if len(chain) > node.depth + 1 else None) or node
        assert grown.locate(chain) in (exit_node, exit_node.parent)
