"""Small tests and brute-force comparisons of the text operators."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

exact = pytest.importorskip("quillflow.llm.exact")
from quillflow.llm import classifier, encode, license, mixing, near, packing, pii, quality, queries, tokenfiles, toxicity, weak  # noqa: E402

SMALL = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, source string"


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "'x' as n_words", "1 as score", "true as kept", "'y' as digest", "0 as piece", "1 as size") if extra else df


EDGE = [
    (1, None, "a"), (2, "", "b"), (3, "x", None), (4, " \n\t ", "a"), (5, "Ab c", "a"), (6, "aB C", "a"), (6, "aB C", "a"), (None, "ab c", "b"),
    (7, "word " * 30000, "a"), (8, "1" * 40000 + "@" + "a." * 3000, "c"), (9, "é 　x \U0001f642 \0 y", "b"),
]


def test_edge_rows_do_not_crash(spark):
    df = docs(spark, EDGE)
    empty = df.limit(0)
    labels = spark.createDataFrame([(5, 1, 1), (None, 1, None), (7, None, 0)], "doc_id long, quality int, toxic int")
    jobs = [
        lambda d: pii.pii_spans(d), lambda d: pii.redact(d), lambda d: exact.dedup_exact(d), lambda d: quality.quality_scores(d, labels), lambda d: toxicity.toxicity_scores(d, labels),
        lambda d: classifier.quality_classes(d), lambda d: license.license_matches(d), lambda d: mixing.mix_sources(d),
        lambda d: tokenfiles.read_shards(*tokenfiles.write_shards(d, queries.tokenizer("byte_bpe_50k.json"))),
    ]
    for job in jobs:
        assert job(df).count() == len(EDGE)
        assert job(empty).count() == 0
    pieces = packing.pack_documents(df, queries.tokenizer("word_bpe_49k.json"))
    assert pieces.where("piece = 0").count() == len(EDGE)
    assert packing.pack_documents(empty, queries.tokenizer("word_bpe_49k.json")).count() == 0
    assert set(quality.quality_filter(df, labels).columns) == set(df.columns)
    assert mixing.repeat_documents(df).columns == df.columns


def test_own_names_do_not_clash(spark):
    """Columns named as the operators' own ones stay as they are, an empty table gives no rows, the least id is an id."""
    clash = "*", "'i' as _id", "'t' as _times", "'d' as _digest", "'n' as _NODE", "'k' as _key1", "'r' as _rows", "'s' as _sum", "'m' as _nth", "'o' as _doc", "'c' as _code", "1 as taken"
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text, "a"), (2, text.upper(), "a"), (-(2**63), text + " more", "b"), (4, "other words " * 3, "b"), (None, "no id at all", "b")]
    df = docs(spark, rows).selectExpr(*clash)
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    for stage in (exact.drop_duplicates, near.drop_near_duplicates, mixing.repeat_documents, lambda d: quality.quality_filter(d, labels)):
        found = stage(df)
        assert found.columns == df.columns
        assert all(r["_id"] == "i" and r["_times"] == "t" and r["_digest"] == "d" and r["_NODE"] == "n" and r["_doc"] == "o" for r in found.collect())
        assert stage(df.limit(0)).count() == 0
    assert {r.doc_id for r in exact.drop_duplicates(df).collect()} == {2, -(2**63), 4, None}
    assert {r.doc_id for r in near.drop_near_duplicates(df).collect()} == {-(2**63), 4, None}
    assert {(r.doc_id, r.keep_id) for r in exact.dedup_exact(df).collect()} == {(1, 2), (2, 2), (-(2**63), -(2**63)), (4, 4), (None, None)}
    found = tokenfiles.read_shards(*tokenfiles.write_shards(df, queries.tokenizer("byte_bpe_50k.json"))).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, -(2**63), 1, 2, 4]


# Personal data


def base_spans(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_same_as_patterns():
    rng = random.Random(3)
    bits = ["a", "@", ".", "-", "1", "255", "256", " ", "+1", "(", "4111 1111 1111 1111", "x@y.z", "@@", "10.0.0.1", "é", "_", "%", "+49 30 1234567", "00012"]
    for _ in range(20000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 14)))
        assert [x[:3] for x in pii.find_spans(text) if x[0] in pii.BASE] == base_spans(text), text


def test_added_kinds_recall_and_precision():
    """Planted values of each added kind are found where they stand; near misses are not."""
    rng = random.Random(9)
    found = Counter()
    for _ in range(200):
        body = "".join(rng.choices("0123456789", k=18))
        check = 98 - int(body + "131400") % 97  # DE as 13 14
        number, key = "".join(rng.choices("0123456789", k=9)), "".join(rng.choices("0123456789abcdef", k=40))
        for kind, text, value in (
            ("iban", f"pay to DE{check:02d}{body} now", f"DE{check:02d}{body}"), ("id_number", f"her passport {number}, valid", number), ("secret", f'set TOKEN = "{key}";', key), ("secret", f"api_key: {key}", key),
        ):
            spans = pii.find_spans(f"some words {text}")
            found[kind] += any(k == kind and f"some words {text}"[s:e] == value for k, s, e, _ in spans)
        for text in (f"pay to DE{(check + 1) % 97:02d}{body} now", f"page {number} of it", 'token = "aaaaaaaaaaaaaaaa1111"', 'token = "ab1"', f"tokens {key}"):
            found["wrong"] += sum(k in ("iban", "id_number", "secret") for k, *_ in pii.find_spans(text))
    assert found["iban"] == 200 and found["id_number"] == 200 and found["secret"] == 400 and found["wrong"] == 0


def test_added_spans():
    assert pii.find_spans("IBAN GB82 WEST 1234 5698 7654 32.")[0][:3] == ("iban", 5, 32)
    assert not [x for x in pii.find_spans("IBAN GB82 WEST 1234 5698 7654 33.") if x[0] == "iban"]
    assert [x[0] for x in pii.find_spans("passport 123456789")] == ["id_number"]
    assert pii.find_spans("order 123456789") == []


# Exact dedup


def test_cuckoo_insert_delete_resize():
    rng = random.Random(1)
    index, live = exact.CuckooIndex(4), Counter()
    for k in range(20000):
        digest = hashlib.sha256(str(rng.randrange(4000)).encode()).digest()
        if rng.random() < 0.4 and live[digest]:
            assert index.remove(digest)
            live[digest] -= 1
        else:
            index.add(digest, k)
            live[digest] += 1
    assert index.resizes > 3
    assert {r[0]: r[2] for r in index.live()} == {d: n for d, n in live.items() if n}
    assert not index.remove(b"\0" * 32)


def test_index_in_small_pieces_and_its_update(spark):
    """Map-side indexes that are sent and emptied every few records, and an update that leaves untouched shards alone."""
    rng = random.Random(8)
    rows = [(k, f"text {rng.randrange(300)}", "s") for k in range(2_000)]
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[text].append(doc_id)
    keys = exact.keyed(docs(spark, rows))
    index = exact.build_index(keys, 10)
    assert sorted((r.keep_id, r.group_size) for r in index.collect()) == sorted((max(v), len(v)) for v in groups.values())
    assert index.first().shards == 200
    index = exact.written(index, "index")
    before = {bytes(r.digest): r.shard for r in index.collect()}
    updated, members = exact.update_index(index, keys, docs(spark, [(5_000, "text 7", "s"), (5_001, "unseen", "s")]), spark.createDataFrame([(groups["text 9"][0],)], "doc_id long"))
    groups["text 7"].append(5_000)
    groups["unseen"].append(5_001)
    del groups["text 9"][0]
    assert sorted((r.keep_id, r.group_size) for r in updated.collect()) == sorted((max(v), len(v)) for v in groups.values() if v)
    assert members.count() == 2_001 and all(before.get(bytes(r.digest), r.shard) == r.shard for r in updated.collect())
    plan = updated._jdf.queryExecution().optimizedPlan().toString()
    untouched = plan.split("Union", 1)[1].split(":  ")[0]
    assert "Repartition" not in untouched.split("LeftAnti")[0]


def test_identity_numbers_in_linear_time():
    """Many numbers beside many other spans; against the plain rule on a small text."""
    text = " ".join(f"id 12345{k % 90 + 10} a{k}@b.cc +49 30 {k % 900000 + 100000} 5{k % 90 + 10}1111" for k in range(40))
    plain = [x for x in pii._proposed(text)]
    others = [x for x in plain if x[0] != "id_number"]
    wanted = [x for x in plain if x[0] == "id_number" and not any(y[1] < x[2] and x[1] < y[2] for y in others)]
    kept = [x for x in pii._apart([(*x, 1.0) for x in plain]) if x[0] == "id_number"]
    assert [x[:3] for x in kept] == wanted and 0 < len(wanted) < sum(x[0] == "id_number" for x in plain)
    long = "passport no 1234567 " * 500_000  # 10 MB
    begun = time.perf_counter()
    assert sum(x[0] == "id_number" for x in pii.find_spans(long)) == 500_000
    assert time.perf_counter() - begun < 60


def test_licenses_in_megabytes_of_text():
    """A megabyte of one license and one of phrases of many, in a tenth of the time that ten may take."""
    index = license.Index(license.TEMPLATES)
    rng = random.Random(6)
    words = [w for t in license.TEMPLATES.values() for w in t.split()]
    phrases = [" ".join(words[k : k + 5]) for k in range(0, len(words) - 5, 3)]
    mit = license.TEMPLATES["MIT"]
    for text, least in ((f"{mit}\n" * (1_000_000 // len(mit)), 900), (" ".join(rng.choices(phrases, k=30_000)), 0), ("permission is hereby granted free of charge " * 23_000, 0)):
        tokens = license.token_hashes(pa.array(text.split()))
        hashes = license.gram_hashes(tokens)
        begun = time.perf_counter()
        found = license.find(index, tokens, index.hits(hashes), hashes, np.zeros(len(tokens), np.int64), np.array([0, len(tokens)]))
        assert time.perf_counter() - begun < 12
        assert sum(m[0] == "MIT" and m[3] == 1 for m in found.get(0, [])) >= least


def test_dedup_and_update(spark):
    rows = [(1, "A b", "s"), (2, "a B", "s"), (3, "É", "s"), (4, "é", "s"), (5, None, "s"), (6, "", "s"), (7, "a b", "s")]
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.dedup_exact(docs(spark, rows)).collect()}
    assert found == {1: (7, 3, False), 2: (7, 3, False), 7: (7, 3, True), 3: (3, 1, True), 4: (4, 1, True), 5: (6, 2, False), 6: (6, 2, True)}
    assert sorted(r.doc_id for r in exact.drop_duplicates(docs(spark, rows)).collect()) == [3, 4, 6, 7]
    keys = exact.keyed(docs(spark, rows))
    index, members = exact.update_index(exact.build_index(keys), keys, docs(spark, [(9, "é", "s"), (10, "new", "s")]), spark.createDataFrame([(7,), (3,)], "doc_id long"))
    assert members.count() == 7
    assert sorted((r.keep_id, r.group_size) for r in index.collect()) == [(2, 2), (6, 2), (9, 2), (10, 1)]


def test_one_id_on_two_texts(spark):
    rows = [(7, "A", "s"), (7, "B", "s"), (9, "a", "s"), (9, "a", "s"), (None, "b", "s"), (None, "c", "s"), (None, "C", "s")]
    kept = sorted(((r.doc_id, r.text.lower()) for r in exact.drop_duplicates(docs(spark, rows)).collect()), key=str)
    assert kept == [(7, "b"), (9, "a"), (None, "c")]


# Quality


def test_base_counts_and_scores(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "É", "c#", "|", "d\n", "\n", "d\n"], k=rng.randint(0, 60))) for _ in range(300)]
    got = quality.base_counts(pa.array(texts))
    for k, text in enumerate(texts):
        words = re.findall(WORD, text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        marked = [False] * len(words)
        for i in range(len(words) - 2):
            if windows[tuple(words[i : i + 3])] > 1:
                marked[i : i + 3] = [True] * 3
        lines = [x for x in text.split("\n") if re.search(WORD, x)]
        wanted = (len(words), sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), sum(marked))
        assert wanted == tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_llr_same_as_brute_force(spark):
    df = queries.table(spark, SMALL, "documents")
    labels = queries.table(spark, SMALL, "labels")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}

    def grams(data):
        return Counter((int.from_bytes(data[i : i + 4], "little") * 2654435761 % 2**32) >> 16 for i in range(len(data) - 3))

    raw, target = Counter(), Counter()
    for d, t in texts.items():
        raw.update(grams(t))
        if d in good:
            target.update(grams(t))
    n, m, half = sum(raw.values()), sum(target.values()), 0.5 * 65536
    for r in quality.quality_scores(df, labels).collect():
        g = grams(texts[r.doc_id])
        total = sum(k * (np.log((target[b] + 0.5) / (m + half)) - np.log((raw[b] + 0.5) / (n + half))) for b, k in g.items())
        assert abs(r.llr - total / max(1, sum(g.values()))) < 1e-4
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


def test_grams_of_all_target_texts(spark):
    docs = spark.range(20_300).select(F.col("id").alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert not quality.gram_weights(docs, labels).any()  # all texts are targets, so both models are one
    some = labels.where("doc_id % 3 = 0")
    small = quality.gram_weights(docs, some)
    assert small.any() and (small == quality.gram_weights(docs, some, broadcast_ids=10)).all()


# Tokens


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_same_as_library(name, spaces):
    encoder = encode.Encoder(queries.tokenizer(name), spaces)
    rng = random.Random(7)
    bits = ["a", "B", "é", "Σ", " ", "  ", "\n", "\t", "'s", "12", "<|endoftext|>", "<|startoftext|>", "́", "\x85", "　", "\0", "\x01", "word", " the", "\r\n", "İ", ".", ",", "!?", "A", "K"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(8000)]
    for k in range(0, len(texts), 800):
        ids, ends = encoder.encode(pa.array(texts[k : k + 800], pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [x.tolist() for x in encoder.whole(texts[k : k + 800])]


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(encode, "CACHE", 50)
    encoder = encode.Encoder(queries.tokenizer("byte_bpe_50k.json"), True)
    for k in range(20):
        texts = [f"number {j} of {k}, again {j}." for j in range(40)] + ["", "a  b"]
        ids, ends = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [x.tolist() for x in encoder.whole(texts)]
        assert len(encoder.known) <= 200


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000, 20000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        shard = tokenfiles.Shard(tokenfiles.shard_bytes(keys, 0, np.ones(len(keys), np.int64), np.arange(len(keys), dtype=np.uint32) % 60000))
        assert len(shard.prints) == len(keys)
        assert (shard.find(keys) == np.arange(len(keys))).all()
        assert (shard.find(keys + 2**62 + 1) == -1).all() or not np.isin(keys + 2**62 + 1, keys).any()
        assert shard.get(int(keys[-1]))[0] == (len(keys) - 1) % 60000


def test_token_files_round_trip(spark):
    df = queries.table(spark, SMALL, "documents")
    path = queries.tokenizer("byte_bpe_50k.json")
    library = encode.Encoder(path, True)
    start, wanted = 0, {}
    for r in df.orderBy("doc_id").collect():
        data = library.whole([r.text or ""])[0].tobytes() + b"\0" * 4
        wanted[r.doc_id] = (start, len(data) // 4, zlib.crc32(data))
        start += len(data) // 4
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    folder, manifest = tokenfiles.write_shards(df, path, shard_ids=20_000)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert manifest.count() > 3
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_shards(folder, manifest).collect()}
    assert found == wanted
    asked = tokenfiles.lookup(folder, manifest, spark.createDataFrame([(3,), (77,), (10**9,)], "doc_id long")).collect()
    assert {r.doc_id: len(r.ids) for r in asked} == {k: wanted[k][1] for k in (3, 77)}


def test_packing(spark):
    df = queries.table(spark, SMALL, "documents")
    path = queries.tokenizer("word_bpe_49k.json")
    library = encode.Encoder(path, False)
    texts = {r.doc_id: library.whole([r.text or ""])[0].tobytes() + np.uint32(1).tobytes() for r in df.collect()}
    rows = packing.pack_documents(df, path).collect()
    sequences = defaultdict(list)
    seen = Counter()
    for r in rows:
        part = texts[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert r.start == 4096 * r.piece and len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32
        seen[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert seen == {d: len(t) // 4 for d, t in texts.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    least = -(-sum(seen.values()) // packing.CAPACITY)
    assert len(sequences) <= 1.05 * least + 1


def test_best_fit_takes_the_tightest():
    packer = packing.BestFit(10, 2)
    assert [packer.place(n) for n in (6, 5, 4, 5, 3, 2, 9)] == [(0, 0), (1, 0), (0, 6), (1, 5), (2, 0), (2, 3), (3, 0)]
    assert packer.place(8) == (4, 0)  # both bins are open and neither fits: the fullest closed
    assert packer.left_open() == {2: 5, 4: 8}


# Mixing


def test_sainte_lague_same_as_highest_quotients():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 8)
        weights = [rng.choice([0, rng.random() * 100, rng.randint(1, 5)]) for _ in range(n)]
        caps = [rng.randint(0, 40) for _ in range(n)]
        seats = rng.randint(0, 80)
        given = [0] * n
        for _ in range(min(seats, sum(c for c, w in zip(caps, weights, strict=True) if w))):
            k = min((k for k in range(n) if given[k] < caps[k] and weights[k]), key=lambda k: (-weights[k] / (2 * given[k] + 1), k))
            given[k] += 1
        assert mixing.sainte_lague(np.array(weights, float), seats, np.array(caps)).tolist() == given


def test_mixing(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randint(0, 300)), rng.choice(["a", "a", "a", "a", "b", "c", None, "tiny"])) for k in range(600)]
    rows = [(d, t, "tiny" if d == 7 else ("a" if s == "tiny" else s)) for d, t, s in rows]
    mix = mixing.mix_sources(docs(spark, rows)).collect()
    again = mixing.mix_sources(docs(spark, rows).repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in mix) == sorted((r.doc_id, r.taken) for r in again)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, left, free = {}, sum(sizes.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]
        free -= over
    target |= share
    taken = Counter()
    for r in mix:
        assert r.taken <= 3 * r.size and abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS


@pytest.mark.parametrize("doc_id", [lambda k: None, lambda k: k // 50])
def test_rows_without_own_id_are_repeated_by_their_own_counts(spark, doc_id):
    rng = random.Random(8)
    rows = [(doc_id(k), " ".join(f"w{k}-{j}" for j in range(rng.randint(1, 9))), "abc"[k % 3]) for k in range(900)]
    rows += [(doc_id(900), "the same text", "b")] * 30
    df = docs(spark, rows)
    target = {r.source: r.target for r in mixing.mix_sources(df).select("source", "target").distinct().collect()}
    words, times = Counter(), Counter()
    for r in mixing.repeat_documents(df).collect():
        words[r.source] += len(r.text.split())
        times[r.doc_id, r.text] += 1
    assert all(abs(words[s] - target[s]) < 0.08 * target[s] for s in "abc")
    assert times.pop((doc_id(900), "the same text")) <= 3 * 30 and max(times.values()) <= 3


# Weak supervision


def drawn_votes(n, seed):
    """Truth and votes of six voters: each of three kinds of a rare class is seen by two of them; one also errs."""
    rng = np.random.default_rng(seed)
    kind = np.where(rng.random(n) < 0.2, rng.integers(0, 3, n), 3)
    votes = np.full((n, 6), weak.ABSTAIN)
    for j in range(6):
        on = np.where(kind == j // 2, rng.random(n) < 0.9, rng.random(n) < (0.05 if j == 5 else 0.002))
        votes[on, j] = weak.YES
    return kind < 3, votes


def test_label_model_posterior_same_as_brute_force():
    truth, votes = drawn_votes(4000, 3)
    rows, count = np.unique(votes, axis=0, return_counts=True)
    model = weak.fit(rows, count, np.where((rows == weak.YES).any(axis=1), 0.5, 0.05))
    assert np.allclose(model.rates.sum(axis=2), 1) and np.isclose(model.prior.sum(), 1)
    for row, found in zip(rows, model.posterior(rows), strict=True):
        p = [prior * np.prod([model.rates[k, j, v] for j, v in enumerate(row)]) for k, prior in enumerate(model.prior)]
        assert np.isclose(found, sum(x for x, y in zip(p, model.yes, strict=True) if y) / sum(p))


@pytest.mark.parametrize("share_known", [0.0, 0.3])
def test_label_model_finds_classes_and_correlations(share_known):
    truth, votes = drawn_votes(30000, 4)
    known = np.where(np.random.default_rng(5).random(len(truth)) < share_known, truth, -1)
    rows, back, count = np.unique(np.column_stack((votes, known)), axis=0, return_inverse=True, return_counts=True)
    model = weak.fit(rows[:, :6], count, np.where((rows[:, :6] == weak.YES).any(axis=1), 0.4, 0.02), rows[:, 6])
    assert ((model.posterior(votes) >= 0.5) == truth).mean() > 0.95
    right = [truth[votes[:, j] == weak.YES].mean() for j in range(6)]
    assert np.abs(model.accuracies() - right).max() < 0.08
    same, other = model.correlations(True)[0, 1], model.correlations(True)[0, 2]
    assert same > 0.5 > 0 > other


def test_logistic_same_for_dense_and_sparse():
    rng = np.random.default_rng(6)
    x = rng.random((300, 5)) * (rng.random((300, 5)) < 0.5)
    y = 1 / (1 + np.exp(-(x @ np.array([3.0, -2, 0, 1, 0]) - 0.5)))
    at = np.nonzero(x)
    sparse = weak.logistic(weak.Entries(300, 5, *at, x[at]), y, np.ones(300), penalty=1e-7, rounds=3000)
    dense = weak.logistic(x.view(weak.Dense), y, np.ones(300), penalty=1e-7, rounds=3000)
    assert np.allclose(sparse, dense, atol=1e-6) and np.allclose(sparse, [3, -2, 0, 1, 0, -0.5], atol=0.05)


def test_counted_features_same_as_brute_force():
    texts = ["Loud scum, SCUM! scums", "", "xx", "a b a", "réeuxpa réeuxté"]
    found = defaultdict(int)
    for k, f, times in zip(*toxicity.counted(pa.array(texts)), strict=True):
        found[k, f] = times
    wanted = Counter()
    for k, text in enumerate(texts):
        words = {w.strip(toxicity.MARKS).lower() for w in text.split()}
        for word in words:
            owner, number = toxicity.word_features(pa.array([word]))
            wanted.update({(k, f) for f in number.tolist()})
    assert found == wanted
    whole = Counter(toxicity.word_features(pa.array(["scum", "scums", "loud"]))[0].tolist())
    # a word of n bytes gives itself and, with the byte before it, n + 2 - size n-grams of each size
    assert whole == {0: 1 + 2, 1: 1 + 3 + 1, 2: 1 + 2}


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    df, labels = queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")
    scores = toxicity.toxicity_scores(df, labels)
    assert scores.count() == df.count()
    for r in scores.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = scores.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9


def test_toxicity_held_out_by_language(spark):
    folder = "/root/testdata/sf0.1"
    df, labels = queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")
    rows = toxicity.toxicity_scores(df.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).where("held_out")
    rows = rows.join(labels, "doc_id").join(df.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("en", "de", "fr", "es", None):
        mine = [r for r in rows if lang in (r.lang, None)]
        caught = [r.predicted for r in mine if r.toxic == 1]
        left = [r.predicted == 0 for r in mine if r.toxic == 0]
        assert sum(caught) / len(caught) >= (0.8 if lang else 0.9) and sum(left) / len(left) >= (0.93 if lang else 0.97), (lang, len(caught), sum(caught), sum(left) / len(left))


def plain_ratios(text):
    """The ratios of a text by plain loops."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {i for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for i in (k, k + 1, k + 2)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    data = text.encode()
    upper, lower = (sum(a <= c <= b for c in data) for a, b in ((65, 90), (97, 122)))
    n = max(1, len(words))
    return [
        sum(text.count(c) for c in "#*$%&|<>") / n, upper / max(1, upper + lower), len(repeated) / n, twice / (text.count("\n") + 1), text.count("|") / n, text.count("!") / n,
        sum(map(len, words)) / n, text.count(".") / n, len(words), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, (upper + lower + sum(c >= 128 for c in data)) / max(1, sum(c > 32 for c in data)),
    ]


def plain_votes(r):
    """1 for good, -1 for bad, 0 for none, of each labeller."""
    symbols, capitals, repeats, lines, bars, shouts, length, stops, words, echoes, letters = r
    enough = words >= classifier.SHORT
    if not length:
        return [0] * len(classifier.LABELLERS)
    rules = [
        (symbols > 0.5, symbols < 0.05), (capitals > 0.5, capitals < 0.25), (repeats > 0.5 and enough, repeats < 0.2), (lines > 0.5 and enough, lines < 0.2), (bars > 0.3, bars < 0.02), (shouts > 0.5, shouts < 0.05),
        (length > 12 and enough, 2 < length < 9), (stops > 0.6 and enough, 0.01 < stops < 0.5), (echoes > 0.3 and enough, echoes < 0.05), (letters < 0.72, letters > 0.85),
    ]
    return [-1 if bad else 1 if good else 0 for bad, good in rules]


def test_classifier_same_as_plain_loops(spark):
    """Ratios, votes, and the score that trained weights give."""
    rng = random.Random(9)
    parts = ["word", "Word", "LOUD", "|", "a|b", "!", "ä", "end.", "\n", "same line\n", "longlonglongword", "#", "x"]
    made = [" ".join(rng.choices(parts[: rng.randint(1, len(parts))], k=rng.randint(0, 120))) for _ in range(200)] + ["", " ", "a", "abc", "é" * 3]
    found = classifier.ratios(pa.array(made))
    assert np.allclose(found, [plain_ratios(t) for t in made])
    sign = {classifier.weak.YES: 1, classifier.weak.NO: -1, classifier.weak.ABSTAIN: 0}
    votes = classifier.votes_of(found, found[:, 6] > 0)
    assert [[sign[v] for v in row] for row in votes.tolist()] == [plain_votes(plain_ratios(t)) for t in made]
    table = docs(spark, [(k, t, "s") for k, t in enumerate(made)])
    model = classifier.fit_labels(table)
    weights = classifier.train(table, model)
    scores = {r.doc_id: (r.score, r.posterior, r.kept) for r in classifier.quality_classes(table).collect()}
    for k, text in enumerate(made):
        data = text.encode()
        grams = [int(quality.gram_buckets(np.frombuffer(data[i : i + 4], np.uint8), classifier.BITS)[0]) for i in range(len(data) - 3)]
        logit = weights[-1] + classifier.SCALE * sum(weights[g] for g in grams) / max(classifier.LEAST, len(grams))
        assert abs(scores[k][0] - 1 / (1 + np.exp(-np.clip(logit, -50, 50)))) < 1e-6 and scores[k][2] == (scores[k][0] >= classifier.KEEP_SCORE)
    assert np.allclose([scores[k][1] for k in range(len(made))], model.posterior(votes))


def test_classifier_keeps_clean(spark):
    folder = "/root/testdata/sf0.01"
    labels = queries.table(spark, folder, "labels")
    rows = classifier.quality_classes(queries.table(spark, folder, "documents")).join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.97 and sum(r.kept for r in bad) / len(bad) < 0.1


# Licenses


def test_license_matches(spark):
    apache, mit = license.TEMPLATES["Apache-2.0 statement"], license.TEMPLATES["MIT"]
    changed = mit.replace("free of charge,", "at no cost,").replace("sublicense,", "")
    rows = [(1, f"some words {apache} more words", "a"), (2, f"{apache}\n{apache}", "a"), (3, "x " * 50 + changed, "a"), (4, "Licensed apples under a tree", "a"), (5, "", "a")]
    found = {r.doc_id: [(m.template, m.start, m.end, m.coverage) for m in r.matches] for r in license.license_matches(docs(spark, rows)).collect()}
    assert found[1] == [("Apache-2.0 statement", 11, 11 + len(apache), 1.0)]
    assert len(found[2]) == 2 and found[4] == [] and found[5] == []
    assert found[3][0][0] == "MIT" and 0.9 < found[3][0][3] < 1 and found[3][0][1] == 100


def test_winnowing_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(200):
        tokens = rng.integers(0, 2**63, 30).astype(np.uint64)
        hashes = license.gram_hashes(tokens)
        chosen = set(license.winnow(hashes))
        low = int(rng.integers(0, 30 - (license.GRAM + license.WINDOW - 1)))
        assert any(p in chosen for p in range(low, low + license.WINDOW))


def alignment(template, text):
    """Matched template tokens of the best unbanded local alignment (match 1, else -1), by full dynamic programming."""
    best, above = (0, 0), [(0, 0)] * (len(text) + 1)
    for a in template:
        row = [(0, 0)]
        for j, b in enumerate(text):
            score, matched = above[j]
            if score == 0:
                matched = 0
            cell = max((score + (1 if a == b else -1), matched + (a == b)), (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1]), key=lambda c: c[0])
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[-1], key=lambda c: c[0])
        above = row
    return best[1]


def test_license_coverage_same_as_brute_force(spark):
    """One license a text, whole, changed or cut, against whole unbanded alignments with every template."""
    rng = random.Random(12)
    rows, names = [], [n for n, t in license.TEMPLATES.items() if len(t.split()) > license.SHORT]
    for k, name in enumerate(names * 2):
        words = license.TEMPLATES[name].split()
        words = words[: rng.randint(license.PART + 10, len(words))] if k % 3 == 2 and len(words) > 60 else words
        words = [rng.choice(["changed", w, w, w]) if k % 2 and rng.random() < 0.1 else w for w in words]
        rows.append((k, " ".join(["before"] * rng.randint(0, 9) + words + ["after"] * rng.randint(0, 9)), "a"))
    rows.append((10**6, "permission granted software for any person with words of its own", "a"))
    found = {r.doc_id: r.matches for r in license.license_matches(docs(spark, rows)).collect()}
    assert found.pop(10**6) == []
    strip = lambda words: ["".join(c for c in w.lower() if c.isalnum()) for w in words]
    templates = {n: strip(license.TEMPLATES[n].split()) for n in names}
    for k, text, _ in rows[:-1]:
        matched = {n: alignment(t, strip(text.split())) for n, t in templates.items()}
        most = max(matched.values())
        got = max(found[k], key=lambda m: m.coverage * len(license.TEMPLATES[m.template].split()))
        assert abs(got.coverage * len(templates[got.template]) - most) <= 1, (names[k % len(names)], got, most)
        assert matched[got.template] >= most - 1 and "before" not in text[got.start : got.end] and "after" not in text[got.start : got.end]


def test_licenses_in_long_texts(spark):
    """Many licenses in one text: all are found, in time that follows the text's length."""
    line = license.TEMPLATES["MIT statement"]
    text = "\n".join([line] * 20_000 + [license.TEMPLATES["ISC"]] * 20)
    found = license.license_matches(docs(spark, [(1, text, "a")])).first().matches
    assert Counter(m.template for m in found) == {"MIT statement": 20_000, "ISC": 20}
    assert all(m.coverage == 1 for m in found)


def test_partial_license_has_its_coverage(spark):
    words = license.TEMPLATES["MIT"].split()
    found = license.license_matches(docs(spark, [(1, " ".join(words[:60]), "a"), (2, "All rights reserved.", "a")])).collect()
    assert [(m.template, round(m.coverage, 2)) for m in found[0].matches] == [("MIT", round(60 / len(words), 2))]
    assert [(m.template, m.coverage) for m in found[1].matches] == [("All rights reserved", 1.0)]
