"""The registered queries of the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import classifier, exact, license, minhash, mixing, near, packing, pii, quality, runs, tokenfiles, toxicity, trie
from quillflow.llm.common import WORD, arrow_batches, texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""

    def digest(batches):
        for batch in batches:
            ids, found = batch.column(0), batch.column(1).to_pylist()
            spans = [[(x["kind"], x["start"], x["end"], x["score"]) for x in row] for row in found]
            counts = {f"n_{k}": pa.array([sum(x[0] == k for x in row) for row in spans], pa.int64()) for k in pii.BASE}
            hashes = {"base_sha256": pa.array(map(pii.base_digest, spans), pa.string())}
            every = {"spans": pa.array(map(pii.spans_text, spans), pa.string()), "n_spans": pa.array(map(len, spans), pa.int64())}
            yield pa.RecordBatch.from_pydict({"doc_id": ids} | counts | hashes | every)

    out = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return pii.pii_spans(table(spark, sf_dir, "documents")).mapInArrow(digest, out)


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from the shard files."""
    return tokenfiles.read_shards(*tokenfiles.write_shards(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and taken words of every document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License matches of every document: names, and template:start:end:coverage of each."""
    found = license.license_matches(table(spark, sf_dir, "documents"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["start"], m["end"], F.format_number(m["coverage"], 4)))
    names = F.array_join(F.array_sort(F.array_distinct("matches.template")), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), F.array_join(spans, ",").alias("spans"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    found = exact.dedup_exact(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP5_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, score and verdict of every document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return near.near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g
  FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT reach.a, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    return classifier.quality_classes(table(spark, sf_dir, "documents"))


def _periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text of all documents; those whose id's crc32 is a multiple of 10 go on periodically from a word on."""
    word = re.compile(WORD)

    def rewrite(batches):
        for batch in batches:
            ids, out = batch.column("doc_id").cast(pa.int64()), texts(batch).to_pylist()
            for k, doc_id in enumerate(ids.to_pylist()):
                h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
                if h % 10 or not (words := word.findall(out[k])):
                    continue
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                out[k] = " ".join(words[:a] + (words[a : a + p] * (n // p + 1))[: n - a])
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], names=["doc_id", "text"])

    arrow_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(rewrite, "doc_id long, text string")


def run_digests(docs: DataFrame) -> DataFrame:
    """Number of runs, the run of greatest exponent and digests of all runs and of the collapsed text of every document.

    A null id is taken as one whose text stays as it is.
    """
    found = runs.periodic_runs(_periodic(docs))
    # Different ratios of numbers whose product is under 2^53 differ as doubles too, and equal ones are equal: texts up to 90 million words.
    top = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("ratio"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("top", top)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document, some of which are made periodic first."""
    return run_digests(table(spark, sf_dir, "documents"))


#: crc32 of the decimal digits of {0}, bit by bit.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}::VARCHAR) + 1), lambda i: ord(({0}::VARCHAR)[i])::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, coalesce({CRC32_SQL.format('doc_id')}, 1) AS h FROM documents),
e AS (SELECT *, len(ws) AS n, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM d),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END + 1]) ELSE ws END AS ws FROM e),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM t),
same AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON y.doc_id = x.doc_id AND y.w = x.w AND y.i > x.i),
long AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long b WHERE b.doc_id = r.doc_id AND b.q < r.q AND r.q % b.q = 0 AND b.s <= r.s AND b.s + b.n >= r.s + r.n)),
top AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := s, n := n, q := q), (-n / q, s, q)) AS f, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN runs r ON r.doc_id = w.doc_id AND w.i >= r.s + r.q AND w.i < r.s + r.n),
kept AS (SELECT w.doc_id, string_agg(w, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY w.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, f.s AS start, f.n AS length, f.q AS period, 1000 * f.n // f.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN top ON top.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id
"""


def rebuilt_paths(turns: DataFrame) -> DataFrame:
    """Each conversation's path: the first turns of the conversation at the last multiple of 5, then its own after as many."""
    paths = trie.conversation_paths(turns).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int"))
    donors = paths.select(F.col("conv_id").alias("donor"), F.col("path").alias("their_path"), F.col("sizes").alias("their_sizes"))
    joined = paths.join(donors, F.col("conv_id") - F.col("conv_id") % 5 == F.col("donor"), "left")
    own = f"substring(path, {trie.WIDTH} * h + 1), slice(sizes, h + 1, greatest(size(sizes) - h, 0))".split(", slice")
    return joined.select(
        "conv_id", F.expr(f"concat(coalesce(substring(their_path, 1, {trie.WIDTH} * h), x''), {own[0]})").alias("path"),
        F.expr(f"concat(coalesce(slice(their_sizes, 1, h), cast(array() as array<long>)), slice{own[1]})").alias("sizes"),
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt to share beginnings."""
    return trie.prefix_trie(rebuilt_paths(table(spark, sf_dir, "conversations")))


OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, {CRC32_SQL.format('conv_id')} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
w AS (
  SELECT conv_id, row_number() OVER o AS depth, octet_length(encode(text)) AS size,
    list(md5(concat(length(role), ':', role, text))) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS path
  FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY i)),
m AS (
  SELECT conv_id, depth, size, path FROM w
  UNION ALL
  SELECT conv_id, 0, 0, [] FROM c),
longest AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY conv_id),
n AS (
  SELECT path, any_value(depth) AS depth, any_value(size) AS size, min(m.conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (depth = last), '')) AS ends_sha256
  FROM m JOIN longest USING (conv_id) GROUP BY path),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS k FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(k, 0) AS n_children FROM n LEFT JOIN kids ON kids.path = n.path),
up AS (SELECT unnest(list_transform(range(0, depth + 1), lambda d: path[:d])) AS path, n_children, (n_convs - 1) * size AS saved FROM f),
sums AS (SELECT path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY path)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN sums ON sums.path = f.path LEFT JOIN f p ON f.depth > 0 AND p.path = f.path[:f.depth - 1]
"""


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP13_SQL = OP9_SQL.replace("75 * (a.n", "85 * (a.n").replace("AS component_id\nFROM w", "AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept\nFROM w")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator."""
    return {
        "op1_pii": op1_pii,
        "op2_packing": op2_packing,
        "op3_license_scan": op3_license_scan,
        "op4_toxicity": op4_toxicity,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_token_files": op6_token_files,
        "op7_quality_rules": op7_quality_rules,
        "op8_mixing": op8_mixing,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_quality_classifier": op10_quality_classifier,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express."""
    return {"op5_exact_dedup": OP5_SQL, "op9_ngram_jaccard": OP9_SQL, "op11_periodic_runs": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_minhash": OP13_SQL}
