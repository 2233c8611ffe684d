"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, ...; they share the corpus's total
size by weight, but none beyond `MOST` times its own size, and the excess is shared again by weight.
Blocks: the total is `total // block` blocks of `block` words; they go to sources, and a source's
blocks to its shards, by highest quotients w / (2 k + 1), so quotas are integers and each source is
within a block or so of its target. Shards are documents dealt by a seeded hash, at most about
`SHARD_WORDS` words and `SHARD_ROWS` rows each. Selection: a shard's documents stand in a seeded random
order as a ring of words; its quota of blocks is taken from a seeded block on, going round as often as
needed. As a quota is at most MOST times the shard, no document is taken more than MOST times.

Scale: shuffles move ids and sizes only. Rows that agree in id, source and size are counted map-side and
stand in the ring as entries of at most `COPIES` rows, dealt apart; rows of size 0 stand in no ring. A
source with a third of all rows has its share of the shards. Apportionment groups hold a row per source,
or per shard of a source.

Defined cases: null, empty and wordless texts have size 0 and are taken 0 times; very long texts are
counted whole; a null source is a source; repeated rows are documents of their own and share what their
entry takes as evenly as whole words allow; ties in the random order go by id and size; an empty table
gives no rows; other columns are ignored by `mix_sources` and kept by `repeat_documents`, whatever their
names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillflow.llm.common import arrow_batches, texts, words_of, written

MOST = 3
WEIGHTS = (1, 2, 3)
BLOCK_WORDS = 8
SHARD_WORDS = 2_000_000
SHARD_ROWS = 200_000
#: A source of enough rows has this many shards at least, and rows a shard below that.
LEAST_SHARDS, LEAST_ROWS = 64, 500
COPIES = 1_000
SEED = 20240607


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients w / (2 k + 1), at most `caps` each; ties go to the earlier entry.

    The divisor is bisected from below, then single seats follow by quotient.
    """
    weights = np.asarray(weights, float)
    caps = np.where(weights > 0, np.asarray(caps, np.int64), 0)
    seats = min(int(seats), int(caps.sum()))

    def at(divisor: float) -> np.ndarray:
        return np.minimum(caps, np.minimum(np.floor(weights / divisor + 0.5), 2.0**62).astype(np.int64))

    if seats <= 0 or not len(weights):
        return np.zeros(len(weights), np.int64)
    low, high = weights.sum() / (4.0 * seats + 4.0 * len(weights) + 4), 2 * weights.max() + 1
    while at(low).sum() < seats and low > 1e-300:
        low /= 4
    for _ in range(200):
        middle = (low + high) / 2
        if at(middle).sum() > seats:
            low = middle
        else:
            high = middle
    given = at(high)
    queue = [(-weights[k] / (2 * given[k] + 1), k) for k in np.flatnonzero(given < caps)]
    heapq.heapify(queue)
    for _ in range(seats - int(given.sum())):
        _, k = heapq.heappop(queue)
        given[k] += 1
        if given[k] < caps[k]:
            heapq.heappush(queue, (-weights[k] / (2 * given[k] + 1), k))
    return given


def _row_key() -> dict[str, Column]:
    """128 bits that only rows with the same id, source and text share."""
    parts = [x for c in ("doc_id", "source", "text") for x in (F.col(c), F.col(c).isNull())]
    return {f"_key{k}": F.xxhash64(F.lit(SEED + k), *parts) for k in (1, 2)}


def sized(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size (words) and the long columns `keys` of every document, as a table."""
    arrow_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.bincount(words_of(texts(batch))[1], minlength=batch.num_rows).astype(np.int64)
            columns = [batch.column("doc_id").cast(pa.int64()), pc.cast(batch.column("source"), pa.string()), pa.array(size), *(batch.column(k) for k in keys)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", "size", *keys])

    schema = ", ".join(["doc_id long, source string, size long", *(f"{k} long" for k in keys)])
    return written(docs.select("doc_id", "text", "source", *keys).mapInArrow(count, schema), "sized")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, filled (rows with words), weight and target of every source."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("filled"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    # Sources reach their limit in order of limit / weight; one does if its share of what is left is above.
    limit = (F.lit(MOST) * F.col("source_size")).alias("limit")
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    flagged = weighed.withColumn("limit", limit)
    flagged = flagged.withColumn("_left", F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    flagged = flagged.withColumn("_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    flagged = flagged.withColumn("_full", F.col("limit") * F.col("_weight") <= F.col("weight") * F.col("_left"))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("limit"))).over(every), F.lit(0))
    weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(every)
    target = F.when(F.col("_full"), F.col("limit").cast("double")).otherwise(left.cast("double") * F.col("weight") / weight)
    return flagged.select("source", "source_size", "filled", F.col("weight").cast("long").alias("weight"), target.alias("target"))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    return _taken(sized(docs), (), block_words, seed)


def _taken(sizes: DataFrame, keys: tuple[str, ...], block_words: int, seed: int) -> DataFrame:
    """The rows of mix_sources with their `keys`, which deal rows without id and order all beside id and size."""
    goals = written(targets(sizes), "targets")

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last", kind="stable")
        seats = int(rows["source_size"].sum()) // block_words
        rows["quota"] = sainte_lague(rows["target"].to_numpy(), seats, MOST * rows["source_size"].to_numpy() // block_words)
        return rows[["source", "source_size", "filled", "target", "quota"]]

    quotas = goals.select("source", "source_size", "filled", "target").groupBy().applyInPandas(share, "source string, source_size long, filled long, target double, quota long")
    # Joined by a source's hash code so that a null source matches itself.
    code = F.xxhash64(F.lit(1), F.coalesce("source", F.lit("")), F.col("source").isNull())
    quotas = written(quotas.withColumn("_code", code), "quotas")
    coded = sizes.withColumn("_code", code)
    empty = coded.where("size = 0").join(quotas.select("_code", "source_size", "target"), "_code").withColumn("taken", F.lit(0).cast("long"))

    # One ring entry for up to COPIES equal rows; `_of` tells the entries of one row apart.
    alike = coded.where("size > 0").groupBy("doc_id", "source", "size", "_code", *keys).agg(F.count("*").alias("_rows"))
    alike = alike.withColumn("_of", F.explode(F.sequence(F.lit(0), F.expr(f"int((_rows - 1) div {COPIES})")))).withColumn("_rows", F.least(F.lit(COPIES), F.col("_rows") - F.col("_of") * COPIES))
    place = F.xxhash64(F.lit(seed), "doc_id", "size", "_of")
    if keys:
        place = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "_of", *keys)).otherwise(place)
    rows = alike.join(quotas.select("_code", "source_size", "filled", "target", "quota"), "_code")
    shards = F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.ceil(F.col("filled") / SHARD_ROWS), F.least(F.lit(LEAST_SHARDS), F.ceil(F.col("filled") / LEAST_ROWS)))
    rows = rows.withColumn("shard", F.pmod(place, shards)).withColumn("_turn", F.xxhash64(place, F.lit(seed + 1))).withColumn("_span", F.col("size") * F.col("_rows"))

    by_shard = rows.groupBy("_code", "shard").agg(F.sum("_span").alias("words"), F.first("quota").alias("quota"))

    def share_shards(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard")
        words = rows["words"].to_numpy()
        rows["blocks"] = sainte_lague(words, int(rows["quota"].iloc[0]), MOST * words // block_words)
        return rows[["_code", "shard", "words", "blocks"]]

    blocks = by_shard.groupBy("_code").applyInPandas(share_shards, "_code long, shard long, words long, blocks long")
    blocks = written(blocks, "blocks")

    ring = Window.partitionBy("_code", "shard").orderBy("_turn", "doc_id", "size", "_of", *keys).rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("at", F.coalesce(F.sum("_span").over(ring), F.lit(0))).join(blocks, ["_code", "shard"])
    wanted, words = F.col("blocks") * block_words, F.greatest("words", F.lit(1))
    rest = wanted % words
    begin = (F.pmod(F.xxhash64(F.lit(seed + 2), "_code", "shard"), F.ceil(words / block_words)) * block_words) % words

    def overlap(low, high):
        return F.greatest(F.least(F.col("at") + F.col("_span"), high) - F.greatest(F.col("at"), low), F.lit(0))

    rounds = ((wanted - rest) / words).cast("long")
    taken = rounds * F.col("_span") + overlap(begin, F.least(begin + rest, words)) + overlap(F.lit(0), begin + rest - words)
    copies = laid.withColumn("_taken", taken.cast("long")).withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    shown = ["doc_id", "source", "size", "source_size", "target", "taken", *keys]
    return copies.withColumn("taken", F.expr("_taken div _rows + int(_nth <= _taken % _rows)").cast("long")).select(shown).unionByName(empty.select(shown))


def repeat_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each document whole as often as its taken words come to, by seeded rounding.

    Rows are told apart by id, source and text, so rows without id and rows that share one keep counts
    of their own. Rows that agree in all three share their sum, as evenly as whole rows allow.
    """
    keys = tuple(_row_key())
    mix = _taken(sized(docs.select("doc_id", "text", "source").withColumns(_row_key()), keys), keys, block_words, seed).where("taken > 0")
    mix = mix.groupBy(*keys).agg(F.sum("taken").alias("taken"), F.first("size").alias("size"), F.count("*").alias("_rows"))
    times = F.col("taken") / F.greatest("size", F.lit(1))
    chance = F.pmod(F.xxhash64(F.lit(seed + 3), *keys), F.lit(1_000_000)) / 1_000_000
    mix = mix.select(*keys, "_rows", (F.floor(times) + F.when(chance < times - F.floor(times), 1).otherwise(0)).alias("_sum")).where("_sum > 0")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0]))
    # A row's own columns stay in a struct, so that their names can't clash with those added here.
    mixed = docs.withColumns(_row_key()).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), *keys).join(mix, list(keys)).withColumn("_nth", nth)
    mixed = mixed.withColumn("_times", F.expr("int(_sum div _rows) + int(_nth <= _sum % _rows)")).where("_times > 0")
    return mixed.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_doc.*")
