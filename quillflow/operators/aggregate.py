"""Aggregations of the ledger: zero-filled counts, labels, votes, folds."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def money(value: Column | str) -> Column:
    """Exact sum of amounts: added as decimals, so the order of rows doesn't matter."""
    return F.sum(F.col(value).cast("decimal(18,4)") if isinstance(value, str) else value.cast("decimal(18,4)")).cast("double")


def count_if(condition: Column) -> Column:
    """Rows that meet a condition; null doesn't."""
    return F.count(F.when(condition, 1))


def zero_filled_counts(dimension: DataFrame, fact: DataFrame, key: str, counted: str) -> DataFrame:
    """Each member of a dimension with its count of facts, zero where there are none.

    Facts are counted before the join, so the join moves one row per member.
    """
    counts = fact.groupBy(key).agg(F.count(counted).alias("n"))
    return dimension.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def mode_first(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The most frequent value per key; of equal counts the one seen first in `order`."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", value)).alias("_best")
    return counts.groupBy(*keys).agg(best).select(*keys, (-F.col("_best.n")).alias("n"), F.col(f"_best.{value}").alias(value))


def char_vote(df: DataFrame, keys: list[str], reading: str, order: str) -> DataFrame:
    """Character-wise majority of equally long readings; ties go to the reading seen first."""
    chars = df.select(*keys, order, F.posexplode(F.split(reading, "")).alias("pos", "ch")).where("ch <> ''")
    best = mode_first(chars, [*keys, "pos"], "ch", [order])
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("voted"))


#: Distinct values of a key beyond which they are folded as a stream, not as one list.
LONG_LIST = 1_000


def _signs(value: Column) -> Column:
    return F.regexp_replace(F.lower(value), "[^a-z0-9]", "")


def fold_contained(df: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    """(key, out): each key's values in order, without those that one kept before them holds, as they are or in their
    letters and digits alone.

    A value that comes again is always held by what is kept, so only its first place is taken: keys are reduced to
    their distinct values before anything is gathered. Few values are folded as a list; a key with more than LONG_LIST
    streams through in order, with the kept values in hand.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_at"))
    sized = first.join(first.groupBy(key).agg(F.count("*").alias("_n")), key)

    def fold(kept: Column, v: Column) -> Column:
        held = F.exists(kept, lambda x: F.contains(x, v) | ((_signs(v) != "") & F.contains(_signs(x), _signs(v))))
        return F.when(held, kept).otherwise(F.concat(kept, F.array(v)))

    values = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("_v")))), lambda x: x["_v"])
    short = sized.where(F.col("_n") <= LONG_LIST).groupBy(key).agg(values.alias("_all"))
    short = short.select(key, F.aggregate("_all", F.array().cast("array<string>"), fold).alias(out))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, []
        for batch in batches:
            for k, v in batch.itertuples(index=False):
                if k != now:
                    if kept:
                        yield pd.DataFrame({key: [now], out: [[x for x, _ in kept]]})
                    now, kept = k, []
                signs = re.sub("[^a-z0-9]", "", v.lower())
                if not any(v in x or (signs and signs in s) for x, s in kept):
                    kept.append((v, signs))
        if kept:
            yield pd.DataFrame({key: [now], out: [[x for x, _ in kept]]})

    long = sized.where(F.col("_n") > LONG_LIST).repartition(key).sortWithinPartitions(key, "_at").select(key, value)
    return short.unionByName(long.mapInPandas(stream, short.schema))


def string_list(value: str) -> Column:
    """Distinct values in order, comma-joined."""
    return F.array_join(F.array_sort(F.collect_set(value)), ", ")


def batch_label(df: DataFrame) -> Column:
    """Label of a batch by its counts: total, excluded, open, finished, pending."""
    total, excluded = F.col("total"), F.col("excluded")
    return (
        F.when((total > 0) & (excluded == total), "EXCLUDED")
        .when((total > 0) & (F.col("finished") + excluded >= total), "COMPLETED")
        .when(F.col("finished") > F.col("open"), "IN PROGRESS")
        .when(F.col("pending") > 0, "DOWNLOADED")
        .otherwise("CREATED")
    )


#: Statuses that a batch's label doesn't count.
UNCOUNTED = ("EXCLUDED", "NEW TEMPLATE", "DUPLICATE", "DATA MISMATCH", "PENDING IN SF", "MANUALLY UPDATED", "UNSUPPORTED")


def status_tallies(status: str) -> list[Column]:
    """The counts that `tier_label` takes: total, uncounted, excluded, loaded, posted, completed, rejected."""
    named = {"excluded": "EXCLUDED", "loaded": "LOADED", "posted": "POSTED", "completed": "COMPLETED", "rejected": "REJECTED BY ACCOUNTS"}
    return [F.count("*").alias("total"), count_if(F.col(status).isin(*UNCOUNTED)).alias("uncounted"), *[count_if(F.col(status) == v).alias(k) for k, v in named.items()]]


def tier_label(reincluded: Column, downloaded: Column) -> Column:
    """Label of a batch by its tallies, by the first rule that holds.

    A rejected document counts as loaded: it was, and has the same next step. Documents in a status that isn't
    counted hold no batch back.
    """
    total, excluded, posted, completed = (F.col(c) for c in ("total", "excluded", "posted", "completed"))
    loaded, counted = F.col("loaded") + F.col("rejected"), total - F.col("uncounted")
    reached = loaded + posted + completed
    tier = F.when(loaded > 0, "LOADED").when(posted > 0, "POSTED").otherwise("COMPLETED")
    return (
        F.when((total > 0) & (excluded == total), "EXCLUDED")
        .when((total > 0) & (completed + excluded == total), "COMPLETED")
        .when((counted > 0) & (reached > 0) & (reached == counted), tier)
        .when(reincluded, "DOWNLOADED")
        .when(reached > 0, "IN PROGRESS")
        .when(downloaded, "DOWNLOADED")
        .otherwise("CREATED")
    )
