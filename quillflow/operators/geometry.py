"""Boxes with coordinates: words to segments by gaps, and the values of labels to their right or below them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

#: A gap wider than this many heights parts two cells; the band below a label, and how many rows down.
GAP = 1.5
BAND_LEFT, BAND_RIGHT, ROWS_DOWN = 60, 220, 3


def segments(words: DataFrame, line: list[str]) -> DataFrame:
    """One box for each run of words of a line (its columns `line`) without a wide gap: n, text, x0, x1, y0, y1.

    Words have x0, x1, y0, y1 and word; blank ones don't count. A gap is measured against the height of the word before
    it, one unit at least.
    """
    order = Window.partitionBy(*line).orderBy("x0", "x1", "word")
    shown = words.where(F.trim("word") != "")
    wide = F.col("x0") - F.lag("x1").over(order) > GAP * F.greatest(F.lag(F.col("y1") - F.col("y0")).over(order), F.lit(1))
    parted = shown.withColumn("_new", F.coalesce(wide.cast("int"), F.lit(1)))
    numbered = parted.withColumn("n", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.array_sort(F.collect_list(F.struct("x0", "x1", F.trim("word").alias("w"))))  # bounded by a line's words
    ends = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    return numbered.groupBy(*line, "n").agg(F.array_join(F.transform(held, lambda x: x["w"]), " ").alias("text"), *ends)


def label_values(words: DataFrame, doc: list[str], row: str, label: Column) -> DataFrame:
    """`label_values_of_rows` of words one by one, which have x0, x1 and word; `label` says which are labels."""
    boxes = F.array_sort(F.collect_list(F.struct("x0", "x1", "word", label.alias("label"))))  # bounded by a row's words
    return label_values_of_rows(words.groupBy(*doc, row).agg(boxes.alias("boxes")), doc, row)


def label_values_of_rows(rows: DataFrame, doc: list[str], row: str) -> DataFrame:
    """(doc, row, x0, label, value, side) of each label word: what stands to its right, up to the next label of its row;
    else what stands in its column band on the first of the next rows that has something there; else nothing.

    `boxes` holds a row's words in order: x0, x1, word and label (whether it is one). What is to the right follows within
    the row; only labels without it look below, by an equi-join on the rows they may look at, so words don't shuffle one by one.
    """
    text = lambda boxes: F.array_join(F.transform(boxes, lambda x: x["word"]), " ")
    places = F.filter(F.transform("boxes", lambda x, k: F.when(x["label"], k)), lambda k: k.isNotNull())

    def head(place: Column, number: Column) -> Column:
        until = F.coalesce(F.get("_places", number + 1), F.size("boxes"))
        right = F.filter(F.slice("boxes", place + 2, until - place - 1), lambda x: ~x["label"])
        return F.struct(F.get("boxes", place)["x0"].alias("x0"), F.get("boxes", place)["word"].alias("label"), text(right).alias("_right"))

    labelled = rows.where(F.exists("boxes", lambda x: x["label"])).withColumn("_places", places)
    heads = labelled.select(*doc, row, F.inline(F.transform("_places", head)))
    targets = heads.where("_right = ''").select(*doc, row, "x0", F.explode(F.sequence(F.col(row) + 1, F.col(row) + ROWS_DOWN)).alias("_down"))
    there = rows.select(*doc, F.col(row).alias("_down"), F.transform("boxes", lambda x: F.struct(x["x0"].alias("x0"), x["word"].alias("word"))).alias("_boxes"))
    band = F.filter("_boxes", lambda x: (x["x0"] >= F.col("x0") - BAND_LEFT) & (x["x0"] <= F.col("x0") + BAND_RIGHT))
    met = targets.join(there, [*doc, "_down"]).select(*doc, row, "x0", "_down", band.alias("_band")).where(F.size("_band") > 0)
    below = met.groupBy(*doc, row, "x0").agg(F.min_by(text(F.col("_band")), "_down").alias("_below"))
    joined = heads.join(below, [*doc, row, "x0"], "left")
    side = F.when(F.col("_right") != "", "right").when(F.col("_below").isNotNull(), "below").otherwise("none")
    return joined.select(*doc, row, "x0", "label", F.coalesce(F.nullif("_right", F.lit("")), "_below", F.lit("")).alias("value"), side.alias("side"))


@F.pandas_udf(ArrayType(LongType()))
def sums_before(values: pd.Series) -> pd.Series:
    """For each number of an array the sum of those before it."""
    return values.map(lambda v: np.cumsum(v, dtype=np.int64) - v)
