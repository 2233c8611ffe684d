"""Boxes with coordinates against plain loops."""

import random

from pyspark.sql import functions as F

from quillflow.operators import geometry


def page(rng, doc):
    """Words of a page in rows, at odd places and of unequal heights."""
    out = []
    for row in range(1, rng.randint(2, 9)):
        x = rng.randint(0, 80)
        for _ in range(rng.randint(0, 7)):
            word, height = rng.choice(["No", "Date", "a1", "b", "c9", " "]), rng.randint(0, 14)
            out.append((doc, row, x, x + 9 * len(word), 20 * row, 20 * row + height, word))
            x += 9 * len(word) + rng.choice([1, 4, 12, 19, 22, 60, 150])
    return out


WORDS = "doc long, row long, x0 long, x1 long, y0 long, y1 long, word string"


def test_segments_same_as_plain_loop(spark):
    rng = random.Random(4)
    words = [w for doc in range(40) for w in page(rng, doc)]
    wanted = []
    for key in {w[:2] for w in words}:
        parts = []
        for w in sorted((w for w in words if w[:2] == key and w[6].strip()), key=lambda w: (w[2], w[3], w[6])):
            if parts and w[2] - parts[-1][-1][3] <= 1.5 * max(parts[-1][-1][5] - parts[-1][-1][4], 1):
                parts[-1].append(w)
            else:
                parts.append([w])
        wanted += [(*key, n, " ".join(w[6].strip() for w in p), min(w[2] for w in p), max(w[3] for w in p), min(w[4] for w in p), max(w[5] for w in p)) for n, p in enumerate(parts, 1)]
    found = geometry.segments(spark.createDataFrame(words, WORDS).repartition(3), ["doc", "row"])
    assert sorted(map(tuple, found.collect())) == sorted(wanted) and len(wanted) > 100


def test_label_values_same_as_plain_loop(spark):
    rng = random.Random(5)
    words = [w for doc in range(60) for w in page(rng, doc) if w[6].strip()]
    wanted = []
    for doc, row, x0, x1, _, _, word in words:
        if word not in ("No", "Date"):
            continue
        right = []
        for w in sorted(w for w in words if w[:2] == (doc, row) and w[2] > x0):
            if w[6] in ("No", "Date"):
                break
            right.append(w[6])
        below = []
        for down in range(row + 1, row + 4):
            below = below or [w[6] for w in sorted(w for w in words if w[:2] == (doc, down) and x0 - 60 <= w[2] <= x0 + 220)]
        wanted.append((doc, row, x0, word, " ".join(right or below), "right" if right else "below" if below else "none"))
    found = geometry.label_values(spark.createDataFrame(words, WORDS).repartition(3), ["doc"], "row", F.col("word").isin("No", "Date"))
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert {w[5] for w in wanted} == {"right", "below", "none"}


def test_label_values_of_rows_shuffle_no_words(spark):
    rows = [(1, 1, [(0, 9, "No", True), (12, 20, "a", False), (24, 30, "No", True)]), (1, 2, []), (1, 3, [(30, 40, "b", False), (400, 410, "c", False)]), (2, 1, [(0, 9, "No", True)])]
    df = spark.createDataFrame(rows, "doc long, row long, boxes array<struct<x0: long, x1: long, word: string, label: boolean>>")
    assert sorted(map(tuple, geometry.label_values_of_rows(df, ["doc"], "row").collect())) == [(1, 1, 0, "No", "a", "right"), (1, 1, 24, "No", "b", "below"), (2, 1, 0, "No", "", "none")]
    found = spark.createDataFrame([([2, 3, 1],), ([],)], "v array<bigint>").select(geometry.sums_before("v").alias("s")).collect()
    assert [list(r.s) for r in found] == [[0, 2, 5], []]
