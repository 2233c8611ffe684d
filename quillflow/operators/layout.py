"""Layout operators on lines, boxes and cells; windows and groups are bounded by one document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Unit names.
UNITS = "(nos|pcs|kg|mtr|set)"


def items(lines: DataFrame, doc: str, order: list[str], starts: Column, leads_in: Column) -> DataFrame:
    """The lines with `idx` and `item`: a start opens an item, other lines carry it on, lead-in lines go to the next
    item where there is one. Item 0 holds lines with no item above."""
    own = Window.partitionBy(doc).orderBy(*order)
    lines = lines.withColumn("idx", F.row_number().over(own)).withColumn("_start", starts.cast("int"))
    upto = F.sum("_start").over(Window.partitionBy(doc).orderBy("idx"))
    every = F.sum("_start").over(Window.partitionBy(doc))
    return lines.withColumn("_upto", upto).withColumn("item", F.when(leads_in & (F.col("_upto") < every), F.col("_upto") + 1).otherwise(F.col("_upto"))).drop("_start", "_upto")


def beside_or_below(boxes: DataFrame, doc: list[str], row: str, x: str, word: str, label: Column) -> DataFrame:
    """The label boxes with `value` and `side`: the next box on the row, else the box below, else none."""
    beside = F.lead(word).over(Window.partitionBy(*doc, row).orderBy(x))
    labels = boxes.withColumn("_beside", beside).where(label)
    below = boxes.select(*doc, (F.col(row) - 1).alias(row), x, F.col(word).alias("_below"))
    met = labels.join(below, [*doc, row, x], "left")
    side = F.when(F.col("_beside").isNotNull(), "right").when(F.col("_below").isNotNull(), "below").otherwise("none")
    return met.withColumn("value", F.coalesce("_beside", "_below", F.lit(""))).withColumn("side", side).drop("_beside", "_below")


def labels_in_lines(docs: DataFrame, doc: str, text: str, labels: tuple[str, ...]) -> DataFrame:
    """(doc, idx, x, label, value, side) of the words of a text that are labels, by `beside_or_below` on its lines.

    Lines with a bar belong to tables and have no boxes. A text's lines stay one array of arrays of words: the next
    word and the word below are looked up by index, and only label hits leave the row. Nothing is shuffled.
    """
    held = F.transform(F.split(text, "\n"), lambda line: F.when(~F.contains(line, F.lit("|")), F.split(line, " ")))
    rows = docs.where(F.rlike(text, F.lit(rf"(?m)(^|[ \n])({'|'.join(labels)})($|[ \n])"))).select(doc, held.alias("_lines"))

    def hits(words: Column, i: Column) -> Column:
        spots = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda k: F.get(words, k).isin(*labels))
        one = lambda k: F.struct((i + 1).cast("long").alias("idx"), (k + 1).cast("long").alias("x"), F.get(words, k).alias("label"), F.get(words, k + 1).alias("beside"), F.get(F.get(F.col("_lines"), i + 1), k).alias("below"))
        return F.when(words.isNotNull(), F.transform(spots, one)).otherwise(F.array().cast("array<struct<idx:bigint,x:bigint,label:string,beside:string,below:string>>"))

    found = rows.select(doc, F.explode(F.flatten(F.transform("_lines", hits))).alias("h")).select(doc, "h.*")
    side = F.when(F.col("beside").isNotNull(), "right").when(F.col("below").isNotNull(), "below").otherwise("none")
    return found.select(doc, "idx", "x", "label", F.coalesce("beside", "below", F.lit("")).alias("value"), side.alias("side"))


def nearest_anchor(cells: DataFrame, doc: list[str], row: str, column: str, x: str) -> DataFrame:
    """The cells below a document's first row with `col`, the number of that row's nearest cell, the first of equals.

    The first row's places become one array per document, so each cell looks its anchor up without a join of pairs.
    """
    first = F.min(row).over(Window.partitionBy(*doc))
    marked = cells.withColumn("_first", first)
    anchors = marked.where(F.col(row) == F.col("_first")).groupBy(*doc).agg(F.collect_list(F.struct(F.col(column).alias("k"), F.col(x).alias("x"))).alias("_anchors"))
    met = marked.where(F.col(row) > F.col("_first")).join(anchors, doc)
    near = F.array_min(F.transform("_anchors", lambda a: F.struct(F.abs(a["x"] - F.col(x)).alias("d"), a["k"].alias("k"))))
    return met.withColumn("col", near["k"]).drop("_first", "_anchors")


def merge_header(rows: DataFrame, doc: list[str], row: str, cells: str) -> DataFrame:
    """One row per document: its first row's cells as `header`, joined with the next row's where that follows at
    once, has as many cells and no digits (`two_rows`)."""
    w = Window.partitionBy(*doc).orderBy(row)
    ahead = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.lead(row).over(w)).withColumn("_sub", F.lead(cells).over(w)).where("_rn = 1")
    sub = (F.col("_next") == F.col(row) + 1) & (F.size("_sub") == F.size(cells)) & ~F.rlike(F.array_join("_sub", " "), F.lit("[0-9]"))
    joined = F.zip_with(cells, "_sub", lambda a, b: F.trim(F.concat(F.trim(a), F.lit(" "), F.trim(b))))
    two = F.coalesce(sub, F.lit(False))
    return ahead.withColumn("two_rows", two).withColumn("header", F.when(F.col("two_rows"), joined).otherwise(F.transform(cells, lambda c: F.trim(c)))).drop("_rn", "_next", "_sub")


def token_class(token: Column) -> Column:
    """code, number, unit, number and unit, or word."""
    is_ = lambda p: F.rlike(token, F.lit(f"^(?:{p})$"))
    return (
        F.when(is_(r"99\d{2,4}|\d{8}"), "code").when(is_(r"[0-9,]+(\.\d+)?"), "number").when(is_(rf"(?i){UNITS}\.?"), "unit")
        .when(is_(rf"(?i)\d+(\.\d+)?{UNITS}\.?"), "number and unit").otherwise("word")
    )


def serial_of(text: Column) -> Column:
    """A serial number of one to three digits at the beginning, glued or not; null if none."""
    return F.nullif(F.regexp_extract(text, r"^(\d{1,3})\s*[A-Za-z]", 1), F.lit(""))


def clean_item(text: Column) -> Column:
    """A description without its serial number, unit serial numbers, rates and footers."""
    steps = ((r"^\d{1,3}\s*([A-Za-z])", "$1"), (r"(?i)\bS/?N(o\.?)?\s*:?\s*[A-Z0-9-]*\d[A-Z0-9-]*", ""), (r"\s*\d+(\.\d+)?\s*%", ""), (r"(?i)\s*(E\s*&\s*OE|page \d+ of \d+).*$", ""))
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def blocks(lines: DataFrame, doc: list[str], row: str, line: str, mark: str, party: str) -> DataFrame:
    """One row per block below a marker: its number, the marker, its first filled line as `name`, the rest as `address`."""
    w = Window.partitionBy(*doc).orderBy(row)
    filled = lines.withColumn("block", F.count(mark).over(w)).withColumn(party, F.last(mark, ignorenulls=True).over(w))
    filled = filled.where(F.col(mark).isNull() & (F.trim(line) != "") & F.col(party).isNotNull())
    held = F.array_sort(F.collect_list(F.struct(row, line)))  # bounded by a document's lines
    grouped = filled.groupBy(*doc, "block", party).agg(held.alias("_held")).withColumn("_texts", F.transform("_held", lambda x: x[line]))
    rest = F.when(F.size("_texts") > 1, F.array_join(F.expr("slice(_texts, 2, size(_texts) - 1)"), ", "))
    return grouped.select(*doc, "block", party, F.element_at("_texts", 1).alias("name"), rest.alias("address"))


def groups_from_first(rows: DataFrame, key: str, at: str, tie: str, gap: int, out: str) -> DataFrame:
    """The rows with the number of their group: a row more than `gap` after its group's first one opens the next.

    No window can tell, as each group hangs on the one before; a key's rows stream through in order, with
    its group's first value and number as all that is held.
    """

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, first, group = None, 0, 0
        for batch in batches:
            numbers = []
            for k, t in zip(batch[key], batch[at], strict=True):
                if k != who:
                    who, first, group = k, t, 1
                elif t - first > gap:
                    first, group = t, group + 1
                numbers.append(group)
            yield batch.assign(**{out: numbers})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {out} long"
    return rows.repartition(key).sortWithinPartitions(key, at, tie).mapInPandas(number, schema)
