"""Window operators: latest rows, numbering, segments, throttles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of a range that one task numbers.
PART_ROWS = 1_000_000


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


def range_bounds(df: DataFrame, order: str, part_rows: int = PART_ROWS) -> list:
    """Values of a column that part its rows into ranges of about `part_rows`: as many as the rows need.

    They are taken from the distinct values that a hash picks, about 8 a range, which reach the driver: one value for
    each `part_rows` / 8 rows.
    """
    n = df.count()
    parts = n // part_rows + 1
    if parts == 1:
        return []
    drawn = F.pmod(F.xxhash64(order), F.lit(max(1, n // (8 * parts)))) == 0
    values = [r[0] for r in df.select(order).where(drawn & F.col(order).isNotNull()).distinct().orderBy(order).collect()]
    return values[:: max(1, -(-len(values) // parts))][1:]


def range_of(value: Column, bounds: list) -> Column:
    """The number of sorted bounds below a value, found by binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    array = F.array(*map(F.lit, bounds))
    begin = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        above = F.coalesce(F.get(array, middle) < value, F.lit(False))
        open_ = at["low"] < at["high"]
        return F.struct(F.when(open_ & above, middle + 1).otherwise(at["low"]).alias("low"), F.when(open_ & ~above, middle).otherwise(at["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), begin, halve, lambda at: at["low"])


def _with_offsets(ranged: DataFrame, keys: list[str], offsets: DataFrame) -> DataFrame:
    """Joins what the ranges before hold, one row for each key and range; keys may be null."""
    shown = offsets.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate([*keys, "_part"])], "_before")
    met = [ranged[c].eqNullSafe(F.col(f"_{k}")) for k, c in enumerate([*keys, "_part"])]
    joined = ranged.join(F.broadcast(shown) if not keys else shown, met)
    return joined.drop(*[f"_{k}" for k in range(len(keys) + 1)])


def number_by_ranges(df: DataFrame, keys: list[str], order: str, out: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Dense numbers from 1 on within each key in the order of a column, nulls first; no key is brought to one task.

    A row's range follows from its value and bounds taken once, so both uses of the rows agree on it
    whatever plan, partitions or retries there are. Each range numbers its own rows, and the ranges'
    sizes, one row each, are added up before. The rows shuffle once, by key and range. Rows of equal value
    follow each other in any order and share a range, so the column should be a key.
    """
    ranged = df.withColumn("_part", range_of(F.col(order), range_bounds(df, order, part_rows)))
    sizes = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")).drop("_n")
    numbered = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)))
    return _with_offsets(numbered, keys, offsets).withColumn(out, F.col("_before") + F.col("_rn")).drop("_part", "_rn", "_before")


def global_row_number(df: DataFrame, order: str, out: str, start: int = 1, part_rows: int = PART_ROWS) -> DataFrame:
    """Dense numbers over all rows in the order of a key, nulls first, without bringing them to one task."""
    return number_by_ranges(df, [], order, out, part_rows).withColumn(out, F.col(out) + F.lit(start - 1))


def global_running_sum(df: DataFrame, order: str, value: str, out: str, part_rows: int = PART_ROWS) -> DataFrame:
    """The sum of a value over all rows before each in the order of a key, by ranges as in number_by_ranges."""
    ranged = df.withColumn("_part", range_of(F.col(order), range_bounds(df, order, part_rows)))
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    offsets = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return _with_offsets(summed, [], offsets).withColumn(out, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def mint(df: DataFrame, prefix: str, order: str, last: DataFrame, out: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Numbers per prefix in an order, going on from the last number used (prefix, last), padded to six."""
    dealt = number_by_ranges(df, [prefix], order, "_minted", part_rows).join(last, prefix, "left")
    number = F.col("_minted") + F.coalesce("last", F.lit(0))
    return dealt.withColumn(out, F.concat(prefix, F.lpad(number.cast("string"), 6, "0"))).drop("last", "_minted")


def turns(df: DataFrame, key: str, order: list[str], last: str, out: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Numbers from 1 on within each key in the order of some columns with few values, then of a key column.

    The rows of equal order columns are counted and the counts added up, one row for each combination; within
    those, rows are numbered by ranges.
    """
    groups = df.groupBy(key, *order).agg(F.count("*").alias("_n"))
    before = groups.withColumn("_first", F.sum("_n").over(Window.partitionBy(key).orderBy(*order)) - F.col("_n"))
    shown = before.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate([key, *order])], "_first")
    numbered = number_by_ranges(df, [key, *order], last, "_turn", part_rows)
    met = [numbered[c].eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate([key, *order])]
    return numbered.join(shown, met).withColumn(out, F.col("_first") + F.col("_turn")).drop("_first", "_turn", *[f"_g{k}" for k in range(len(order) + 1)])


def segments(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Segment numbers: a new one where a non-blank value differs from the last non-blank one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_v", value).withColumn("_new", F.when(F.col("_v").isNotNull() & before.isNotNull() & (F.col("_v") != before), 1).otherwise(0))
    return marked.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_v", "_new")


def islands(df: DataFrame, keys: list[str], order: list[str], at: Column, gap: int, out: str) -> DataFrame:
    """Groups of rows whose neighbours are at most `gap` apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_at", at).withColumn("_new", F.when(F.col("_at") - F.lag("_at").over(w) > gap, 1).otherwise(0))
    return marked.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_at", "_new")


def trailing_count(keys: list[str], seconds: Column, span: int) -> Column:
    """Rows of a key in the trailing span of seconds, the current one included."""
    return F.count("*").over(Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-span, 0))
