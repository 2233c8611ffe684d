"""Join operators: queue match, positional rest, sibling fill, precedence match, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def norm_key(value: Column | str) -> Column:
    """Lower-cased, trimmed, blank for null."""
    return F.lower(F.trim(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))))


def queue_match(lines: DataFrame, incoming: DataFrame, keys: list[str], quantity: str, line_order: str, row_order: str) -> DataFrame:
    """Each line offers `quantity` slots of its key; incoming rows claim the next slot in order.

    Slots are numbered by the running quantity, so a line is a range of slots and is never expanded.
    Lines and incoming rows of a key are laid in one order by slot, where a row's line is the last one
    before it: no pairs are tried. Lines without a positive quantity offer nothing.
    """
    w = Window.partitionBy(*keys).orderBy(line_order)
    offers = lines.where(F.col(quantity) > 0).withColumn("_to", F.sum(quantity).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("double"))
    offers = offers.select(*keys, (F.col("_to") - F.col(quantity) + 1).alias("_slot"), F.struct("_to", F.col(line_order).alias("line")).alias("_offer"))
    claims = incoming.withColumn("_slot", F.row_number().over(Window.partitionBy(*keys).orderBy(row_order)).cast("double"))
    claims = claims.select(*keys, "_slot", F.struct(*incoming.columns).alias("_row"))
    laid = Window.partitionBy(*keys).orderBy("_slot", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = offers.unionByName(claims, allowMissingColumns=True).withColumn("_offer", F.last("_offer", ignorenulls=True).over(laid)).where("_row is not null")
    line = F.when(F.col("_slot") <= F.col("_offer._to"), F.col("_offer.line"))
    return met.select("_row.*", F.col("_slot").cast("long").alias("slot"), line.alias(line_order))


def positional(left: DataFrame, right: DataFrame, keys: list[str], left_order: str, right_order: str) -> DataFrame:
    """Zips two sides of each key by position, only where both have the same number of rows."""
    def numbered(df: DataFrame, order: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        return df.withColumn("_pos", F.row_number().over(w.orderBy(order))).withColumn("_all", F.count("*").over(w))

    return numbered(left, left_order).join(numbered(right, right_order), [*keys, "_pos", "_all"]).withColumnRenamed("_pos", "pos").drop("_all")


def sibling_fill(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Null values take the value of the first row of the same keys that has one of its own.

    The first values are one row per key, found with partial aggregates, so a hot key is not gathered.
    Rows with a null among the keys have no siblings.
    """
    own = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min_by(value, order).alias("_sibling"))
    return df.join(own, keys, "left").withColumn(out, F.coalesce(value, "_sibling")).drop("_sibling")


def unique_or_null(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of keys that have exactly one row, null for others."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") == 1, F.first(value)).alias(value))


def jaccard(a: Column, b: Column) -> Column:
    """Share of two label sets' union in both; zero when the union is empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def first_of(rows: DataFrame, formats: DataFrame, key: str) -> DataFrame:
    """(id, fid): for each row the first format with its key. Formats are reduced to one a key before the join."""
    return rows.select("id", key).join(formats.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("fid").alias("fid")), key).select("id", "fid")


#: For d labels that may be missing, how many of a set's labels are combined: as many as give at most 300 combinations.
_COMBINED = (10**6, 299, 23, 10, 6, 5, 4, 3, 3, 3, 3, *[2] * 13)


def _combinations(labels: Column, spare: Column, take: Column) -> Column:
    """A hash of each choice of `take` labels out of an array's first `take + spare`, in their order."""
    begin = F.array(F.struct(F.lit(42).cast("long").alias("h"), F.lit(0).alias("out"), F.lit(0).alias("held")))

    def grow(states: Column, label: Column) -> Column:
        kept = F.transform(F.filter(states, lambda s: s["held"] < take), lambda s: F.struct(F.xxhash64(s["h"], label).alias("h"), s["out"].alias("out"), (s["held"] + 1).alias("held")))
        left = F.transform(F.filter(states, lambda s: s["out"] < spare), lambda s: F.struct(s["h"].alias("h"), (s["out"] + 1).alias("out"), s["held"].alias("held")))
        return F.concat(kept, left)

    return F.aggregate(F.slice(labels, F.lit(1), take + spare), begin, grow, lambda states: F.transform(states, lambda s: s["h"]))


def best_overlap(rows: DataFrame, formats: DataFrame, least: float) -> DataFrame:
    """(id, fid, score): for each row the format of the best Jaccard of label sets from `least` on, the first of equals.

    Equal sets are reduced to one each, and a set that a format has itself needs no other. Of others, sets of n and m
    labels can only reach `least` with c = ceil(least (n + m) / (1 + least)) common labels, so n - c of the one and m - c
    of the other may be missing; with d the larger of these, in one fixed order of labels (rare ones first) the
    first n - c + k and m - c + k labels have k in common. Both sides are joined on their combinations of k, with k as
    large as _COMBINED allows: few sets share one even where a few labels are in nearly all sets.
    """
    sets = rows.select("labels").distinct()
    best = formats.groupBy("labels").agg(F.min("fid").alias("fid"))
    equal = rows.join(best, "labels").where(F.size("labels") > 0).select("id", "fid", F.lit(1.0).alias("score"))
    lone, known = sets.join(best, "labels", "left_anti").where(F.size("labels") > 0), best.select("labels").where(F.size("labels") > 0)
    counts = lone.unionByName(known).select(F.explode("labels").alias("t")).groupBy("t").agg(F.count("*").alias("n"))

    def keyed(df: DataFrame, others: DataFrame, swapped: bool) -> DataFrame:
        ranked = df.select("labels", F.explode("labels").alias("t")).join(counts, "t").groupBy("labels").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("o"))  # bounded by the set
        sizes = others.select(F.size("labels").alias("m")).distinct()  # no more than there are labels
        n, m = F.size("labels"), F.col("m")
        both = ranked.join(F.broadcast(sizes), (n >= least * m - 1e-9) & (m >= least * n - 1e-9))
        both = both.withColumn("c", F.greatest(F.ceil((n + m) * (least / (1 + least)) - 1e-9).cast("int"), F.lit(1)))
        d = F.greatest(n, m) - F.col("c")
        both = both.withColumn("k", F.least("c", F.coalesce(F.get(F.array(*map(F.lit, _COMBINED)), d), F.lit(1))))
        pair = (m, n) if swapped else (n, m)
        return both.select("labels", *[c.alias(f"n{i}") for i, c in enumerate(pair)], F.explode(_combinations(F.col("o"), n - F.col("c"), F.col("k"))).alias("h"))

    a, b = keyed(lone, known, False).withColumnRenamed("labels", "x"), keyed(known, lone, True).withColumnRenamed("labels", "y")
    scored = a.join(b, ["n0", "n1", "h"]).select("x", "y").withColumn("score", jaccard(F.col("x"), F.col("y"))).where(F.col("score") >= least)
    found = scored.join(best, F.col("y") == F.col("labels")).groupBy("x").agg(F.min(F.struct((-F.col("score")).alias("s"), "fid")).alias("f"))
    return equal.unionByName(rows.join(found, F.col("labels") == F.col("x")).select("id", "f.fid", (-F.col("f.s")).alias("score")))


def template_for_path(files: DataFrame, file: str, path: str, templates: DataFrame) -> DataFrame:
    """(file, folder, exact, nearest): the active template of a file's own folder, and of the folder nearest above.

    A path is entity/type/name.../file with either slash; with fewer parts it has no folder. Templates have `key`
    (a folder's path with slashes) and `active`; a key is active if one of its rows is. A folder is looked up by
    each of its beginnings, an entity and a type at least, in one equi-join, and the longest that is there wins. Files
    are reduced to their folders first, so a folder with a third of all files is looked up once.
    """
    parts = F.filter(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    located = files.select(file, F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")).alias("folder"))
    folders = located.where("folder is not null").select("folder").distinct()
    steps = F.split("folder", "/")
    prefixes = folders.select("folder", F.explode(F.transform(F.sequence(F.lit(2), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))).alias("key"))
    active = templates.groupBy("key").agg(F.bool_or("active").alias("active")).where("active").select("key")
    met = prefixes.join(active, "key").groupBy("folder").agg(F.max(F.when(F.col("key") == F.col("folder"), F.col("key"))).alias("exact"), F.max_by("key", F.length("key")).alias("nearest"))
    return located.join(met, "folder", "left").select(file, "folder", "exact", "nearest")
