"""Merges on plain tables: each takes the old rows and the changes, and returns the new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.operators.window import global_row_number
from pyspark.sql.window import Window


def upsert_soft_delete(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], scope: str | None = None) -> DataFrame:
    """Upserts by key; old rows missing from the source become inactive, within scopes that it mentions."""
    a = old.select(*keys, *[F.col(v).alias(f"_o_{v}") for v in values], F.col("active").alias("_o_active"))
    b = new.select(*keys, *[F.col(v).alias(f"_n_{v}") for v in values], F.lit(True).alias("_hit"))
    joined = a.join(b, keys, "full")
    gone = F.col("_hit").isNull()
    if scope:
        mentioned = new.select(scope).distinct().withColumn("_in", F.lit(True))
        joined = joined.join(mentioned, scope, "left")
        gone = gone & F.col("_in").isNotNull()
    shown = [F.when(F.col("_hit"), F.col(f"_n_{v}")).otherwise(F.col(f"_o_{v}")).alias(v) for v in values]
    return joined.select(*keys, *shown, F.when(F.col("_hit"), True).when(gone, False).otherwise(F.col("_o_active")).alias("active"))


def update_where(df: DataFrame, ids: DataFrame, key: str, column: str, guard: Column, value) -> DataFrame:
    """Sets a column of the wanted rows that pass the guard."""
    marked = df.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumn(column, F.when(F.col("_hit") & guard, F.lit(value)).otherwise(F.col(column))).drop("_hit")


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of parents that the new rows mention are replaced by the new rows."""
    kept = old.join(new.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(new)


def patch_by_position(old: DataFrame, new: DataFrame, parent: str, old_order: str, new_order: str, column: str) -> DataFrame:
    """The nth new value of a parent patches its nth old row; blanks never overwrite."""
    a = old.withColumn("_pos", F.row_number().over(Window.partitionBy(parent).orderBy(old_order)))
    b = new.select(parent, F.col(column).alias("_new"), F.row_number().over(Window.partitionBy(parent).orderBy(new_order)).alias("_pos"))
    use = F.col("_new").isNotNull() & (F.trim("_new") != "")
    return a.join(b, [parent, "_pos"], "left").withColumn(column, F.when(use, F.col("_new")).otherwise(F.col(column))).drop("_new", "_pos")


def absorb(rows: DataFrame, moves: DataFrame, key: str, values: list[str], children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, children) after each shell's values went over its target's, blanks never, and its children to the target.

    moves: (shell, target), each shell once. Shells are dropped.
    """
    given = moves.join(rows.select(F.col(key).alias("shell"), *[F.col(v).alias(f"_n_{v}") for v in values]), "shell").withColumnRenamed("target", key).drop("shell")
    left = rows.join(moves.select(F.col("shell").alias(key)), key, "left_anti").join(given, key, "left")
    merged = left.withColumns({v: F.coalesce(f"_n_{v}", v) for v in values}).drop(*[f"_n_{v}" for v in values])
    moved = children.join(moves.select(F.col("shell").alias(key), "target"), key, "left").withColumn(key, F.coalesce("target", key)).drop("target")
    return merged, moved


def evolve(df: DataFrame, add: dict[str, str], rename: dict[str, str], drop: list[str]) -> DataFrame:
    """Columns renamed, added with nulls and dropped, each only where it isn't done yet."""
    for old, new in rename.items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    df = df.withColumns({c: F.lit(None).cast(kind) for c, kind in add.items() if c not in df.columns})
    return df.drop(*drop)


def save_with_children(headers: DataFrame, children: DataFrame, saves: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers, children) after saves, each of which finds its header by the key it had, else by its own.

    headers: id, key, name, active; children: id, col, value, active; saves: old_key (null if it isn't renamed), key,
    name, one a key; values: key, col, value of the saves. A header that is found takes the save's key and name and is
    active; one that isn't is inserted, numbered after the largest id in order of keys. Of the children of a saved
    header, those named again take the value and are active, new ones are inserted, the others are deactivated; what
    happened to each is its `action`, `kept` if nothing did. Children of other headers stay as they are.
    """
    found = saves.withColumn("_at", F.coalesce("old_key", "key")).join(headers.select(F.col("key").alias("_at"), "id"), "_at", "left")
    last = headers.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = global_row_number(found.where("id is null").select("key"), "key", "_id", int(last) + 1)
    saved = found.join(new, "key", "left").select(F.coalesce("id", "_id").alias("id"), F.col("key").alias("_key"), F.col("name").alias("_name"))
    out = headers.join(saved, "id", "full")
    there = F.col("_key").isNotNull()
    out = out.select("id", F.coalesce("_key", "key").alias("key"), F.when(there, F.col("_name")).otherwise(F.col("name")).alias("name"), F.when(there, F.lit(True)).otherwise(F.col("active")).alias("active"))

    given = values.join(saved.select(F.col("_key").alias("key"), "id"), "key").select("id", "col", F.col("value").alias("_value"), F.lit(True).alias("_given"))
    touched = saved.select("id", F.lit(True).alias("_saved"))
    met = children.join(given, ["id", "col"], "full").join(touched, "id", "left")
    named, stood = F.col("_given").isNotNull(), F.col("active").isNotNull()
    changed = ~F.coalesce("value", F.lit("")).eqNullSafe(F.coalesce("_value", F.lit(""))) | ~F.col("active")
    action = F.when(named & ~stood, "inserted").when(named & changed, "updated").when(~named & F.col("_saved") & F.col("active"), "deactivated").otherwise("kept")
    kids = met.withColumn("action", action)
    value = F.when(F.col("action").isin("inserted", "updated"), F.col("_value")).otherwise(F.col("value"))
    active = F.when(F.col("action").isin("inserted", "updated"), F.lit(True)).when(F.col("action") == "deactivated", F.lit(False)).otherwise(F.col("active"))
    return out, kids.select("id", "col", value.alias("value"), active.alias("active"), "action")
