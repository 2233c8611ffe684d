"""Sinks: documents as partitioned JSON, sheets as CSV, ledger tables appended or replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_documents(df: DataFrame, folder: str, by: list[str]) -> None:
    """Nested documents as JSON lines below folders by entity, type and name."""
    df.write.mode("append").partitionBy(*by).json(folder)


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """Each sheet as CSV with a header, in a folder of its name; nulls become blanks."""
    for name, df in sheets.items():
        shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns]
        df.select(*shown).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def append(df: DataFrame, path: str) -> None:
    """New rows of a ledger table; columns are matched by name when the table is read with mergeSchema."""
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str, version: int) -> str:
    """A whole new state of a table, as a new version beside the old ones; returns its path.

    Old and new state never share a path, so a merge can read the one while it writes the other.
    """
    target = f"{path}/v{version:08d}"
    df.write.mode("overwrite").parquet(target)
    return target


def shred(documents: DataFrame, key: str, items: str) -> tuple[DataFrame, DataFrame]:
    """Header and line tables of nested documents; lines are numbered in tens of thousands."""
    header = documents.drop(items)
    exploded = documents.select(key, F.posexplode(items).alias("_pos", "_item"))
    return header, exploded.select(key, ((F.col("_pos") + 1) * 10000).alias("line_no"), "_item.*")
