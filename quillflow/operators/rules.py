"""Rules: blank tests, missing fields, first-hit verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillflow.functions.codes import strip_prefix


def is_blank(value: Column | str) -> Column:
    """Null, empty or white space only."""
    value = F.col(value) if isinstance(value, str) else value
    return value.isNull() | (F.trim(value) == "")


def missing_fields(fields: dict[str, Column]) -> Column:
    """Sorted distinct names of the fields that are blank."""
    named = F.array(*[F.when(is_blank(v), F.lit(k)) for k, v in fields.items()])
    return F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))


def first_hit(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The outcome of the first rule that holds."""
    chain = F.when(*_pair(rules[0]))
    for rule in rules[1:]:
        chain = chain.when(*_pair(rule))
    return chain.otherwise(otherwise)


def _pair(rule: tuple[Column, str]) -> tuple[Column, Column]:
    return rule[0], F.lit(rule[1])


def any_contains(columns: list[Column], text: str) -> Column:
    """Whether any column contains a text, ignoring case; wildcards have no meaning."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return found


#: What reservations refer to, and the keys that tie a document's sheets: sheet, column, what it holds.
SOURCE_TYPE, SOURCE_SUBTYPE = "39", "1"
LINKS = (
    ("Purchase Header", "Document Type", "type"), ("Purchase Header", "No.", "number"), ("Purchase Header", "Consignment Note No.", "order"),
    ("Purchase Line", "Document Type", "type"), ("Purchase Line", "Document No.", "number"), ("Purchase Line", "Line No.", "line"), ("Purchase Line", "Type", "charge"),
    ("Reservation Entry", "Source Type", "source"), ("Reservation Entry", "Source Subtype", "subtype"), ("Reservation Entry", "Source ID", "number"), ("Reservation Entry", "Source Ref. No.", "line"),
    ("Reservation Entry", "Quantity", "one"), ("Reservation Entry", "Quantity (Base)", "one"),
)


def linked_cells(sheet: str, type_: Column, number: Column, order: Column, line: Column, charge: Column) -> Column:
    """Array of (col, value): the cells of a sheet that the relationship between sheets fixes, whatever a mapping says.

    `charge` is the type of a charge line, null for others, whose type no key fixes.
    """
    held = {"type": type_, "number": number, "order": strip_prefix(F.coalesce(order, F.lit(""))), "line": line, "charge": charge, "source": F.lit(SOURCE_TYPE), "subtype": F.lit(SOURCE_SUBTYPE), "one": F.lit("1")}
    cells = [F.struct(F.lit(col).alias("col"), F.coalesce(held[what], F.lit(None if what == "charge" else "")).cast("string").alias("value")) for name, col, what in LINKS if name == sheet]
    return F.filter(F.array(*cells), lambda x: x["value"].isNotNull())
