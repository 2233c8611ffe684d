"""Table functions: a document's pages to its invoices, an invoice's text to its items; for SQL and lateral joins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from quillflow.functions.text import CODE_GROUPS
from quillflow.session import ship_package

_ALIKE = str.maketrans({c: group[0] for group in CODE_GROUPS for c in group})


@udtf(returnType="document long, invoice int, number string, first_page long, last_page long, n_pages int")
class Invoices:
    """The invoices of a document, from a table of its pages (document, page, number) partitioned by document.

    Called as `invoices(TABLE(pages) PARTITION BY document ORDER BY (...))`. A page goes on with the invoice before it
    unless a number is read on it that differs from the last one read (characters that readers confuse don't
    differ). Pages stream through, one invoice in hand. Pages without a document are an own document.
    """

    def __init__(self) -> None:
        self.now: list | None = None

    def eval(self, page: Row) -> Iterator[tuple]:
        number = page["number"] or None
        if self.now and number and self.now[2] and number.upper().translate(_ALIKE) != self.now[2].upper().translate(_ALIKE):
            yield tuple(self.now)
            self.now = [self.now[0], self.now[1] + 1, number, page["page"], page["page"], 1]
        elif self.now:
            self.now[2] = self.now[2] or number
            self.now[4:] = [page["page"], self.now[5] + 1]
        else:
            self.now = [page["document"], 1, number, page["page"], page["page"], 1]

    def terminate(self) -> Iterator[tuple]:
        if self.now:
            yield tuple(self.now)


#: An item's first line: serial number, description, quantity x rate.
_ITEM = re.compile(r"\s*(\d+)[.)]\s+(.*?)\s+(\d+)\s*x\s*(\d+(?:\.\d+)?)\s*$")


@udtf(returnType="line_no int, description string, quantity long, rate decimal(18,2), amount decimal(18,2)")
class Items:
    """The items of an invoice's text: `LATERAL items(text)`.

    An item begins at a line with a serial number, a quantity and a rate; other lines go on with the description
    above, lines before the first item don't count. Items are renumbered in steps of 10000. No text, no items.
    """

    def eval(self, text: str) -> Iterator[tuple]:
        now, line_no = None, 0
        for line in (text or "").split("\n"):
            if found := _ITEM.match(line):
                if now:
                    yield now
                line_no += 10_000
                quantity, rate = int(found[3]), Decimal(found[4])
                now = (line_no, found[2], quantity, rate, quantity * rate)
            elif now and line.strip():
                now = (now[0], f"{now[1]} {line.strip()}", *now[2:])
        if now:
            yield now


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL as `invoices` and `items`."""
    ship_package(spark)
    spark.udtf.register("invoices", Invoices)
    spark.udtf.register("items", Items)
