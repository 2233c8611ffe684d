"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that readers confuse, each with the one it stands for.
CONFUSED, STANDS_FOR = "|81L26", "IBIIZG"

#: Groups of characters that stand for one another in vendor codes, each by its first.
CODE_GROUPS = ("0OUD", "1ILJF^|!", "2Z", "5S", "6G", "8B", "9P")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is found once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(value: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.lower(F.regexp_replace(F.trim(value), r"\s+", " "))


def alnum_upper(value: Column) -> Column:
    """Upper case, letters A-Z and digits only."""
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")


def canonical(value: Column) -> Column:
    """Upper case with confusable characters replaced by the class they belong to."""
    return F.translate(F.upper(value), CONFUSED, STANDS_FOR)


def confusable_score(a: Column, b: Column) -> Column:
    """Equal characters at equal places as far as both texts go, those of one group counted as equal."""
    known, first = "".join(CODE_GROUPS), "".join(g[0] * len(g) for g in CODE_GROUPS)
    shorter = F.least(F.length(a), F.length(b))
    left, right = (F.slice(F.split(F.translate(F.upper(x), known, first), ""), F.lit(1), shorter) for x in (a, b))
    return F.aggregate(F.zip_with(left, right, lambda x, y: (x == y).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


def word_cap(value: Column, limit: int) -> Column:
    """At most `limit` characters, cut at a word's end where there is one."""
    cut = F.regexp_replace(F.substring(value, 1, limit), r"\s+\S*\z", "")
    return F.when(F.length(value) <= limit, value).otherwise(cut)


def garbled(value: Column) -> Column:
    """Whether some letter stands four times in a row."""
    return F.rlike(value, F.lit(r"([A-Za-z])\1{3,}"))


def safe_name(value: Column) -> Column:
    """Characters that paths forbid replaced by underscores."""
    return F.trim(F.regexp_replace(value, r'[<>:"/\\|?*]+', "_"))


def prettify(value: Column) -> Column:
    """Words of a camel-case or underscored name."""
    return F.regexp_replace(F.regexp_replace(value, r"([a-z0-9])([A-Z])", "$1 $2"), "_", " ")


def first_lines(text: Column) -> Column:
    """Lines of a text."""
    return F.split(text, "\n")
