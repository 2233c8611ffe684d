"""Amounts, rates and line reconciliation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillflow.functions.text import let

#: Tax slabs in percent that a line's amounts are checked with.
SLABS = (5.0, 12.0, 18.0, 28.0)
#: All slabs, those that an implied rate may name, and how near it must be.
ALL_SLABS, NAMED_SLABS, SLAB_REACH = (0.1, 0.25, 3.0, 5.0, 12.0, 18.0, 28.0, 40.0), (3.0, 5.0, 12.0, 18.0, 28.0), 0.3


def number(value: Column) -> Column:
    """A number written with commas or a percent sign; null if it is none."""
    return F.regexp_replace(F.trim(value), "[,%]", "").try_cast("double")


def nearest_slab(rate: Column) -> Column:
    """The slab nearest to a rate, the lower of two equally near; null if it isn't a named one or is too far."""
    slabs = F.array(*map(F.lit, ALL_SLABS))
    best = F.array_min(F.transform(slabs, lambda s: F.struct(F.abs(s - rate).alias("d"), s.alias("s"))))
    return F.when(best["s"].isin(*NAMED_SLABS) & (best["d"] <= SLAB_REACH), best["s"])


#: A rate and an amount as texts print them, a row with two rates and their amounts, and the largest rate.
RATE, AMOUNT, MOST_RATE = r"(\d{1,2}(?:\.\d+)?)\s*%", r"([\d,]+\.\d{2})", 40
TWO_RATES = rf"{RATE}\s+[\d,]+\.\d{{2}}\s+(\d{{1,2}}(?:\.\d+)?)\s*%\s+[\d,]+\.\d{{2}}"


def _lines_with(text: Column, value) -> Column:
    """(low, value) of a text's lines that have a value, in order; each line is read once for all keywords."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r]"), lambda line: F.struct(F.lower(line).alias("low"), value(line).alias("value")))
    return F.filter(lines, lambda x: x["value"].isNotNull())


def _near(lines: Column, keyword: str) -> Column:
    """The value of the first line that names a keyword; null for zero."""
    found = F.get(F.filter(lines, lambda x: F.contains(x["low"], F.lit(keyword))), F.lit(0))["value"]
    return let(found, lambda value: F.when(value != 0, value))


def _by_kind(lines: Column, *rest: Column) -> Column:
    """What the lines say of the whole tax: the integrated one, else both halves or the one that is there, else the rest."""
    halves = F.array(_near(lines, "cgst"), _near(lines, "sgst"))
    return F.coalesce(_near(lines, "igst"), let(halves, lambda h: F.coalesce(h[0] + h[1], h[0], h[1])), *rest)


def tax_rate_near(text: Column) -> Column:
    """The tax rate that a text's lines name: the first percentage, over 0 and up to 40, beside each tax's name."""
    def rate(line: Column) -> Column:
        found = F.regexp_extract(line, RATE, 1).try_cast("double")
        return F.when((found > 0) & (found <= MOST_RATE), found)

    def half(note: Column) -> Column:
        halves = F.zip_with(F.regexp_extract_all(note, F.lit(TWO_RATES), F.lit(1)), F.regexp_extract_all(note, F.lit(TWO_RATES), F.lit(2)), lambda a, b: F.struct(a.try_cast("double").alias("a"), b.try_cast("double").alias("b")))
        even = F.filter(halves, lambda h: (h["a"] == h["b"]) & (h["a"] + h["b"] > 0) & (h["a"] + h["b"] <= MOST_RATE))
        return F.get(even, F.lit(0))["a"] * 2

    return let(text, lambda note: let(_lines_with(note, rate), lambda lines: _by_kind(lines, half(note), _near(lines, "gst"))))


def tax_amount_near(text: Column) -> Column:
    """The tax amount that a text's lines name: the last number with two decimals beside each tax's name."""
    def amount(line: Column) -> Column:
        return number(F.try_element_at(F.regexp_extract_all(line, F.lit(AMOUNT), F.lit(1)), F.lit(-1)))

    return let(_lines_with(text, amount), lambda lines: _by_kind(lines, _near(lines, "gst"), _near(lines, "total tax amount")))


#: What `reconcile_code` says.
REASONS = ("free", "incomplete", "agrees", "amount held tax", "rate held tax", "quantity misread", "rate misread", "discount")


def reconcile_code(quantity: Column, rate: Column, amount: Column, tax: Column) -> Column:
    """Number of the reason (REASONS) that explains a line, by the first check that holds; numbers only, no structs."""
    product = quantity * rate
    near = F.greatest(F.lit(0.5), amount * 0.0005)
    wide = F.greatest(near, amount * 0.001)
    out = F.when((amount == 0) & (rate > 0), 0).when(~F.coalesce((quantity > 0) & (rate > 0) & (amount > 0), F.lit(False)), 1).when(F.abs(product - amount) <= near, 2)
    for slab in (F.when((tax > 0) & (tax <= 40), tax), *map(F.lit, SLABS)):
        factor = 1 + slab / 100
        out = out.when(F.abs(product * factor - amount) <= wide, 3).when(F.abs(product / factor - amount) <= wide, 4)
    whole = F.round(amount / rate)
    misread = (product < 0.98 * amount) & (quantity == 1) & (F.abs(amount / rate - whole) <= 0.005) & whole.between(2, 100)
    return out.when(misread, 5).when(product < 0.98 * amount, 6).otherwise(7)


def reason(code: Column) -> Column:
    """The name of a reason's number."""
    return F.element_at(F.array(*map(F.lit, REASONS)), code + 1)


def reconcile(quantity: Column, rate: Column, amount: Column, tax: Column) -> Column:
    """(quantity, rate, amount, why) of a line after checks against tax-inclusive and misread values.

    Each value is built once, from the reason's number.
    """
    code = reconcile_code(quantity, rate, amount, tax)
    fixed_rate = F.when(code == 0, 0.0).when(code.isin(4, 6), F.round(amount / quantity, 2)).otherwise(rate)
    return F.struct(
        F.when(code == 5, F.round(amount / rate)).otherwise(quantity).alias("quantity"), fixed_rate.alias("rate"),
        F.when(code == 3, F.round(quantity * rate, 2)).otherwise(amount).alias("amount"), reason(code).alias("why"),
    )
