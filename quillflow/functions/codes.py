"""Codes in free text as column expressions: order numbers, tax ids, vendor codes, folder names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillflow.functions import fuzzy
from quillflow.functions.text import CODE_GROUPS, let

#: The order number is SPRPUR/yyyy/mm/dd-serial, its S also read as 5, with blanks anywhere between its parts.
PREFIX, PREFIX_WORD, PREFIX_RATIO = "[S5]PRPUR", "SPRPUR", 0.6
_DATE = r"\s*/\s*\d{4}\s*/\s*\d{2}\s*/\s*(\d{2})\s*-"
STRICT = rf"(?i)({PREFIX}{_DATE}\s*(\d{{4,6}}))((\d{{0,2}})-[A-Za-z]{{3}}-\d{{2}}\b)?"
ANCHOR = rf"(?i)({PREFIX}{_DATE})"
LOOSE = rf"(?i)({PREFIX}\s*/\s*[A-Za-z0-9]{{1,6}}\s*/\s*[A-Za-z0-9]{{1,4}}\s*/\s*[A-Za-z0-9]{{1,4}}\s*-\s*[A-Za-z0-9]{{1,8}})"
MISSPELT = r"(?<![A-Za-z0-9])([A-Za-z0-9]{4,8})\s*[/\\-]\s*\d{4}\s*[/\\-]\s*\d{2}\s*[/\\-]\s*\d{2}\s*[-–]\s*\d{4,6}(?!\d)"
#: A tax id, whose 14th character is Z also where it reads as 2, and its part behind the two-digit state code.
TAX_ID = r"\b(\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9][Z2][A-Z0-9])\b"
TAX_CORE = r"[A-Z]{5}\d{4}[A-Z][A-Z0-9][Z2][A-Z0-9]"
#: The zone of each first digit of a PIN, from 1.
PIN_ZONES = ("NORTH", "NORTH", "CENTRE", "WEST", "SOUTH", "SOUTH", "EAST", "EAST", "ARMY")


def _answer(value: Column, confidence: str) -> Column:
    """(value, confidence) with the value's blanks taken out and in upper case; null for no value."""
    shown = F.upper(F.regexp_replace(value, r"\s+", ""))
    return F.when(value.isNotNull() & (value != ""), F.struct(shown.alias("value"), F.lit(confidence).alias("confidence")))


def order_number(text: Column) -> Column:
    """(value, confidence) of the first order number: `confident`, `doubtful` or `none`.

    Confident: the whole number, whose serial gives back the digits of a date glued to it if they then name the
    number's own day; or its beginning, whose serial then stands behind blanks on the same line or is the last one
    of the next line. Doubtful: the same shape of letters and digits, or a first word that resembles the prefix.
    """
    whole = F.regexp_extract(text, STRICT, 0)
    token, day, serial, tail, left = (F.regexp_extract(whole, STRICT, k) for k in range(1, 6))
    missing = 2 - F.length(left)
    glued = (tail != "") & (missing > 0) & (missing <= F.length(serial) - 4) & (F.concat(F.right(serial, missing), left) == day)
    strict = F.when(glued, F.left(token, F.length(token) - missing)).otherwise(token)

    lines = F.split(F.regexp_extract(text, f"(?s){ANCHOR}(.*)", 3), "\n", 3)
    same = F.regexp_extract(F.get(lines, F.lit(0)), r"^\s*(\d{4,6})\b", 1)
    below = F.regexp_extract_all(F.get(lines, F.lit(1)), F.lit(r"(\d{4,6})"), F.lit(1))
    found = F.coalesce(F.nullif(same, F.lit("")), F.when(F.size(below) > 0, F.element_at(below, -1)))
    anchored = F.concat(F.regexp_extract(text, ANCHOR, 1), found)

    loose = F.regexp_extract(text, LOOSE, 1)
    rest = F.when((whole == "") & anchored.isNull() & (loose == ""), text)  # others aren't worth the comparison
    words = F.regexp_extract_all(F.upper(rest), F.lit(MISSPELT), F.lit(1))
    at = fuzzy.first_like(words, PREFIX_WORD, PREFIX_RATIO)
    misspelt = F.get(F.regexp_extract_all(rest, F.lit(MISSPELT), F.lit(0)), at)
    none = F.struct(F.lit("").alias("value"), F.lit("none").alias("confidence"))
    return F.coalesce(_answer(strict, "confident"), _answer(anchored, "confident"), _answer(loose, "doubtful"), _answer(misspelt, "doubtful"), none)


def strip_prefix(value: Column) -> Column:
    """An order number without its prefix."""
    return F.regexp_replace(value, f"(?i)^{PREFIX}/?", "")


def tax_id(text: Column) -> Column:
    """The first tax id of a text as it stands, else with its blanks left out, else its core with the first two digits
    that stand apart from it; its 14th character is Z. Blank if there is none."""
    whole = F.coalesce(F.nullif(F.regexp_extract(text, TAX_ID, 1), F.lit("")), F.nullif(F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), TAX_ID, 1), F.lit("")))
    signs = F.replace(F.replace(F.regexp_replace(F.upper(text), "[^A-Z0-9]", ""), F.lit("GSTIN"), F.lit("")), F.lit("UIN"), F.lit(""))
    core = F.regexp_extract(signs, f"({TAX_CORE})", 1)
    state = F.regexp_extract(F.replace(signs, core, F.lit("")), r"(\d{2})", 1)
    put = lambda v, at: F.concat(F.left(v, F.lit(at - 1)), F.lit("Z"), F.substring(v, at + 1, 15))
    return F.coalesce(put(whole, 14), F.when(core != "", F.concat(state, put(core, 12))), F.lit(""))


def canonical_group(value: Column) -> Column:
    """Upper case with each character of a confusable group as the group's first."""
    return F.translate(F.upper(value), "".join(CODE_GROUPS), "".join(g[0] * len(g) for g in CODE_GROUPS))


def _in_order(part: Column, word: Column) -> Column:
    """Whether the three characters of `part` stand in `word` in that order, the first one first; canonical forms."""
    c = [F.substring(part, k, 1) for k in (1, 2, 3)]
    second = F.instr(F.substring(word, 2, 1000), c[1])
    third = F.instr(F.substr(word, second + 2, F.lit(1000)), c[2])
    return (F.length(part) == 3) & (F.left(word, F.lit(1)) == c[0]) & (second > 0) & (third > 0)


def vendor_code(raw: Column, name: Column) -> Column:
    """(code, confidence) of a misread vendor code, put right by what its letters should be by the vendor's name.

    Heads that the name allows: its first word; that word's three letters with any three or more of the second or
    third word; the longest beginning that the reading shares with the first word; the reading's own six characters if
    they stand in the words in order. The head with the least share of differing characters (confusable ones don't
    differ) wins, the longest of equals; only one without any is used. What follows must be digits, confusable
    characters standing for theirs. `confident` if both hold, else `doubtful`; `none` for a blank reading.
    """
    canon = canonical_group
    clean = F.regexp_replace(raw, r"^\s*[1:;]\s+", "")  # a label's colon read as a sign of its own
    words = F.filter(F.transform(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("([A-Za-z]+)"), F.lit(1)), F.upper), lambda w: F.length(w) >= 3)
    given = let(clean, lambda c: F.struct(c.alias("clean"), F.upper(F.regexp_replace(c, r"\s+", "")).alias("read"), words.alias("words")))

    def parts(g: Column) -> Column:
        first = F.coalesce(F.get(g["words"], F.lit(0)), F.lit(""))
        return let(first, lambda f: F.struct(
            g["clean"].alias("clean"), g["read"].alias("read"), canon(g["read"]).alias("signs"), f.alias("first"), canon(f).alias("begin"), F.slice(g["words"], 2, 2).alias("more")))

    def heads_of(p: Column) -> Column:
        joined = F.flatten(F.transform(p["more"], lambda w: F.transform(F.sequence(F.lit(3), F.length(w)), lambda n: F.concat(F.left(p["first"], F.lit(3)), F.left(w, n)))))
        alike = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.length(p["read"]), F.length(p["first"])), F.lit(1))), lambda n: F.left(p["signs"], n) == F.left(p["begin"], n))
        shared = let(F.coalesce(F.array_max(alike), F.lit(0)), lambda n: F.when(n >= 3, F.left(p["first"], n)).otherwise(""))
        six = F.left(p["signs"], F.lit(6))
        own = (F.length(p["read"]) >= 6) & _in_order(F.left(six, F.lit(3)), p["begin"]) & F.exists(p["more"], lambda w: _in_order(F.substring(six, 4, 3), canon(w)))
        heads = F.concat(F.array(p["first"]), joined, F.array(shared), F.array(F.when(own, F.left(p["read"], F.lit(6))).otherwise("")))
        return F.filter(heads, lambda h: (h != "") & (F.length(h) <= F.length(p["read"])))

    def scored(p: Column, h: Column, place: Column) -> Column:
        pairs = F.zip_with(F.split(F.left(p["signs"], F.length(h)), ""), F.split(canon(h), ""), lambda x, y: F.when(x == y, 0).otherwise(1))
        return F.struct((F.aggregate(pairs, F.lit(0), lambda x, y: x + y) / F.length(h)).alias("miss"), (-F.length(h)).alias("size"), place.alias("place"), h.alias("head"))

    answer = lambda v, c: F.struct(v.alias("code"), c.alias("confidence"))

    def settled(p: Column, best: Column) -> Column:
        sure = F.coalesce(best["miss"] == 0, F.lit(False))
        headed = F.struct(sure.alias("sure"), F.when(sure, best["head"]).otherwise(F.left(p["read"], F.lit(6))).alias("head"))

        def tailed(h: Column) -> Column:
            tail = F.substr(p["signs"], F.length(h["head"]) + 1, F.lit(1000))
            return let(tail, lambda t: answer(F.concat(h["head"], F.regexp_replace(t, "[^0-9]", "")), F.when(h["sure"] & F.rlike(t, F.lit("^[0-9]+$")), "confident").otherwise("doubtful")))

        return let(headed, tailed)

    def code(p: Column) -> Column:
        fixed = let(F.array_min(F.transform(heads_of(p), lambda h, place: scored(p, h, place))), lambda best: settled(p, best))
        blank = F.coalesce(F.trim(F.regexp_replace(raw, r"\s+", "")) == "", F.lit(True))
        return F.when(blank, answer(F.lit(""), F.lit("none"))).when(F.length(p["read"]) < 4, answer(F.trim(p["clean"]), F.lit("doubtful"))).otherwise(fixed)

    return let(let(given, parts), code)


def word_grams(words: Column, n: int) -> Column:
    """Each n words in a row, joined by spaces."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def folder_name(value: Column) -> Column:
    """A name that can be a folder: forbidden characters as underscores, no dots or blanks at its ends, never blank."""
    clean = F.regexp_replace(F.regexp_replace(value, r'[<>:"/\\|?*]+', "_"), r"^[. ]+|[. ]+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "Unknown").otherwise(clean)
