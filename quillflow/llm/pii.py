"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds (leftmost, non-overlapping per kind; failing matches are dropped): email, ip (parts at
most 255), card (12 to 19 digits, Luhn), phone (9 to 15 digits). Added kinds: iban (mod 97 is 1),
id_number (7 to 12 digits near an identity word) and secret (a value of 16 characters or more assigned to
a key's name, confirmed by letters, digits and `VARIETY` different characters). Base spans always stay;
an added span is reported when its score, moved by context words within `WINDOW` characters, reaches
`MIN_SCORE`.

Positions are code points, ends exclusive. Every text is read whole. Defined cases: a null or empty
text has no spans; repeated rows are each scanned; spans of different kinds at one place (ties) go in the
order of the kinds; an empty table gives no rows; other columns are ignored; very long runs of digits or
letters are scanned in linear time (each pattern starts only where its run starts).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quillflow.llm.common import arrow_batches, texts

KINDS = ("email", "ip", "card", "phone", "iban", "id_number", "secret")
BASE = KINDS[:4]
WINDOW = 40
MIN_SCORE = 0.5
VARIETY = 8

# Words whose nearness raises or lowers the score of a kind.
RAISES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "id_number": ("passport", "ssn", "social security", "tax id", "ausweis", "passeport", "pasaporte", "dni"),
    "secret": ("auth", "credential", "bearer"),
}
LOWERS = {
    "email": ("example",),
    "ip": ("version", "release", "section"),
    "card": ("order", "invoice", "isbn", "serial"),
    "phone": ("version", "order"),
    "iban": ("sample",),
    "id_number": ("order", "invoice", "version", "page"),
    "secret": ("example", "placeholder", "dummy"),
}
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "id_number": 0.2, "secret": 0.7}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ID = re.compile(r"(?<![A-Za-z0-9])[0-9]{7,12}(?![A-Za-z0-9])")
_SECRET = re.compile(
    r"(?i)(?<![a-z])(?:token|secret|passwd|password|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?[\x20\t]{0,9}[:=][\x20\t]{0,9}[\"']?([a-z0-9+/_.=-]{16,})"
)
_HINT = re.compile(r"[0-9@]")

SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of account numbers: first four characters moved to the end, letters as 10 to 35."""
    rest = 0
    for c in account[4:] + account[:4]:
        d = int(c, 36)
        rest = (rest * (100 if d > 9 else 10) + d) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        low = found.end() if found else at + 1
        if found:
            yield start, low
        at = text.find("@", low)


def _digits(value: str) -> str:
    return re.sub("[^0-9]", "", value)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(y := x.lstrip("0")) < 4 and int(y or "0") < 256 for x in m.groups()):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if 15 <= len(a := m[0].replace(" ", "")) <= 34 and mod97(a):
            yield "iban", m.start(), m.end()
    for m in _ID.finditer(text):
        yield "id_number", m.start(), m.end()
    for m in _SECRET.finditer(text):
        if len(set(m[1])) >= VARIETY and re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]):
            yield "secret", m.start(1), m.end(1)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed; base spans and accepted added ones."""
    if not _HINT.search(text):
        return []
    out = []
    for kind, start, end in _proposed(text):
        near = (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()
        score = START[kind] + 0.35 * any(w in near for w in RAISES[kind]) - 0.3 * any(w in near for w in LOWERS[kind])
        if kind in BASE or score >= MIN_SCORE:
            out.append((kind, start, end, round(min(1.0, max(0.0, score)), 2)))
    return sorted(_apart(out), key=lambda x: (x[1], KINDS.index(x[0])))


def _apart(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """The spans without the identity numbers that overlap one of another kind, in one sweep over the sorted spans."""
    starts, reach = [], []  # of the others, and the furthest end so far
    for _, start, end, _ in sorted((x for x in spans if x[0] != "id_number"), key=lambda x: x[1]):
        starts.append(start)
        reach.append(max(end, reach[-1]) if reach else end)

    def clear(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return not k or reach[k - 1] <= start

    return [x for x in spans if x[0] != "id_number" or clear(x[1], x[2])]


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per document with all its spans: kind, start, end, score."""
    arrow_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in find_spans(t)]
                for t in texts(batch).to_pylist()
            ]
            ids = batch.column("doc_id").cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, SPANS)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; overlaps merge."""
    arrow_batches(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, low = [], 0
        for kind, start, end, _ in find_spans(text):
            if start >= low:
                out += [text[low:start], f"<{kind.upper()}>"]
            low = max(low, end)
        return "".join([*out, text[low:]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(map(clean, batch.column(at).to_pylist()), batch.schema.field(at).type))

    return docs.mapInArrow(apply, docs.schema)


def spans_text(spans: list[tuple[str, int, int, float]]) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)


def base_digest(spans: list[tuple[str, int, int, float]]) -> str:
    """SHA-256 of the base spans as text."""
    return hashlib.sha256(spans_text([x for x in spans if x[0] in BASE]).encode()).hexdigest()
