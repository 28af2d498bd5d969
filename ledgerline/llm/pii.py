"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Each pattern runs in time linear in the text: the quantifiers are possessive,
digit runs are entered only at their start, and an email is found from its
``@`` outwards, so a text of one endless word costs no more than prose.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import narrow

#: The order in which spans that start at one place are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("iban", "ssn")

# fixed values: character classes and patterns of the span kinds
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "transfer"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}

#: Score before context: what a pattern alone, or with its checksum, is worth.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
CONTEXT_BONUS = 0.2
#: Code points on either side in which a context word counts.
CONTEXT_WIDTH = 40
#: Kinds outside the base are reported from this score on.
MIN_SCORE = 0.6
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    """The Luhn checksum of a digit string."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """The mod-97 check of an account number (first four characters moved to the end, letters as 10 to 35)."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        before = text[end:at]
        start = at - (len(before) - len(before.rstrip(LOCAL)))
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        end = found.end() if found else at + 1  # no address reaches back over an @
        at = text.find("@", end)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        code = m[0].replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield m.span()


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the spans that their checks confirm; starts and ends in code points."""
    if "@" in text:
        yield from (("email", s, e) for s, e in _emails(text))
    yield from (("ip", *m.span()) for m in IP.finditer(text) if all(map(_octet, m[0].split("."))))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield ("card", *m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                yield ("phone", *m.span())
    yield from (("iban", s, e) for s, e in _ibans(text))
    if "-" in text:
        yield from (("ssn", *m.span()) for m in SSN.finditer(text))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """Spans by start, then kind as listed in ``KINDS``, with scores; kinds outside the base need ``MIN_SCORE``."""
    out = []
    for kind, start, end in proposals(text):
        near = text[max(0, start - CONTEXT_WIDTH):start] + " " + text[end:end + CONTEXT_WIDTH]
        words = {w.lower() for w in _WORD.findall(near)}
        score = min(1.0, PRIOR[kind] + CONTEXT_BONUS * any(w in words for w in CONTEXT[kind]))
        if kind in BASE_KINDS or score >= MIN_SCORE:
            out.append((kind, start, end, round(score, 2)))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def redact_text(text: str) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first to start counts."""
    out, at = [], 0
    for kind, start, end, _ in find_spans(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        elif end <= at:
            continue
        at = max(at, end)
    return "".join(out) + text[at:] if out else text


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t.as_py())]
                 for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(_SPAN))],
                                         names=["doc_id", "spans"])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end, score) for every row of ``docs``.

    A null or empty text has no spans; repeated rows are reported each; an
    empty table gives no rows; further columns are ignored.
    """
    return narrow(docs, id_col, text_col).mapInArrow(
        _find, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its spans replaced in ``text_col``; all rows and other columns stay, null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            clean = [None if t is None else redact_text(t) for t in (x.as_py() for x in batch.column(i))]
            yield batch.set_column(i, batch.schema.field(i), pa.array(clean, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


def span_list(spans, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of the spans of the given kinds, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
