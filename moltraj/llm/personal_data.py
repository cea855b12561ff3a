"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, scheme separators and identifier cues. From
each anchor a local parser expands to the boundaries of one candidate and validates it. The four base kinds give what a
leftmost, non-overlapping search for their patterns over the whole text gives; a match that fails its check is dropped
and the search goes on behind it. Added kinds: `url` (an address with user information), `iban` (checksum of 97) and
`account` (a number behind a cue such as "account" or "passport"), where they are not part of a base span.

Positions are code points, ends exclusive. Null and empty texts have no spans, repeated rows are handled one by one, an
empty table gives an empty result, other columns of the input are not read.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltraj.llm.shared import arrow_map, table, text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")
#: Cues before an identifier, in lower case.
CUES = ("account", "acct", "passport", "iban", "ssn", "social security", "routing", "customer id", "konto", "compte", "cuenta")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_USER = re.compile(r"://[^\s/@:]+:[^\s/@]+@[^\s/?#]+[^\s]*")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
GAP = re.compile(r"(?: (?:number|no\.?|nr\.?))?[ :=#-]{0,3}", re.IGNORECASE)
ACCOUNT = re.compile(r"(?: ?(?:number|no\.?|nr\.?|id|#))?[ ]?[:=#]?[ ]?([A-Z]{0,2}[0-9](?:[0-9-]{4,18}[0-9]))(?![A-Za-z0-9])", re.IGNORECASE)
DIGITS = frozenset("0123456789")
ASCII_LOWER = {upper: upper + 32 for upper in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def anchor_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for anchor in ["@", "+", "://", *DIGITS, *CUES]:
        automaton.add_word(anchor, "digit" if anchor in DIGITS else anchor)
    automaton.make_automaton()
    return automaton


class Finder:
    """The spans of one text after the other."""

    def __init__(self):
        self.automaton = anchor_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start, then by the order of KINDS."""
        found: list[tuple[int, int, str]] = []
        added: list[tuple[int, int, str]] = []
        behind = dict.fromkeys(BASE, 0)
        for last, anchor in self.automaton.iter(text.translate(ASCII_LOWER)):
            if anchor == "digit":
                if last >= behind["card"]:
                    self.card(text, last, behind, found)
                if last >= behind["ip"] and (last == behind["ip"] or text[last - 1] not in DIGITS):
                    self.ip(text, last, behind, found)
            elif anchor == "@":
                self.email(text, last, behind, found)
            elif anchor == "+":
                if last >= behind["phone"] and (match := PHONE.match(text, last)):
                    behind["phone"] = match.end()
                    if 10 <= sum(c in DIGITS for c in match[0]) <= 15:
                        found.append((last, match.end(), "phone"))
            elif anchor == "://":
                self.url(text, last - 2, added)
            else:
                self.identifier(text, last + 1, added)
        end = at = reach = 0
        base = sorted(found)
        for span in sorted(added):
            # `reach` is the farthest end of the base spans that start no later; one holds the span if it reaches its end.
            while at < len(base) and base[at][0] <= span[0]:
                reach = max(reach, base[at][1])
                at += 1
            if span[0] >= end and span[1] > reach:
                found.append(span)
                end = span[1]
        return sorted(found, key=lambda span: (span[0], KINDS.index(span[2])))

    def email(self, text, at, behind, found):
        start = at
        while start > behind["email"] and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            behind["email"] = domain.end()
            found.append((start, domain.end(), "email"))

    def ip(self, text, at, behind, found):
        if match := IP.match(text, at):
            behind["ip"] = match.end()
            if all(len(part.lstrip("0")) <= 3 and int(part[-3:] if part.lstrip("0") else 0) <= 255 for part in match[0].split(".")):
                found.append((at, match.end(), "ip"))

    def card(self, text, at, behind, found):
        if match := CARD.match(text, at):
            behind["card"] = match.end()
            digits = match[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((at, match.end(), "card"))

    def url(self, text, at, added):
        scheme = SCHEME.search(text, max(0, at - 16), at)
        if scheme and (match := URL_USER.match(text, at)):
            added.append((scheme.start(), match.end(), "url"))

    def identifier(self, text, at, added):
        if match := IBAN.match(text, GAP.match(text, at).end()):
            if iban_holds(match[0]):
                added.append((match.start(), match.end(), "iban"))
                return
        if match := ACCOUNT.match(text, at):
            added.append((*match.span(1), "account"))


_FINDERS: list[Finder] = []


def finder() -> Finder:
    if not _FINDERS:
        _FINDERS.append(Finder())
    return _FINDERS[0]


def personal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and `found`, an array of (kind, start, end), of every row."""
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = finder().spans
        found = [[{"kind": kind, "start": a, "end": b} for a, b, kind in spans(text)] for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span_type)], names=[key, "found"])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, found array<struct<kind:string,start:long,end:long>>"
    return arrow_map(docs.select(F.col(key), text_or_empty(text).alias("_text")), convert, schema)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with each span of `text` replaced by its kind in angle brackets; overlapping spans become one."""
    at, schema = docs.columns.index(text), ", ".join(f"`{name}` {kind}" for name, kind in docs.dtypes)

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, end = [], 0
        for a, b, kind in finder().spans(value):
            if a >= end:
                out += [value[end:a], f"<{kind}>"]
            end = max(end, b)
        return "".join(out) + value[end:]

    def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(at)
        return batch.set_column(at, text, pa.array([clean(value) for value in column.to_pylist()], column.type))

    return arrow_map(docs, convert, schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(*kinds: str) -> Column:
    return F.filter("found", lambda span: span["kind"].isin(*kinds))


def op7_anchor_expansion(spark: SparkSession, sf: str) -> DataFrame:
    found = personal_spans(table(spark, sf, "documents"))
    counts = [F.size(of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = of_kinds(*BASE)
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
