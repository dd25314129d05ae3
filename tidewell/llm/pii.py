"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers expand and check each one.

Anchors: the at-sign (email), schemes (``mailto:``, ``tel:``, ``://`` for user data in an address), digits after a dot (ip),
digits (card), a plus before a digit (phone) and words that announce an identifier (account). Each parser reads only the
neighbourhood of its anchor, left and right, and decides alone; spans of a kind never overlap, and an anchor that lies in
text which its kind has used is passed over.

Base kinds (contract): ``email``, ``ip``, ``card``, ``phone``.  Added kinds: ``login`` (user data before the host of an
address), ``iban`` (country, check digits, remainder test 97), ``account`` (a number of 6 or more digits, letters and
separators after a cue such as ``account no`` or ``ssn``).

Defined results: a null text is empty; an empty text has no span; repeated rows give a row each; extra columns are left alone;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import as_digest, map_rows, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "iban", "account")
# fixed values: cues of account numbers, in lower case
CUES = (
    "account number", "account no", "account id", "acct", "iban", "passport", "ssn", "social security", "tax id",
    "customer number", "member id", "licence number", "license number",
)
FOUND = "spans array<struct<kind:string,start:int,end:int>>"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


class Parsers:
    """One parser per kind: (text, anchor, first free place) to (span or None, place up to which the text is used)."""

    def __init__(self) -> None:
        self.domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
        self.quad = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
        self.run = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
        self.plus = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
        self.host = re.compile(r"[^\s/?#@:]+(?::[^\s/?#@]*)?@")
        self.iban_body = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
        self.number = re.compile(r"[\x20:#.]{0,4}(?:is\x20)?([A-Z]{0,3}[0-9][0-9A-Z-]{4,}[0-9])(?![A-Za-z0-9])")

    def email(self, text: str, at: int, free: int) -> tuple[Span | None, int]:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = self.domain.match(text, at + 1) if start < at else None
        return ((start, domain.end()), domain.end()) if domain else (None, free)

    def ip(self, text: str, dot: int, free: int) -> tuple[Span | None, int]:
        start = dot
        while start > free and text[start - 1] in DIGITS:
            start -= 1
        m = self.quad.match(text, start) if start < dot else None
        if not m:
            return None, free
        parts = [p.lstrip("0") for p in m.group().split(".")]
        good = all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
        return (m.span() if good else None), m.end()

    def card(self, text: str, digit: int, free: int) -> tuple[Span | None, int]:
        m = self.run.match(text, digit)
        if not m:
            return None, digit + 1
        digits = m.group().replace(" ", "").replace("-", "")
        return (m.span() if 16 <= len(digits) <= 19 and luhn(digits) else None), m.end()

    def phone(self, text: str, plus: int, free: int) -> tuple[Span | None, int]:
        m = self.plus.match(text, plus)
        if not m:
            return None, free
        count = sum(c in DIGITS for c in m.group())
        return (m.span() if 8 <= count <= 15 else None), m.end()

    def login(self, text: str, scheme: int, free: int) -> tuple[Span | None, int]:
        m = self.host.match(text, scheme + 3)
        return ((m.start(), m.end() - 1), m.end()) if m else (None, free)

    def iban(self, text: str, cue: int, free: int) -> tuple[Span | None, int]:
        for m in self.iban_body.finditer(text, cue, min(len(text), cue + 64)):
            if 15 <= len(plain := m.group().replace(" ", "")) <= 34 and mod97(plain):
                return m.span(), m.end()
        return None, free

    def account(self, text: str, end: int, free: int) -> tuple[Span | None, int]:
        m = self.number.match(text, end)
        return (m.span(1), m.end()) if m else (None, free)


def _scan(rows: Iterator[tuple]) -> Iterator[tuple]:
    import ahocorasick

    anchors = ahocorasick.Automaton()
    anchors.add_word("@", ("email",))
    anchors.add_word("://", ("login",))
    for digit in "0123456789":
        anchors.add_word(digit, ("card",))
        anchors.add_word("." + digit, ("ip",))
        anchors.add_word("+" + digit, ("phone",))
    for cue in CUES:
        anchors.add_word(cue, ("iban", "account") if cue == "iban" else ("account",))
    anchors.make_automaton()
    parsers = Parsers()
    parse = {kind: getattr(parsers, kind) for kind in KINDS}
    back = {"email": 0, "ip": 1, "card": 0, "phone": 1, "login": 2, "iban": 0, "account": -1}
    lower = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

    for *key, text in rows:
        text = text or ""
        free = dict.fromkeys(KINDS, 0)
        found = {kind: [] for kind in KINDS}
        # as many code points as the text has; other alphabets need no folding for these cues
        low = text.lower() if text.isascii() else text.translate(lower)
        for end, kinds in anchors.iter(low):
            for kind in kinds:
                at = end - back[kind]
                if at < free[kind]:
                    continue
                span, free[kind] = parse[kind](text, at, free[kind])
                if span:
                    found[kind].append(span)
        yield (*key, [{"kind": kind, "start": a, "end": b} for kind in KINDS for a, b in sorted(found[kind])])


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans`` (kind, start, end in code points; kinds in their order, then by start) for every row."""
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    return written(map_rows(rows, f"`{key}` {rows.schema[0].dataType.simpleString()}, {FOUND}", _scan), "personal-data")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base kinds, and all spans as text."""
    found = find_personal_data(docs)
    written = lambda spans: F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(list(BASE)))
    return found.select(
        "doc_id", *counts, as_digest(written(base)).alias("base_sha256"), F.array_join(written(F.col("spans")), ",").alias("spans"))
