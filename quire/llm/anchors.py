"""Personal data by anchor expansion.

One Aho-Corasick pass over the whole text finds anchors: at-signs, plus signs, digits, schemes and
cue words. From each anchor a local parser walks to the boundaries of an email, address, card,
phone or account and validates it; text without anchors is never looked at again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
# the method's own: a credential after a cue, and a link that carries a login
KINDS = (*BASE_KINDS, "account", "url")
SPANS = "array<struct<kind:string,start:int,end:int>>"

# The grammar of the base kinds
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# everything an address or card can consist of
NUMBER_RUN = re.compile(r"[0-9 .-]+")

CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")
CUE_VALUE = re.compile(r"""\s{0,3}[:=]\s{0,3}(["']?)([A-Za-z0-9+/_.~-]{8,})\1""")
KEY_PREFIX = "AKIA"
KEY_TAIL = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("number", 1))
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize()):
            found.add_word(form, ("account", len(form)))
    found.add_word(KEY_PREFIX, ("key", len(KEY_PREFIX)))
    for scheme in SCHEMES:
        found.add_word(scheme, ("url", len(scheme)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _numbers(text: str, start: int, stop: int) -> Iterator[tuple[str, int, int]]:
    for m in IP.finditer(text, start, stop):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text, start, stop):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in `KINDS`, then start; null has none."""
    spans: list[tuple[str, int, int]] = []
    mail_end = number_end = account_end = url_end = 0
    for last, (anchor, width) in _automaton().iter(text or ""):
        at, after = last - width + 1, last + 1
        if anchor == "number":
            if at >= number_end:
                number_end = NUMBER_RUN.match(text, at).end()
                spans += _numbers(text, at, number_end)
        elif anchor == "email":
            start = at
            while start > mail_end and text[start - 1] in LOCAL:
                start -= 1
            domain = DOMAIN.match(text, after) if start < at else None
            if domain:
                mail_end = domain.end()
                spans.append(("email", start, mail_end))
        elif anchor == "phone":
            m = PHONE.match(text, at)
            if m and 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append(("phone", at, m.end()))
        elif anchor == "account":
            m = CUE_VALUE.match(text, after)
            if m and at >= account_end and any(c.isdigit() for c in m.group(2)):
                account_end = m.end()
                spans.append(("account", *m.span(2)))
        elif anchor == "key":
            m = KEY_TAIL.match(text, after)
            if m and at >= account_end and not (at and text[at - 1].isalnum()):
                account_end = m.end()
                spans.append(("account", at, m.end()))
        elif at >= url_end:
            m = LOGIN.match(text, after)
            if m:
                url_end = m.end()
                spans.append(("url", at, url_end))
    order = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (order[s[0]], s[1]))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """`text` with each span replaced by its kind in brackets; overlapping spans become one."""
    parts, at, name = [], 0, ""
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start < at and name:
            at = max(at, end)
            continue
        parts += [text[at:start], f"[{kind.upper()}]"]
        at, name = end, kind
    return "".join([*parts, text[at:]])


def spans_column(text: Column) -> Column:
    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t)] for t in texts], dtype=object)

    return run(text)


def masked_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else mask(t, find_spans(t)) for t in texts], dtype=object)

    return run(text)


def listed(spans: Column) -> Column:
    """The spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus `spans`, an array of (kind, start, end); a null or empty text has an empty one.
    A column of that name gives way; all rows stay, repeated ones too."""
    return docs.withColumn("spans", spans_column(F.col(text)))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with personal data in `text` replaced by [EMAIL], [IP] and so on; null stays null."""
    return docs.withColumn(text, masked_column(F.col(text)))
