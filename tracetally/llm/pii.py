"""Personal data: fixed patterns, and offset-preserving deobfuscation for disguised ones.

A chain of transducers rewrites a text and keeps, for every character written, the span of source
characters it stands for: look-alike letters and full-width or styled forms become ASCII, runs of
spelled digits become digits, and written-out "at" and "dot" become ``@`` and ``.``. Identifiers
are detected in the rewritten text and their spans mapped back to source characters. What overlaps
a span found in the source itself is not reported again.

Defined results: null text counts as empty and has no spans; every row gives one row (repeated
rows too); texts are scanned whole; offsets are code points, ends exclusive. An empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import overlaps, per_row, texts

KINDS = ["email", "ip", "card", "phone"]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match can only start where a run of digits does
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost matches, found from each "@": linear also in long runs of name characters."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = emails(text)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small_part, m.group().split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return out


# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕԁԛԝһѵАВЕКМНОРСТУХІЈЅαοΑΒΕΖΗΙΚΜΝΟΡΤΥΧν", "aeopcyxijsdqwhvABEKMHOPCTYXIJSaoABEZHIKMNOPTYXv", strict=True))
# Digits in words.
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

Piece = tuple[int, int, str]  # source span and what stands there


def odd_letters(text: str):
    """Look-alikes, and forms that compatibility decomposition turns into one ASCII character."""
    for m in ODD.finditer(text):
        c = m.group()
        to = LOOKALIKES.get(c) or unicodedata.normalize("NFKC", c)
        if c in INVISIBLE:
            yield m.start(), m.end(), ""
        elif len(to) == 1 and to < "\x7f":
            yield m.start(), m.end(), to


INVISIBLE = "­​‌‍⁠﻿"
ODD = re.compile(f"[{INVISIBLE}Ͱ-ϿЀ-ԯ -⁠⁰-ₜ℀-ⅉ①-⓿。！-～\U0001d400-\U0001d7ff]")
SPELLED = re.compile(r"(?ai)(?<![a-z])(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9])(?:[\x20,-]{1,2}(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|[0-9]))+(?![a-z])")
SPELLED_WORD = re.compile(r"(?ai)(?:(?<=[a-z])[\x20,-]+(?=[a-z0-9])|(?<=[0-9])[\x20,-]+(?=[a-z]))|zero|oh|one|two|three|four|five|six|seven|eight|nine")
PLUS = re.compile(r"(?ai)(?<![a-z])plus\x20(?=[0-9])")
AT = re.compile(r"(?ai)(?:(?<!\x20)\x20+)?[\[({<]\x20*(?:at|@|arroba)\x20*[\])}>]\x20*")
DOT = re.compile(r"(?ai)(?:(?<!\x20)\x20+)?[\[({<]\x20*(?:dot|punto|point|punkt|\.)\x20*[\])}>]\x20*")
# bare words only together: name at host dot end
BARE = re.compile(r"(?ai)(?<=[a-z0-9])\x20+at\x20+(?=(?!dot\b)[a-z0-9-]+(?:(?:\x20+dot\x20+|\.)(?!dot\b)[a-z0-9-]+)*\x20+dot\x20+(?!dot\b)[a-z]{2,})")
BARE_DOT = re.compile(r"(?ai)(?<=[a-z0-9])\x20+dot\x20+(?=[a-z0-9])")


def spelled(text: str):
    """Runs of three or more digits of which at least two are words."""
    for m in SPELLED.finditer(text):
        words = [w for w in re.split(r"[\x20,-]+", m.group().lower()) if w]
        if len(words) >= 3 and sum(w in DIGITS for w in words) >= 2:
            for p in SPELLED_WORD.finditer(text, m.start(), m.end()):
                yield p.start(), p.end(), DIGITS.get(p.group().lower(), "")


def disguises(text: str):
    found = [(*m.span(), "@") for m in AT.finditer(text)] + [(*m.span(), ".") for m in DOT.finditer(text)] + [(*m.span(), "+") for m in PLUS.finditer(text)]
    low = text.lower()
    if " dot " in low:
        for m in BARE.finditer(text):
            found.append((*m.span(), "@"))
            pos = m.end()
            while d := re.compile(r"(?ai)[a-z0-9.-]+(\x20+dot\x20+)(?=[a-z0-9])").match(text, pos):
                found.append((*d.span(1), "."))
                pos = d.end()
            start = m.start()  # name parts before: john dot doe at ...
            while b := re.search(r"(?ai)(?<=[a-z0-9])(\x20+dot\x20+)[a-z0-9._%+-]+\Z", text[max(0, start - 80) : start]):
                at = max(0, start - 80)
                found.append((at + b.start(1), at + b.end(1), "."))
                start = at + b.start(1)
    last = -1
    for s, e, to in sorted(set(found)):
        if s >= last:
            yield s, e, to
            last = e


class Rewritten:
    """A text after a transducer, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.starts, self.shift, self.stops = text, [0], [0], []

    def apply(self, transducer) -> Rewritten:
        pieces = list(transducer(self.text))
        if not pieces:
            return self
        out, parts, pos, size = Chained(self), [], 0, 0
        for s, e, to in pieces:
            parts += [self.text[pos:s], to]
            out.segment(size, pos, s - pos)
            size += s - pos
            if to:
                out.segment(size, s, e - s, len(to))
                size += len(to)
            pos = e
        parts.append(self.text[pos:])
        out.segment(size, pos, len(self.text) - pos)
        out.text = "".join(parts)
        return out

    def source(self, start: int, end: int) -> tuple[int, int]:
        return start, end


class Chained(Rewritten):
    """Segments (place here, place before, length before); a rewritten one maps as a whole."""

    def __init__(self, before: Rewritten):
        self.before, self.at, self.segments, self.text = before, [], [], ""

    def segment(self, at: int, source: int, length: int, written: int = 0) -> None:
        if length:
            self.at.append(at)
            self.segments.append((source, length, written))

    def _one(self, i: int) -> tuple[int, int]:
        k = bisect_right(self.at, i) - 1
        source, length, written = self.segments[k]
        return (source, source + length) if written else (source + i - self.at[k], source + i - self.at[k] + 1)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.before.source(self._one(start)[0], self._one(end - 1)[1])


# every text that one of the transducers below can change has a match
HINT = re.compile(r"(?ai)[\[({<]\x20*(?:at|dot|@|\.|arroba|punto|point|punkt)\x20*[\])}>]|\x20dot\x20|(?<![a-z])(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)[\x20,-]|(?<![a-z])plus\x20[0-9]")


def hidden_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    now = Rewritten(text)
    if not text.isascii():
        now = now.apply(odd_letters)
    if HINT.search(now.text):
        now = now.apply(spelled).apply(disguises)
    if type(now) is Rewritten:
        return []
    taken, out = overlaps([(s, e) for _, s, e in base]), []
    for k, a, b in base_spans(now.text):
        s, e = now.source(a, b)
        if not taken(s, e):
            out.append((k, s, e))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every row."""
    docs = texts(docs, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        def one(doc_id, text):
            base = base_spans(text)
            spans = [(k, s, e, True) for k, s, e in base] + [(k, s, e, False) for k, s, e in hidden_spans(text, base)]
            return [(doc_id, [dict(zip(("kind", "start", "end", "base"), x)) for x in spans])]

        return one

    return per_row(docs, make, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def counted(kind: str):
    return F.size(F.filter("spans", lambda s: (s["kind"] == kind) & s["base"])).cast("long")
