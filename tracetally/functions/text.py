"""Tokenising and accent folding with built-in string functions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
CHUNK = r'"[^"]*"|[^\s ﻿\p{Z}"]+'


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str]:
    """(from, to) for ``translate``: every letter or digit that decomposes into one base
    character plus combining marks maps to the base; the marks themselves are deleted."""
    source, target, marks = [], [], []
    for cp in range(0x80, min(sys.maxunicode + 1, 0x10000)):
        if 0xAC00 <= cp <= 0xD7A3:  # Hangul syllables decompose into letters, not marks
            continue
        ch = chr(cp)
        if unicodedata.category(ch) == "Mn" and cp < 0x0370:
            marks.append(ch)
            continue
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            source.append(ch)
            target.append(parts[0])
    return "".join(source + marks), "".join(target)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    src, dst = fold_tables()
    return F.translate(F.lower(text), src, dst)


def tokens(text: Column) -> Column:
    """Array of folded words of a text, in order."""
    return F.regexp_extract_all(fold(text), F.lit(f"({WORD})"), F.lit(1))


def phrases(text: Column) -> Column:
    """Array of phrases, each an array of folded words: a quoted run is one phrase, a bare
    chunk is one phrase, chunks without words vanish."""
    chunks = F.regexp_extract_all(fold(text), F.lit(f"({CHUNK})"), F.lit(1))
    words = F.transform(chunks, lambda c: F.regexp_extract_all(c, F.lit(f"({WORD})"), F.lit(1)))
    return F.filter(words, lambda w: F.size(w) > 0)


def to_fixed(x: Column, digits: int) -> Column:
    """Fixed-point text of a double with half-up rounding and no grouping."""
    return F.format_string(f"%.{digits}f", x)
