"""Words of a text: maximal runs of Unicode letters and digits, in lower case."""

from __future__ import annotations

import re
import unicodedata

import regex

WORD = re.compile(r"[^\W_]+")
_MARKS = regex.compile(r"\p{M}+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def plain_words(text: str) -> list[str]:
    """Words without accents: compatibility form, combining marks removed."""
    t = text.lower()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t)).lower()
    return WORD.findall(t)
