"""Tokenizers and character grams as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns and classes that tokens are defined by (fixed values).
LETTERS = "A-Za-zÁÉÍÓÚÜÑáéíóúüñçàèìòùâêîôûäëïöü"
URL = r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://[a-zA-Z0-9.-]+\.[A-Za-z]{2,}(?::\d{1,5})?(?:/[^\s?#]*)?(?:\?[^\s#]*)?(?:#[^\s]*)?"
WEB_URL = r"(?:https?|ftp)://[a-zA-Z0-9.-]+\.[A-Za-z]{2,}(?::\d{1,5})?(?:/[^\s?#]*)?(?:\?[^\s#]*)?(?:#[^\s]*)?"
EMAIL = r"[a-zA-Z0-9._+-]+@[a-zA-Z0-9.-]+\.[A-Za-z]{2,}"
ACRONYM = r"[A-Za-z]+(?:\.[A-Za-z]+)+\.?"
ABBREVIATION = r"[A-Za-z]{2,}\."
PROPER_NAME = r"[A-Z][a-z]+(?:\s+(?![A-Za-z]{2,}\.)[A-Z][a-z]+)+"
NUMBER = r"\d+(?:[-.,]\d+)*"
RULE_WORDS = {"ascii": "[A-Za-z]+", "apostrophe": "[A-Za-z'áéíóúüñçàèìòùâêîôûäëïöü]+", "accented": "[A-Za-záéíóúüñçàèìòùâêîôûäëïöü]+"}
#: A short stop-word list of the corpus's languages (fixed values); larger lists are read from files.
STOP_WORDS = """a al da das de del della den der des di die do e el en et il in la las le les los o of os que se the to u un una und y""".split()


def _sized(tokens: Column, least: int, most: int) -> Column:
    return F.filter(tokens, lambda t: F.length(t).between(least, most))


def basic_tokens(text: Column, least: int = 1, most: int = 2_000_000_000) -> Column:
    """Letters and digits between white space, everything else deleted, in lower case. NULL gives NULL, an empty text no token."""
    bare = F.regexp_replace(text, r"[^\p{L}\p{N}\s]", "")
    return F.transform(_sized(F.filter(F.split(bare, r"\s+"), lambda t: t != ""), least, most), lambda t: F.lower(t))


def main_tokens(text: Column, least: int = 1, most: int = 20) -> Column:
    """Addresses and e-mails removed, then runs of Latin letters and digits in lower case, of ``least`` to ``most`` characters."""
    # the slow patterns run only on texts that hold their fixed part
    bare = F.when(F.contains(text, F.lit("://")), F.regexp_replace(text, URL, " ")).otherwise(text)
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(bare, EMAIL, " ")).otherwise(bare)
    return _sized(F.transform(F.regexp_extract_all(bare, F.lit(f"([{LETTERS}0-9]+)"), F.lit(0)), lambda t: F.lower(t)), least, most)


def rule_tokens(text: Column, words: str = "ascii") -> Column:
    """Ordered rules, first match wins: address, e-mail, acronym, abbreviation, proper name of several words, number, word (``words``: a key of RULE_WORDS); in lower case."""
    rule = "|".join((WEB_URL, EMAIL, ACRONYM, ABBREVIATION, PROPER_NAME, NUMBER, RULE_WORDS[words]))
    return F.transform(F.regexp_extract_all(text, F.lit(rule), F.lit(0)), lambda t: F.lower(F.trim(t)))


def char_grams(text: Column, w: int) -> Column:
    """Runs of ``w`` characters, white space included, of the text without characters that tell nothing about its language; in lower case."""
    # characters once, then neighbours by position: nothing is computed anew for each gram
    chars = F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_\s¿?¡!']", "")), "")
    chars = F.filter(chars, lambda c: c != "")
    n = F.size(chars) - (w - 1)
    grams = F.slice(chars, F.lit(1), F.greatest(n, F.lit(0)))
    for k in range(1, w):
        grams = F.zip_with(grams, F.slice(chars, F.lit(k + 1), F.greatest(n, F.lit(0))), lambda a, b: F.concat(a, b))
    return grams


def without(tokens: Column, stop_words: list[str]) -> Column:
    """``tokens`` without stop words; for lists that fit in the plan. Larger ones are anti-joined."""
    return tokens if not stop_words else F.filter(tokens, lambda t: ~t.isin(stop_words))
