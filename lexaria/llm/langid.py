"""Languages of documents and of their paragraphs, by rank-order profiles of character trigrams."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Usual spellings of labels: ISO 639 codes and names in English, in the language itself and in Spanish (fixed values).
LABELS = {
    "es": "es spa esp spanish español espanol castellano castilian",
    "en": "en eng english inglés ingles",
    "fr": "fr fra fre french français francais francés frances",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues portugués",
    "de": "de deu ger german deutsch alemán aleman",
}
_OTHER, _DROP = 27, 255


def _letters() -> np.ndarray:
    """Code of each character below U+3000: base letter a-z 1-26, another letter 27, a combining mark 255, anything else 0."""
    out = np.zeros(0x3000, dtype=np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind[0] == "M":
            out[cp] = _DROP
        elif kind[0] == "L":
            base = unicodedata.normalize("NFKD", c.lower())[0]
            base = {"ß": "s", "œ": "o", "æ": "a", "ø": "o", "ł": "l", "đ": "d"}.get(base, base)
            out[cp] = ord(base) - 96 if "a" <= base <= "z" else _OTHER
    return out


LETTERS = _letters()
GRAMS = 28**3
#: What isn't running text: code, formulas, tags, commands, addresses, templates, and quotations of up to 80 characters.
_NOT_TEXT = re.compile(
    r"```.*?```|~~~.*?~~~|<(pre|code|syntaxhighlight|math|script|style)\b.*?</\1\s*>|\\begin\{(verbatim|lstlisting|equation\*?|align\*?|displaymath)\}.*?\\end\{\2\}"
    r"|\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]{1,200}\$|`[^`\n]+`|^(?: {4}|\t)[^\n]*$|<!--.*?-->|<[^<>\n]{1,300}>|\{\{[^{}]*\}\}|\{\|.*?\|\}|\]\([^)\s]*\)"
    r"|\\(?:label|ref|cite|includegraphics|documentclass|usepackage|begin|end)\b\*?(?:\[[^\]]*\])?\{[^{}]*\}|\\[a-zA-Z]+\*?|\w+://\S+|\S+@\S+\.\S+|&#?\w+;"
    r"|«[^«»\n]{1,80}»|“[^“”\n]{1,80}”|\"[^\"\n]{1,80}\"|„[^„“\n]{1,80}“",
    re.S | re.M | re.I,
)
#: A capitalised word inside a sentence, mostly a name; it doesn't count unless the whole text is in capitals.
_NAME = re.compile(r"(?<=[a-z,;:àáâãçéêíñóôõúü] )[A-ZÁÉÍÓÚÑÜÇ][\w'’-]+")


def running_text(text: str) -> str:
    """``text`` with everything that isn't running text blanked; line breaks stay."""
    if re.search(r"[<`$\\{&@]|://|\t|^ {4}|[«“\"„]|~~~", text, re.M):
        text = _NOT_TEXT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    return text


class Profiles:
    """Ranks of the most frequent trigrams of each language; trained on a small table of lines (fixed size, so it may come to the driver)."""

    def __init__(self, lines: Mapping[str, list[str]], size: int = 3000, own: int = 400):
        self.langs = sorted(lines)
        self.size, self.own = size, own
        self.ranks = np.full((len(self.langs), GRAMS), size, dtype=np.int32)
        for i, lang in enumerate(self.langs):
            grams, count = np.unique(_grams([" ".join(lines[lang])])[1], return_counts=True)
            order = np.lexsort((grams, -count))[:size]
            self.ranks[i, grams[order]] = np.arange(len(order))

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean out-of-place distance of each text's most frequent trigrams to each language (0 best, 1 none known; NaN without letters), and its number of letters."""
        out = np.full((len(texts), len(self.langs)), np.nan)
        owner, grams, letters = _grams(texts)
        if not len(grams):
            return out, letters
        key = np.sort(owner * GRAMS + grams)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.minimum(np.diff(np.r_[starts, len(key)]), 65535)
        key = key[starts]
        owner, grams = key // GRAMS, key % GRAMS
        # frequent first within each text, ties by gram
        order = np.sort((owner << 31) | ((65535 - count) << 15) | grams)
        owner, grams = order >> 31, order & 32767
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
        keep = rank < self.own
        owner, grams, rank = owner[keep], grams[keep], rank[keep]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        n = np.diff(np.r_[first, len(owner)])
        for i in range(len(self.langs)):
            out[owner[first], i] = np.add.reduceat(np.abs(self.ranks[i, grams] - rank), first) / n / self.size
        return out, letters


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram) of all trigrams that hold a letter, words padded by single blanks; and the letters of each text."""
    joined = "\n".join(f" {t.replace(chr(10), ' ')} " for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.cumsum(cp == 10)
    x = np.where(cp < 0x3000, LETTERS[np.minimum(cp, 0x2FFF)], _OTHER)
    x[(cp >= 0x3000) & (cp < 0x3041)] = 0
    keep = x != _DROP
    x, owner = x[keep].astype(np.int64), owner[keep]
    letters = np.bincount(owner[x > 0], minlength=len(texts))
    keep = np.r_[True, (x[1:] > 0) | (x[:-1] > 0) | (owner[1:] != owner[:-1])]
    x, owner = x[keep], owner[keep]
    if len(x) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), letters
    g = (x[:-2] * 28 + x[1:-1]) * 28 + x[2:]
    ok = (owner[:-2] == owner[2:]) & (x[1:-1] + x[2:] > 0) & (x[:-2] + x[1:-1] > 0)
    return owner[:-2][ok], g[ok], letters


#: A paragraph is evidence of another language from so many letters and so much margin (both documented parameters).
MIN_LETTERS, MIN_MARGIN = 30, 0.2


def identify(df: DataFrame, id_col: str, text_col: str, profiles: Profiles, *, min_letters: int = MIN_LETTERS, min_margin: float = MIN_MARGIN) -> DataFrame:
    """(id, seg, lang, confidence, letters, mixed): a row with ``seg`` -1 for each text, and one for each of its paragraphs from 0.

    Paragraphs are what lies between blank lines. A paragraph's language is the one whose profile is nearest to the ranks of its most
    frequent trigrams; ``confidence`` is 1 - nearest / second distance. Code, formulas, markup, names inside sentences and short
    quotations don't count. A paragraph with fewer than ``min_letters`` letters, or a confidence below ``min_margin``, takes the language of
    the text that the others speak for (its own if there is no other). The text's language is the one with most letters. ``mixed`` tells
    whether its paragraphs differ.

    NULL texts give no rows; texts without letters give a row with NULL language and confidence 0, and paragraphs without letters none.
    Everything happens where the text is read; nothing is shuffled. Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                yield _identify_batch(b, id_col, profiles, min_letters, min_margin)

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull())
    return source.mapInArrow(run, f"`{id_col}` {kind}, seg int, lang string, confidence double, letters int, mixed boolean")


def _identify_batch(b: pa.RecordBatch, id_col: str, profiles: Profiles, min_letters: int, min_margin: float) -> pa.RecordBatch:
    ids = b.column(0).to_pylist()
    owner, seg, parts = [], [], []
    for k, text in enumerate(b.column(1).to_pylist()):
        clean = running_text(text)
        if not clean.isupper():
            clean = _NAME.sub(" ", clean)
        # blanked characters keep the paragraphs' numbers: both strings break at the same places
        for j, p in enumerate(clean.split("\n\n")):
            owner.append(k)
            seg.append(j)
            parts.append(p)
    dist, letters = profiles.distances(parts)
    filled = np.where(np.isnan(dist), 1.0, dist)
    order = np.argsort(filled, axis=1, kind="stable")
    near = np.take_along_axis(filled, order[:, :2], axis=1) if len(parts) else np.zeros((0, 2))
    conf = 1 - near[:, 0] / np.maximum(near[:, 1], 1e-12)
    sure = (letters >= min_letters) & (conf >= min_margin)
    owner, best = np.array(owner, dtype=np.int64), order[:, 0]
    n_lang = len(profiles.langs)
    votes = np.zeros((len(ids), n_lang))
    np.add.at(votes, (owner[sure], best[sure]), letters[sure])
    weak = np.zeros((len(ids), n_lang))
    np.add.at(weak, (owner, best), letters)
    none = votes.sum(axis=1) == 0
    votes[none] = weak[none]
    main = votes.argmax(axis=1)
    has = letters > 0
    lang = np.where(sure, best, main[owner])
    differ = np.zeros(len(ids), dtype=bool)
    np.logical_or.at(differ, owner[sure], lang[sure] != main[owner[sure]])
    out = [[], [], [], [], [], []]
    total = np.zeros(len(ids), dtype=np.int64)
    np.add.at(total, owner, letters)
    agree = np.zeros(len(ids))
    np.add.at(agree, owner, np.where(lang == main[owner], conf * letters, 0))
    for k, doc in enumerate(ids):
        known = bool(total[k])
        for x, v in zip(out, (doc, -1, profiles.langs[main[k]] if known else None, float(agree[k] / total[k]) if known else 0.0, int(total[k]), bool(differ[k]))):
            x.append(v)
    for i in np.flatnonzero(has).tolist():
        for x, v in zip(out, (ids[owner[i]], seg[i], profiles.langs[lang[i]], float(conf[i]), int(letters[i]), bool(differ[owner[i]]))):
            x.append(v)
    return pa.record_batch(
        [pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.bool_())],
        names=[id_col, "seg", "lang", "confidence", "letters", "mixed"],
    )


def train_profiles(samples: DataFrame, lang_col: str, text_col: str, *, max_lines: int = 20_000) -> Profiles:
    """Profiles from labelled lines: at most ``max_lines`` of them come to the driver (the bound of the fit), as many of each language as there are, in the order of the hash of their text."""
    lines = samples.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    by_hash = Window.partitionBy("l").orderBy(F.xxhash64("t"), "t")
    rows = lines.withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= max_lines).orderBy("n", "l").limit(max_lines).select("l", "t").collect()
    lines: dict[str, list[str]] = {}
    for lang, text in rows:
        lines.setdefault(lang, []).append(text)
    if not lines:
        raise ValueError("no labelled lines to train on")
    return Profiles(lines)


def label_code(label: Column) -> Column:
    """The code of a label in any usual spelling, with or without region; NULL if it is missing or names none of the known languages."""
    base = F.regexp_replace(F.lower(F.trim(label)), r"[-_.\s(].*$", "")
    code = F.lit(None).cast("string")
    for lang, names in LABELS.items():
        code = F.when(base.isin(names.split()), lang).otherwise(code)
    return code
