"""Stemmers written from their published descriptions; they run over the distinct vocabulary only."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


def stem_column(terms: DataFrame, term_col: str, stemmer: Callable[[str], str], name: str = "stem") -> DataFrame:
    """``terms`` with the stem of each term; apply it to a vocabulary, not to tokens. NULL stays NULL."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else stemmer(x))

    return terms.withColumn(name, run(F.col(term_col)))


def _shape(w: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(w: str) -> bool:
    return len(w) >= 3 and _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


# Suffix rules of Porter's steps 2, 3 and 4 (fixed values).
_STEP2 = "ational ate|tional tion|enci ence|anci ance|izer ize|abli able|alli al|entli ent|eli e|ousli ous|ization ize|ation ate|ator ate|alism al|iveness ive|fulness ful|ousness ous|aliti al|iviti ive|biliti ble"
_STEP3 = "icate ic|ative |alize al|iciti ic|ical ic|ful |ness "
_STEP4 = "al ance ence er ic able ible ant ement ment ent sion tion ou ism ate iti ous ive ize"


def _pairs(rules: str) -> list[tuple[str, str]]:
    return sorted((tuple(r.split(" ", 1)) for r in rules.split("|")), key=lambda p: -len(p[0]))


_P2, _P3, _P4 = _pairs(_STEP2), _pairs(_STEP3), sorted(_STEP4.split(), key=len, reverse=True)


def porter(w: str) -> str:
    """Porter (1980)."""
    if len(w) <= 2:
        return w
    # 1a
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        cut = next((len(s) for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), 0)
        if cut:
            w = w[:-cut]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    # 1c
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_P2, _P3):
        hit = next(((s, r) for s, r in rules if w.endswith(s)), None)
        if hit and _measure(w[: -len(hit[0])]) > 0:
            w = w[: -len(hit[0])] + hit[1]
    hit4 = next((s for s in _P4 if w.endswith(s)), None)
    if hit4:
        cut = 3 if hit4 in ("sion", "tion") else len(hit4)
        if _measure(w[:-cut]) > 1:
            w = w[:-cut]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# Rules of the Lancaster stemmer as published by Paice and Husk (1990): ending reversed, * if only for intact words, letters to drop, letters to add, > to go on or . to stop (fixed values).
LANCASTER = """
ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t.
jsim2t. jn1d. j1s. lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1.
re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0.
tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s.
""".split()
_RULE = re.compile(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])")
_LANCASTER: dict[str, list[tuple[str, bool, int, str, bool]]] = {}
for _r in LANCASTER:
    _e, _star, _n, _add, _go = _RULE.fullmatch(_r).groups()
    _LANCASTER.setdefault(_e[0], []).append((_e[::-1], bool(_star), int(_n), _add, _go == ">"))


def lancaster(w: str) -> str:
    """Paice-Husk: the first acceptable rule for the last letter is applied until one stops or none fits."""
    whole, intact = w, True
    while w:
        for end, only_intact, drop, add, go in _LANCASTER.get(w[-1], ()):
            if not w.endswith(end) or (only_intact and not intact):
                continue
            new = w[: len(w) - drop] + add
            ok = len(new) >= 2 if new[:1] and new[0] in "aeiou" else len(new) >= 3 and any(c in "aeiouy" for c in new)
            if not ok:
                continue
            intact = intact and new == w
            w = new
            break
        else:
            return w
        if not go:
            return w
    return whole


_VOWELS = "aeiouáéíóúü"
# Endings of the Spanish Snowball stemmer (fixed values).
_ES = {
    "pronoun": "me se sela selo selas selos la le lo las les los nos",
    "gerund": "iéndo ándo ár ér ír ando iendo ar er ir",
    "s1": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos",
    "s1ic": "adora ador ación adoras adores aciones ante antes ancia ancias",
    "yverb": "ya ye yan yen yeron yendo yo yó yas yes yais yamos",
    "verb": """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré
aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais
aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""",
    "everb": "en es éis emos",
}
_ESL = {k: sorted(v.split(), key=len, reverse=True) for k, v in _ES.items()}
_PLAIN = str.maketrans("áéíóú", "aeiou")


def _regions(w: str) -> tuple[int, int, int]:
    """Starts of RV, R1 and R2."""
    n = len(w)

    def after(at: int) -> int:
        for i in range(at + 1, n):
            if w[i] not in _VOWELS and w[i - 1] in _VOWELS:
                return i + 1
        return n

    r1 = after(0)
    r2 = after(r1) if r1 < n else n
    rv = n
    if n > 2:
        if w[1] not in _VOWELS:
            rv = next((i + 1 for i in range(2, n) if w[i] in _VOWELS), n)
        elif w[0] in _VOWELS:
            rv = next((i + 1 for i in range(2, n) if w[i] not in _VOWELS), n)
        else:
            rv = 3
    return rv, r1, r2


def snowball_es(w: str) -> str:
    """Snowball's Spanish stemmer."""
    rv, r1, r2 = _regions(w)

    def ending(kind: str, start: int) -> str | None:
        return next((s for s in _ESL[kind] if w.endswith(s) and len(w) - len(s) >= start), None)

    # attached pronouns
    p = ending("pronoun", rv)
    if p:
        head = w[: -len(p)]
        g = next((s for s in _ESL["gerund"] if head.endswith(s) and len(head) - len(s) >= rv), None)
        if g:
            w = (head[: -len(g)] + g.translate(_PLAIN)) if g in ("iéndo", "ándo", "ár", "ér", "ír") else head
        elif head.endswith("uyendo") and len(head) - 5 >= rv:
            w = head
    start = w

    def drop(suffixes: list[str], at: int) -> bool:
        nonlocal w
        for s in suffixes:
            if w.endswith(s) and len(w) - len(s) >= at:
                w = w[: -len(s)]
                return True
        return False

    def step1() -> None:
        nonlocal w
        groups = ("s1", "s1ic")
        found = sorted(((s, g) for g in groups for s in _ESL[g] if w.endswith(s)), key=lambda x: -len(x[0]))[:1]
        special = sorted((s for s in ("logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos") if w.endswith(s)), key=len)[-1:]
        best = max([x[0] for x in found] + special, key=len, default=None)
        if best is None:
            return
        at = len(w) - len(best)
        if found and found[0][0] == best:
            if at >= r2:
                w = w[:at]
                if found[0][1] == "s1ic":
                    drop(["ic"], r2)
        elif best == "amente":
            if at >= r1:
                w = w[:at]
                if drop(["iv"], r2):
                    drop(["at"], r2)
                else:
                    drop(["os", "ic", "ad"], r2)
        elif at >= r2:
            w = w[:at]
            if best.startswith("log"):
                w += "log"
            elif best.startswith("uci"):
                w += "u"
            elif best.startswith("enci"):
                w += "ente"
            elif best == "mente":
                drop(["ante", "able", "ible"], r2)
            elif best.startswith("idad"):
                drop(["abil", "ic", "iv"], r2)
            else:
                drop(["at"], r2)

    step1()
    if w == start:
        y = ending("yverb", rv)
        if y and w[: -len(y)].endswith("u"):
            w = w[: -len(y)]
        else:
            v = max((s for s in _ESL["verb"] + _ESL["everb"] if w.endswith(s) and len(w) - len(s) >= rv), key=len, default=None)
            if v:
                w = w[: -len(v)]
                if v in _ESL["everb"] and w.endswith("gu"):
                    w = w[:-1]
    last = next((s for s in ("os", "a", "o", "á", "í", "ó", "e", "é") if w.endswith(s) and len(w) - len(s) >= rv), None)
    if last:
        w = w[: -len(last)]
        if last in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_PLAIN)
