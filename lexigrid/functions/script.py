"""Conversion between syllabics and the standard Roman spelling.

The tables aren't listed: they follow from the Unicode names of the syllabic signs, such as
CANADIAN SYLLABICS NGII, which spell out each sign.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The consonants of the sign names that the Roman spelling of Inuktitut uses, with their spelling.
CONSONANTS = {"": "", "P": "p", "T": "t", "K": "k", "C": "g", "M": "m", "N": "n", "S": "s", "L": "l", "Y": "j", "F": "v", "R": "r", "Q": "q", "NG": "ng", "NNG": "nng", "LH": "&", "H": "h"}
#: The vowels of the sign names with their spelling; a long vowel is written twice.
VOWELS = {"I": "i", "II": "ii", "O": "u", "OO": "uu", "A": "a", "AA": "aa", "E": "ai"}
#: Signs whose names don't follow the pattern.
ODD_NAMES = {"CANADIAN SYLLABICS FINAL PLUS": None, "CANADIAN SYLLABICS NUNAVIK H": "h", "CANADIAN SYLLABICS NUNAVUT H": "h", "CANADIAN SYLLABICS QAI": "qai", "CANADIAN SYLLABICS AAI": "ai", "CANADIAN SYLLABICS NGAI": "ngai", "CANADIAN SYLLABICS AI": "ai"}

_PREFIX = "CANADIAN SYLLABICS "


@lru_cache(maxsize=1)
def romans() -> dict[str, str]:
    """Syllabic sign -> Roman spelling, for the signs of Inuktitut."""
    out = {}
    for code in range(0x1401, 0x1677):
        ch = chr(code)
        name = unicodedata.name(ch, "")
        if name in ODD_NAMES:
            if ODD_NAMES[name]:
                out[ch] = ODD_NAMES[name]
            continue
        m = re.fullmatch(_PREFIX + r"([BCDFGHJKLMNPQRSTVWXYZ]*?)(II|OO|AA|I|O|A|E)?", name)
        if m and m[1] in CONSONANTS and (m[1] or m[2]):
            out[ch] = CONSONANTS[m[1]] + VOWELS[m[2] or ""] if m[2] else CONSONANTS[m[1]]
    return out


@lru_cache(maxsize=1)
def long_signs() -> dict[str, str]:
    """Sign with a short vowel -> the sign with the long one, which carries a dot."""
    by_name = {unicodedata.name(chr(c), ""): chr(c) for c in range(0x1401, 0x1680)}
    return {ch: by_name[n + n[-1]] for n, ch in by_name.items() if n.startswith(_PREFIX) and n[-1] in "IOA" and n + n[-1] in by_name}


@lru_cache(maxsize=1)
def syllabics() -> dict[str, str]:
    """Roman spelling -> sign; of several signs the first of the block that has it."""
    out: dict[str, str] = {}
    for ch, roman in romans().items():
        out.setdefault(roman, ch)
    # The plain finals, not the older ones with the same sound.
    out.update({"k": "ᒃ", "t": "ᑦ", "p": "ᑉ", "q": "ᖅ", "s": "ᔅ", "j": "ᔾ", "v": "ᕝ", "r": "ᕐ", "l": "ᓪ", "m": "ᒻ", "n": "ᓐ", "g": "ᒡ", "ng": "ᖕ", "h": "ᕼ"})
    return out


def to_roman(text: str | None) -> str | None:
    """Row-wise twin of roman_column, for tests and Arrow functions."""
    return None if text is None else text.translate({ord(a): b for a, b in romans().items()})


#: A final before a sign that make one sound together, with the signs that stand for them.
MERGED = {"ᕐ": ("", "ᑭᑯᑲᑮᑰᑳᑫ", "ᕿᖁᖃᖀᖂᖄᙯ"), "ᖅ": ("ᖅ", "ᑭᑯᑲᑮᑰᑳᑫ", "ᕿᖁᖃᖀᖂᖄᙯ"), "ᖕ": ("", "ᒋᒍᒐᒌᒎᒑᒉ", "ᖏᖑᖓᖐᖒᖔᙰ")}
#: Other letters for the same sounds.
ALIASES = {"b": "p", "d": "t", "h": "s"}


def merged_signs(col: Column) -> Column:
    """r before a sign of the k row gives q, q before one qq, ng before one of the g row ng."""
    for final, (kept, signs, others) in MERGED.items():
        for a, b in zip(signs, others, strict=True):
            col = F.replace(col, F.lit(final + a), F.lit(kept + b))
    return col


def roman_column(col: Column, merged: bool = False) -> Column:
    """Every syllabic sign replaced by its Roman spelling; other characters stay. Stays inside the JVM; text without signs is left alone.

    Signs of one Roman letter go through one translate; the others through a replace each, in the order
    of the code points. A spelling holds no sign, so that the order doesn't matter. With merged, finals before signs are joined first.
    """
    single = {a: b for a, b in romans().items() if len(b) == 1}
    out = merged_signs(col) if merged else col
    out = F.translate(out, "".join(single), "".join(single.values()))
    for a, b in romans().items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(col.rlike(r"[\x{1400}-\x{167F}]"), out).otherwise(col)


def syllabic_column(col: Column) -> Column:
    """Roman spelling to signs: the longest spelling first, doubled q (also written rq) as q and a sign of the k row; what has no sign stays.

    Consonants of several letters turn into one character first. Signs of ai aren't used.
    """
    coded = {"nng": "X", "ng": "N", "rq": "Q", "qq": "Q"}
    out = col
    for a, b in coded.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(out, "".join(ALIASES), "".join(ALIASES.values()))
    back = {"X": "nng", "N": "ng"}
    signs = syllabics()
    vowels = ("ii", "uu", "aa", "i", "u", "a")
    for v in vowels:
        out = F.replace(out, F.lit("Q" + v), F.lit("ᖅ" + signs["k" + v]))
        for c in (*"pgmsljvrq&NXtkn",):
            if sign := signs.get(back.get(c, c) + v):
                out = F.replace(out, F.lit(c + v), F.lit(sign))
    for v in vowels[:3]:
        out = F.replace(out, F.lit(v), F.lit(signs[v]))
    finals = {c: signs[back.get(c, c)] for c in "iuapgmsljvrqtkn&NX" if back.get(c, c) in signs} | {"Q": "ᖅ", "H": "ᕼ"}
    return F.translate(out, "".join(finals), "".join(finals.values()))


def in_script(col: Column, wanted: Column, script: Column) -> Column:
    """col in the wanted script (syllabic or roman), by the script that it is written in; text of the wanted one stays as it is."""
    return F.when(script == wanted, col).when(wanted == "roman", roman_column(col, True)).when(wanted == "syllabic", syllabic_column(col)).otherwise(col)
