"""Text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters of any script; \w means ASCII alone here.
WORD = r"[\p{L}\p{M}\p{N}_]+"
SYLLABIC = r"[\x{1400}-\x{167F}\x{18B0}-\x{18FF}]+"


def words(text: Column) -> Column:
    """Lower-case words of a text, in order; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def syllabic_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SYLLABIC), F.lit(0))


def blank_separated(text: Column) -> Column:
    """Pieces between white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def highlight(text: Column, word: Column) -> Column:
    """struct(start, end) of the first occurrence whatever its case, end exclusive, from 0; null if there is none."""
    at = F.call_function("locate", F.lower(word), F.lower(text))
    return F.when((F.trim(word) != "") & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(word)).alias("end")))


def date_of_source(name: Column) -> Column:
    """The first run of eight digits, else the name."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"([0-9]{8})", 1), F.lit("")), name)


def first_letter(word: Column) -> Column:
    """Upper-case first letter if it is one of A-Z, else null."""
    letter = F.regexp_extract(word, r"\p{L}", 0)
    return F.when(letter.rlike("^[A-Za-z]$"), F.upper(letter))


def script_of(text: Column) -> Column:
    """syllabic, roman, mixed or none, by the letters alone; h and the modifier apostrophe don't count."""
    letters = F.regexp_replace(text, r"[^\p{L}]|[\x{02BC}hH]", "")
    syllabic = F.regexp_replace(letters, r"[^\x{1400}-\x{167F}\x{18B0}-\x{18FF}]", "")
    return F.when(letters == "", "none").when(syllabic == letters, "syllabic").when(syllabic == "", "roman").otherwise("mixed")


def syllabic_ratio(text: Column) -> Column:
    """Share of syllabic signs among the characters that aren't blanks; null for none."""
    solid = F.regexp_replace(text, r"\s", "")
    return F.length(F.regexp_replace(solid, r"[^\x{1400}-\x{167F}]", "")) / F.nullif(F.length(solid), F.lit(0))


def simplified(word: Column) -> Column:
    """One letter for each sound: nng and ng become capital letters."""
    return F.replace(F.replace(word, F.lit("nng"), F.lit("NN")), F.lit("ng"), F.lit("N"))


def unsimplified(word: Column) -> Column:
    return F.replace(F.replace(F.replace(word, F.lit("X"), F.lit("nng")), F.lit("NN"), F.lit("nng")), F.lit("N"), F.lit("ng"))


def lower_keeping_h(word: Column) -> Column:
    return F.replace(F.lower(word), F.lit("h"), F.lit("H"))


def search_input(word: Column) -> Column:
    """Form in which a Roman word is looked up: lower-case, with qk between vowels as qq."""
    return F.regexp_replace(lower_keeping_h(word), r"([iua])qk([iua])", "$1qq$2")


def nasal(letter: Column) -> Column:
    return F.translate(letter, "ptkq", "mnNr")


def voiced(letter: Column) -> Column:
    return F.translate(letter, "ptkq", "vlgr")


def letter_class(letter: Column) -> Column:
    return F.when(letter.rlike("^[aiu]$"), "V").when(letter.rlike("^[a-zA-Z&]$"), "C").otherwise("-1")


#: Named entities that glossary pages use.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


def without_tags(html: Column) -> Column:
    """Text of an HTML fragment: tags removed, the named entities decoded, the ampersand last."""
    bare = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    return F.trim(reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), bare))


def last_section_bullets(text: Column, header: str) -> Column:
    """Bullet lines right after the last header, up to the first other line."""
    lines = F.split(F.substring_index(text, header, -1), "\n")
    start = F.struct(F.array().cast("array<string>").alias("got"), F.lit(False).alias("over"))

    def step(acc: Column, line: Column) -> Column:
        bullet = line.rlike(r"^\s*[-*]\s+")
        over = acc["over"] | ((F.trim(line) != "") & ~bullet)
        got = F.when(bullet & ~over, F.array_append(acc["got"], F.trim(F.regexp_replace(line, r"^\s*[-*]\s+", "")))).otherwise(acc["got"])
        return F.struct(got.alias("got"), over.alias("over"))

    return F.when(F.instr(text, header) > 0, F.aggregate(lines, start, step, lambda x: x["got"]))


def leading_lines(lines: Column, pattern: str) -> Column:
    """The lines that match pattern at the beginning of an array of lines, up to the first other line that isn't blank."""
    start = F.struct(F.array().cast("array<string>").alias("got"), F.lit(False).alias("over"))

    def step(acc: Column, line: Column) -> Column:
        hit = line.rlike(pattern)
        over = acc["over"] | ((F.trim(line) != "") & ~hit)
        return F.struct(F.when(hit & ~over, F.array_append(acc["got"], line)).otherwise(acc["got"]).alias("got"), over.alias("over"))

    return F.aggregate(lines, start, step, lambda x: x["got"])


def quoted_tokens(text: Column, delimiter: str) -> Column:
    """Array of the tokens between delimiters, one character; a delimiter inside of double quotes is none. Empty tokens are left out, quotes stay."""
    d = "\\" + delimiter if delimiter in r"\]^-" else delimiter
    return F.filter(F.regexp_extract_all(text, F.lit(rf'(?:"[^"]*"|[^{d}"])+'), F.lit(0)), lambda x: x != "")
