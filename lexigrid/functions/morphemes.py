"""Morpheme ids and records as columns: parts of an id, its grammar in words, meanings of inflected forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of morphemes, by the first part of an id.
TYPES = {
    "n": "noun root", "v": "verb root", "a": "adverb", "c": "conjunction", "e": "exclamation/disclaimer", "q": "tail suffix", "nn": "noun-to-noun suffix", "nv": "noun-to-verb suffix", "vn": "verb-to-noun suffix", "vv": "verb-to-verb suffix",
    "pr": "pronoun", "p": "pronoun", "rpr": "pronoun root", "rp": "pronoun root", "ad": "demonstrative adverb", "rad": "demonstrative adverb root", "tad": "demonstrative adverb ending", "pd": "demonstrative pronoun", "rpd": "demonstrative pronoun root",
    "tpd": "demonstrative prnoun ending", "tn": "noun ending", "tv": "verb ending",
}
#: Cases and moods, by the second part of an id.
CASES = {
    "nom": "nominative", "gen": "genitive", "loc": "locative", "acc": "accusative", "abl": "ablative", "dat": "dative", "sim": "similaris", "via": "vialis", "dec": "declarative", "caus": "causative", "part": "participial", "int": "interrogative",
    "imp": "imperative", "dub": "dubitative", "freq": "frequentative", "ger": "gerundive", "cond": "conditional", "sc": "static/short referent", "ml": "moving/long referent", "mlsc": "referent of either moving/long OR static/short nature",
}
#: Kinds that have a case or mood and persons.
INFLECTED = ("tn", "tv", "ad", "rad", "pd", "rpd")
#: What a noun in a case means: before, number, after.
NOMINAL = {
    "": ("", "sg", ""), "tn-nom-s": ("", "sg", ""), "tn-nom-p": ("", "pl", ""), "tn-nom-d": ("two ", "du", ""), "tn-acc-s": ("", "sg", " [obj]"), "tn-acc-p": ("", "pl", " [obj]"), "tn-gen-s": ("of ", "sg", ""), "tn-gen-p": ("of ", "pl", ""),
    "tn-abl-s": ("from ", "sg", ""), "tn-abl-p": ("from ", "pl", ""), "tn-loc-s": ("in ", "sg", ""), "tn-loc-p": ("in ", "pl", ""), "tn-dat-s": ("to ", "sg", ""), "tn-dat-p": ("to ", "pl", ""), "tn-via-s": ("through ", "sg", ""), "tn-via-p": ("through ", "pl", ""),
    "tn-sim-s": ("like ", "sg", ""), "tn-nom-s-1p": ("our ", "sg", ""), "tn-nom-s-4s": ("his/her ", "sg", ""), "tn-nom-s-4p": ("their ", "sg", ""), "tn-nom-p-4s": ("his/her ", "pl", ""), "tn-nom-p-4d": ("their ", "pl", ""),
    "tn-gen-s-4s": ("of his/her ", "sg", ""), "tn-dat-s-4s": ("to his/her ", "sg", ""), "tn-dat-p-4s": ("to his/her ", "pl", ""),
}


#: What a verb with an ending means: subject and pattern, V for the bare verb, Vs for its third person.
VERBAL = {
    "tv-ger-1s": ("I", "V"), "tv-ger-1p": ("we", "V"), "tv-ger-2s": ("you", "V"), "tv-ger-3s": ("he/she", "Vs"), "tv-ger-3p": ("they", "V"), "tv-dec-1s": ("I", "V"), "tv-dec-1p": ("we", "V"), "tv-dec-3p": ("they", "V"), "tv-ger-1s-3s": ("I", "V it"),
    "tv-ger-1p-3s": ("we", "V it"), "tv-dec-1s-3s": ("I", "V it"), "tv-dec-1s-3p": ("I", "V them"), "tv-ger-1s-3p": ("I", "V them"), "tv-part-1s-prespas": ("while I", "V"), "tv-part-1p-prespas": ("while we", "V"), "tv-part-1s-3p-prespas": ("while I", "V them"),
    "tv-caus-1s": ("because I", "V"), "tv-caus-1p": ("because we", "V"), "tv-caus-4p": ("because they", "V"), "tv-imp-1d": ("let's (two of us)", "V"),
}


def _of(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def canonical(identifier: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(identifier, "[{}]", ""), r"^([^/]+)/[0-9]*(.*)$", 1), F.lit(""))


def specs(identifier: Column) -> Column:
    """What stands after the slash, without the number of a homograph; null for what is no id."""
    bare = F.regexp_replace(identifier, "[{}]", "")
    return F.when(bare.rlike("^[^/]+/"), F.regexp_extract(bare, r"^([^/]+)/[0-9]*(.*)$", 2))


def braced(text: Column) -> Column:
    """An id without blanks and with one brace on each side."""
    t = F.regexp_replace(text, r"\s+", "")
    t = F.when(t.startswith("{"), t).otherwise(F.concat(F.lit("{"), t))
    return F.when(t.endswith("}"), t).otherwise(F.concat(t, F.lit("}")))


def unbraced(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s{}]", "")


def person(code: Column) -> Column:
    """1s -> 1st person singular; null for a code that says neither."""
    who = F.when(code.startswith("1"), "1st person").when(code.startswith("2"), "2nd person").when(code.startswith("3"), "3rd person").when(code.startswith("4"), "4th person")
    number = F.when(code.contains("s"), "singular").when(code.contains("d"), "dual").when(code.contains("p"), "plural")
    return F.nullif(F.concat_ws(" ", who, number), F.lit(""))


def grammar(identifier: Column) -> Column:
    """The grammar of an id in words: possessive or transitive, kind; case or mood, person and number; possessor or object."""
    parts = F.split(F.regexp_replace(F.substring_index(identifier, "/", -1), "^[0-9]", ""), "-")
    at = lambda i: F.get(parts, F.lit(i))
    kind, full, inflected = at(0), F.size(parts) > 3, at(0).isin(*INFLECTED)
    first = F.when((kind == "tn") & full, "possessive").when((kind == "tv") & full, "transitive").when(kind == "tv", "intransitive")
    last = F.element_at(parts, -1)
    case = F.when(inflected, _of(CASES, at(1)))
    case = F.when(case == "participial", F.concat(F.when(last == "fut", "future ").when(last == "prespas", "past/present ").otherwise(""), case)).otherwise(case)
    one = F.when(inflected & (F.size(parts) > 2), person(at(2)))
    two = F.when(kind.startswith("t") & full, person(at(3)))
    two = F.when(kind == "tn", F.concat(two, F.lit(" possessor"))).when(kind == "tv", F.concat(two, F.lit(" object"))).otherwise(two)
    head = F.concat_ws(" ", first, _of(TYPES, kind))
    head = F.when(case.isNotNull() | one.isNotNull(), F.concat(head, F.lit(";"))).otherwise(head)
    body = F.concat_ws(" ", F.nullif(head, F.lit("")), case, one)
    return F.when(two.isNotNull(), F.concat(body, F.lit("; "), two)).otherwise(body)


def noun_meaning(lemma: Column, ending: Column) -> Column:
    """What a noun means with an ending; null where there is no rule. The plural adds an s."""
    row = lambda k: _of({e: v[k] for e, v in NOMINAL.items()}, F.coalesce(ending, F.lit("")))
    return F.concat(row(0), F.when(row(1) == "pl", F.concat(lemma, F.lit("s"))).otherwise(lemma), row(2))


def verb_meaning(lemma: Column, ending: Column) -> Column:
    """What a verb means with an ending; null where there is no rule. The third person adds an s."""
    row = lambda k: _of({e: v[k] for e, v in VERBAL.items()}, ending)
    verb = F.when(row(1) == "Vs", F.concat(lemma, F.lit("s"))).otherwise(F.concat(lemma, F.substring(row(1), 2, 100)))
    return F.concat(row(0), F.lit(" "), verb)


def content_words(text: Column, stop: list[str]) -> Column:
    """Sorted set of a text's words without stop words and dots at their ends; brackets and slashes separate."""
    words = F.split(F.regexp_replace(F.lower(text), r"[()/]", " "), r"[^a-z'-]+")
    return F.array_sort(F.array_distinct(F.filter(F.transform(words, lambda w: F.trim(w, F.lit(".,"))), lambda w: (w != "") & ~w.isin(*stop))))


def agrees(asked: Column, transitivity: Column, antipassive: Column, trans_suffix: Column) -> Column:
    """Whether a root may stand where transitivity asked (t, i or null for any) is wanted: a transitive root with an antipassive may be used intransitively,
    an intransitive one whose suffix is nil transitively.
    """
    t, i = F.coalesce(transitivity == "t", F.lit(False)), F.coalesce(transitivity == "i", F.lit(False))
    return (
        F.when(asked.isNull(), True)
        .when(t & (asked == "t"), True)
        .when(i & ((asked == "i") | (asked == "t") & F.coalesce(trans_suffix == "nil", F.lit(False))), True)
        .when(t & antipassive.isNotNull() & (asked == "i"), True)
        .otherwise(False)
    )


def filled(template: Column, slots: dict[str, Column]) -> Column:
    """template with each placeholder replaced, in the order given; a null counts as empty."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.coalesce(kv[1], F.lit(""))), slots.items(), template)


def json_text(text: Column) -> Column:
    """text with the two characters escaped that a quoted JSON text can't hold plainly."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def cause_chain(messages: Column) -> Column:
    """Distinct messages in order, without nulls, joined by colons."""
    return F.array_join(F.array_distinct(F.array_compact(messages)), ": ")


#: Blanks of any kind at the ends of a cell.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Named entities that pages use, in any case.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


def decoded(html: Column) -> Column:
    """Text of an HTML fragment: tags removed, decimal, hexadecimal and named entities decoded in one pass, unknown ones kept, blanks at the ends removed."""
    bare = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    pieces = F.regexp_extract_all(bare, F.lit(r"(?s)&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[a-zA-Z]+);|[^&]+|&"), F.lit(0))

    def one(p: Column) -> Column:
        body = F.lower(F.regexp_extract(p, "^&(.*);$", 1))
        hexed = F.conv(F.substring(body, 3, 10), 16, 10).cast("bigint")
        code = F.when(body.rlike("^#x[0-9a-f]+$"), hexed).when(body.rlike("^#[0-9]+$"), F.substring(body, 2, 10).cast("bigint"))
        named = _of({**ENTITIES, "amp": "&"}, body)
        # A code point as UTF-32.
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(~p.startswith("&") | (p == "&"), p).when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), sign).otherwise(F.coalesce(named, p))

    return F.trim(F.array_join(F.transform(pieces, one), ""), F.lit(BLANKS))


def unescaped(html: Column) -> Column:
    """Tags as blanks, entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(html, r"(?s)<[^>]*>", " ")), rf"[{BLANKS}]+", " "))


def table_rows(html: Column) -> Column:
    """Array of struct(word, syllabic, meaning) of the entries of a glossary page: three cells in a row, with attributes and line breaks between."""
    pattern = r'(?s)<div id="romanized"[^>]*>(.*?)</div>\s*<div id="syllabic"[^>]*>(.*?)</div>\s*<div id="term">(.*?)</div>'
    cell = lambda k: F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(k)), decoded)
    return F.arrays_zip(cell(1).alias("word"), cell(2).alias("syllabic"), cell(3).alias("meaning"))


def highlights(text: Column, candidates: Column) -> Column:
    """Array of struct(start, end) of the first occurrence of each candidate whatever its case, from 0, end exclusive; those that don't occur are left out."""
    low = F.lower(text)
    at = F.transform(F.filter(candidates, lambda c: F.trim(c) != ""), lambda c: F.struct((F.call_function("locate", F.lower(c), low) - 1).alias("start"), F.length(c).alias("n")))
    return F.transform(F.filter(at, lambda x: x["start"] >= 0), lambda x: F.struct(x["start"].cast("long").alias("start"), (x["start"] + x["n"]).cast("long").alias("end")))
