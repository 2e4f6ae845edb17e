"""Decomposition strings such as {surface:canonical/id}{surface:canonical/id} as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART = r"\{([^:{}]*):([^/{}]*)/([^{}]*)\}"
#: Ids of the endings of nouns and verbs.
ENDING = r"^t[nv]-"
#: Ids of all endings, of suffixes that derive, and of enclitics.
ENDINGS, DERIV, ENCLITIC = r"^(?:tn|tv|tad|tpd)-", r"^[0-9]+(?:vn|nv|vv|nn)$", r"^[0-9]+q$"


def part_column(decomp: Column, k: int) -> Column:
    """Array of the surfaces (1), canonical forms (2) or ids (3)."""
    return F.regexp_extract_all(decomp, F.lit(PART), F.lit(k))


def parts(decomp: Column) -> Column:
    """Array of struct(surface, canonical, id)."""
    pair = F.zip_with(part_column(decomp, 1), part_column(decomp, 2), lambda a, b: F.struct(a.alias("surface"), b.alias("canonical")))
    return F.zip_with(pair, part_column(decomp, 3), lambda p, i: F.struct(p["surface"].alias("surface"), p["canonical"].alias("canonical"), i.alias("id")))


def keys(decomp: Column) -> Column:
    """Array of canonical/id."""
    return F.zip_with(part_column(decomp, 2), part_column(decomp, 3), lambda a, b: F.concat(a, F.lit("/"), b))


def without_surfaces(decomp: Column) -> Column:
    return F.regexp_replace(decomp, r"\{[^:{}]+:", "{")


def analysis(decomp: Column) -> Column:
    """canonical+id++canonical+id."""
    return F.array_join(F.transform(keys(decomp), lambda x: F.replace(x, F.lit("/"), F.lit("+"))), "++")


def of_analysis(text: Column) -> Column:
    """{canonical/id}{canonical/id} of canonical+id++canonical+id."""
    return F.array_join(F.transform(F.split(text, r"\+\+"), lambda x: F.concat(F.lit("{"), F.regexp_replace(x, r"\+", "/"), F.lit("}"))), "")


def surface(decomp: Column) -> Column:
    return F.array_join(part_column(decomp, 1), "")


def stem(ks: Column) -> Column:
    """The keys before the first ending, without enclitics at the end."""
    ids = F.transform(ks, lambda x: F.substring_index(x, "/", -1))
    first = F.array_position(F.transform(ids, lambda x: x.rlike(ENDING)), True)
    kept = F.array_position(F.transform(F.reverse(ids), lambda x: ~x.rlike(ENCLITIC)), True)
    end = F.when(first > 0, first - 1).when(kept > 0, F.size(ks) - kept + 1).otherwise(0)
    return F.slice(ks, F.lit(1), end.cast("int"))


def endings(ids: Column) -> Column:
    return F.filter(ids, lambda x: x.rlike(ENDINGS))


def enclitics(ids: Column) -> Column:
    return F.filter(ids, lambda x: x.rlike(ENCLITIC))


def tier(ids: Column) -> Column:
    """0 for a word without ending and enclitic, 1 for one with enclitics alone, 2 for others."""
    return F.when(F.size(endings(ids)) > 0, 2).when(F.size(enclitics(ids)) > 0, 1).otherwise(0)


def ending_kind(ids: Column) -> Column:
    """struct(kind, mood, valency) of the last ending: bare, n, or v with its mood and whether it has an object."""
    last = F.try_element_at(endings(ids), F.lit(-1))
    parts = F.split(last, "-")
    verb = last.startswith("tv-")
    return F.struct(
        F.when(last.isNull(), "bare").when(verb, "v").otherwise("n").alias("kind"), F.when(verb, F.get(parts, F.lit(1))).alias("mood"), F.when(verb, F.when(F.size(parts) >= 4, "tr").otherwise("itr")).alias("valency"),
    )


def base_relation(base: Column, member: Column) -> Column:
    """How an inflected form relates to its base, by the ids of both."""
    b, m = ending_kind(base), ending_kind(member)
    both = (b["kind"] == "v") & (m["kind"] == "v")
    return (
        F.when((b["kind"] == "bare") & (m["kind"] == "bare"), "enclitic-only")
        .when(both & (m["mood"] != b["mood"]), "verbal-mood-change")
        .when(both & (m["valency"] != b["valency"]), "verbal-valency-change")
        .when(both, "verbal-agreement")
        .when(m["kind"] == "v", "verbal-inflection")
        .otherwise("nominal-inflection")
    )


def category(identifier: Column) -> Column:
    """ending, deriv, root or other, by the id."""
    return (
        F.when(identifier.rlike(ENDING), "ending").when(identifier.rlike(r"^[0-9]+[nv][nv]$"), "deriv").when(identifier.rlike(r"^[0-9]+[a-z]+$"), "root").otherwise("other")
    )


def affix_key(key: Column) -> Column:
    """An id with a hyphen is unique by itself; others need the canonical form."""
    return F.when(F.substring_index(key, "/", -1).contains("-"), F.substring_index(key, "/", -1)).otherwise(key)


def switches(ids: Column) -> Column:
    """struct(cat, switches, clashes) of the walk from left to right: the category carried along, how often a suffix changes it
    and how often one is attached to another category than it asks for. The walk begins with n.
    """
    start = F.struct(F.lit("n").alias("cat"), F.lit(0).alias("switches"), F.lit(0).alias("clashes"))

    def step(acc: Column, i: Column) -> Column:
        deriv, root = i.rlike(r"^[0-9]+[nv][nv]$"), i.rlike(r"^[0-9]+[nv]$")
        wants = F.when(deriv, F.substring(i, -2, 1)).when(i.rlike(ENDING), F.substring(i, 2, 1)).otherwise(acc["cat"])
        gives = F.when(deriv | root, F.substring(i, -1, 1)).otherwise(acc["cat"])
        return F.struct(
            gives.alias("cat"),
            (acc["switches"] + F.when(deriv & (gives != acc["cat"]), 1).otherwise(0)).alias("switches"),
            (acc["clashes"] + F.when(wants != acc["cat"], 1).otherwise(0)).alias("clashes"),
        )

    return F.aggregate(ids, start, step)
