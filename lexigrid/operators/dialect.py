"""Consonant groups of the dialects: equivalent spellings and consonants that a law of syllables may have dropped.

Words are in the simplified orthography: N for ng.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of consonants that dialects use in place of each other; each pair holds both ways.
GROUPS = """
bl ll  bj jj  bg gg  bv vv  pl ll  pk kk  pg gg  pv vv  pq qq  ps ts  ps ss  pt tt
mN NN  mn nn  mp pp  tp pp  tk kk  tj jj  ts ss  ts tt  t& ts  t& tt  && tt  lv vv  nN NN  nm mm
kt tt  ks ss  kp pp  kv vv  ks ts  k& ss  k& ts  k& kt  gl ll  gv vv  gj jj  Nm mm  Nn nn
qt tt  q& r&  qt rt  ql rl  qp rp  qs rs  q& qs  q& qt  rq qq
"""
CONSONANT = "[bpgmsljvrqtkn&NhH]"


def pairs() -> list[tuple[str, str]]:
    """All replacements, both ways, each once."""
    words = GROUPS.split()
    both = [(a, b) for a, b in zip(words[::2], words[1::2], strict=True)]
    return list(dict.fromkeys(both + [(b, a) for a, b in both]))


def _equivalents() -> Column:
    of: dict[str, list[str]] = {}
    for a, b in pairs():
        of.setdefault(a, []).append(b)
    return F.create_map(*[x for a, bs in of.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))])


def spellings(rows: DataFrame, key: str, word: str, most: int = 2) -> DataFrame:
    """(key, variant, steps) of every spelling of a word within most replacements of groups, with the fewest that lead to it; the word itself has 0.

    Every step replaces one group anywhere; the spellings of a word are bounded by its length and most.
    """
    table = _equivalents()
    found = rows.where(F.col(word).isNotNull()).select(F.col(key).alias("__k"), F.col(word).alias("variant"), F.lit(0).alias("steps")).distinct()
    layers, last = [found], found
    for step in range(1, most + 1):
        at = last.where(F.length("variant") > 1).select("__k", "variant", F.explode(F.expr("sequence(1, length(variant) - 1)")).alias("i"))
        at = at.select("__k", "variant", "i", F.explode(F.coalesce(F.try_element_at(table, F.expr("substring(variant, i, 2)")), F.array().cast("array<string>"))).alias("b"))
        last = at.select("__k", F.expr("concat(substring(variant, 1, i - 1), b, substring(variant, i + 2))").alias("variant"), F.lit(step).alias("steps")).distinct()
        layers.append(last)
    out = reduce(DataFrame.unionByName, layers).groupBy("__k", "variant").agg(F.min("steps").alias("steps"))
    return out.select(F.col("__k").alias(key), "variant", "steps")


def restored(rows: DataFrame, key: str, word: str, clusters: DataFrame) -> DataFrame:
    """(key, pos, candidate): spellings with one consonant more where it may have been dropped, since two groups of two consonants don't follow each other:
    pos is the place (from 1) of a single consonant between vowels whose group before it is double; a consonant that stands before it in
    clusters (cluster, second) is put in front.
    """
    w = rows.where(F.col(word).isNotNull()).select(F.col(key).alias("__k"), F.col(word).alias("w"))
    at = w.where(F.length("w") > 2).select("__k", "w", F.explode(F.expr("sequence(2, length(w) - 1)")).alias("pos"))
    single = F.expr("substring(w, pos - 1, 1)").rlike("[aiu]") & F.expr("substring(w, pos, 1)").rlike(CONSONANT) & F.expr("substring(w, pos + 1, 1)").rlike("[aiu]")
    double = F.expr("substring(w, 1, pos - 1)").rlike(f"{CONSONANT}{CONSONANT}[aiu]+$")
    at = at.where(single & double).withColumn("second", F.expr("substring(w, pos, 1)"))
    first = clusters.select("second", F.substring("cluster", 1, 1).alias("first")).distinct()
    out = at.join(F.broadcast(first), "second")
    # Clusters are pairs of letters.
    return out.select(F.col("__k").alias(key), F.col("pos").cast("long").alias("pos"), F.expr("concat(substring(w, 1, pos - 1), first, substring(w, pos))").alias("candidate"))
