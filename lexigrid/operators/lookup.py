"""Inverted index, concordance and lookup by the longest prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.text import words


def word_index(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(word, id): one row for each distinct word of each text."""
    return texts.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word"), F.col(key).alias("id"))


def concordance(asked: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """(word, id) of at most limit texts for each asked word, the first by id. Ranks are cut in each task before the shuffle."""
    rows = index.join(asked.select("word").distinct(), "word")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy("id"))).where(F.col("k") <= limit).drop("k")


def longest_prefix(asked: DataFrame, keys: DataFrame, shortest: int = 3) -> DataFrame:
    """(word, key): the longest key that is a strict prefix of the word, of shortest characters at least; words without one
    are left out. The prefixes are joined as wholes, so that the work grows with the words' lengths alone.
    """
    rows = asked.where(F.length("word") > shortest).select("word", F.explode(F.sequence(F.lit(shortest), F.length("word") - 1)).alias("n"))
    rows = rows.select("word", F.expr("substring(word, 1, n)").alias("key"))
    return rows.join(keys.select("key").distinct(), "key").groupBy("word").agg(F.max_by("key", F.length("key")).alias("key"))


def answered(words: DataFrame, state: str, index: DataFrame | None, cap: int = 20) -> DataFrame:
    """(word, status, entry, ids) of each word from an index (word, id) as sources.files.read_index gives it: missing or mismatch for all words where there is none
    to use; else found, found_for_shorter with the longest beginning that it has, or not_found, with the first cap ids.
    """
    q = words.select("word").where("word IS NOT NULL AND word <> ''").distinct()
    if index is None:
        return q.select("word", F.lit(state).alias("status"), F.lit(None).cast("string").alias("entry"), F.array().cast("array<bigint>").alias("ids"))
    keys = index.select(F.col("word").alias("key")).distinct()
    whole = q.join(keys.withColumnRenamed("key", "word"), "word").select("word", F.lit("found").alias("status"), F.col("word").alias("entry"))
    rest = q.join(whole.select("word"), "word", "left_anti")
    short = longest_prefix(rest, keys)
    rest = rest.join(short, "word", "left").select("word", F.when(F.col("key").isNull(), "not_found").otherwise("found_for_shorter").alias("status"), F.col("key").alias("entry"))
    both = whole.unionByName(rest)
    # At most cap ids a word come together.
    ids = concordance(both.where("entry IS NOT NULL").select(F.col("entry").alias("word")).distinct(), index, cap).groupBy("word").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return both.join(ids.withColumnRenamed("word", "entry"), "entry", "left").select("word", "status", "entry", F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids"))
