"""The best analyses of each word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.llm.topn import double_code, int_code, top_n


def usable(candidates: DataFrame) -> DataFrame:
    """Of each word's analyses, each once: the row that comes first by score descending, native_rank ascending (null last)
    and cand_id ascending. Rows with a null or not-a-number score, a null decomp or a null word_id take no part.
    """
    rows = candidates.where("word_id IS NOT NULL AND decomp IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)")
    first = F.min(F.struct((-F.col("score")).alias("minus"), F.coalesce(F.col("native_rank").cast("long"), F.lit(2**62)).alias("rank"), F.col("cand_id")))
    return rows.groupBy("word_id", "decomp").agg(first.alias("best")).select("word_id", F.col("best.cand_id").alias("cand_id"), "decomp", (-F.col("best.minus")).alias("score"), F.nullif(F.col("best.rank"), F.lit(2**62)).alias("native_rank"))


def best_analyses(candidates: DataFrame, n: int = 3) -> DataFrame:
    """(word_id, cand_id) of the n best analyses of each word: score descending, native_rank ascending, decomp ascending by
    code point, cand_id ascending. Infinite scores are ordinary ones; an infinite score comes first. cand_id is unique.
    """
    rows = usable(candidates)
    return top_n(rows, "word_id", n, [double_code(F.col("score"), descending=True), int_code(F.col("native_rank"))], "decomp", "cand_id")


def replaced_decomps(candidates: DataFrame, words: DataFrame, n: int = 3) -> DataFrame:
    """words' id, with decomps (the n best analyses in order) and top_decomp (the morpheme ids of the first). Words without a
    usable analysis keep what they have.
    """
    won = best_analyses(candidates, n)
    rows = usable(candidates).join(won, ["word_id", "cand_id"], "left_semi")
    ordered = Window.partitionBy("word_id").orderBy(F.desc("score"), F.asc_nulls_last("native_rank"), "decomp", "cand_id")
    lists = rows.withColumn("pos", F.row_number().over(ordered)).groupBy("word_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "decomp"))), lambda x: x["decomp"]).alias("new"))
    ids = F.regexp_extract_all(F.get("new", F.lit(0)), F.lit(r"\{[^:{}]*:([^{}]*)\}"), F.lit(1))
    out = words.select("id", "decomps", "top_decomp").join(lists, F.col("id") == F.col("word_id"), "left")
    return out.select("id", F.coalesce("new", "decomps").alias("decomps"), F.when(F.col("new").isNull(), F.col("top_decomp")).otherwise(ids).alias("top_decomp"))
