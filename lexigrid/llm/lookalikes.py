"""Pairs of rows whose texts look the same but consist of different characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.consistent import consistent_form
from lexigrid.session import cut

#: Rows of one text that one task pairs at a time with as many of another text.
BLOCK = 4096
#: Texts with several blocks of rows that are broadcast at most, 16 bytes each and a number; more are joined by key.
MOST_HOT = 100_000


def digest(col: Column) -> Column:
    """16 bytes that stand for a text; two texts with the same digest count as the same."""
    return F.unhex(F.md5(col))


def _blocked(forms: DataFrame, classes: DataFrame) -> DataFrame:
    """forms with the blocks of its class. The classes of more than one block, if they are few, meet their rows before any shuffle."""
    hot = classes.where("blocks > 1")
    if not 0 < hot.limit(MOST_HOT + 1).count() <= MOST_HOT:
        return forms.join(classes, ["field", "raw"])
    marked = forms.join(F.broadcast(hot), ["field", "raw"], "left")
    cold = marked.where("blocks IS NULL").select(*forms.columns).join(classes.where("blocks = 1"), ["field", "raw"])
    return marked.where("blocks IS NOT NULL").unionByName(cold)


def look_alike_classes(rows: DataFrame) -> DataFrame:
    """(field, id, class_id, partners) of every row that takes part in look_alike_pairs: class_id is the smallest id of the rows of its field
    with the same form, partners the number of rows there whose characters differ. Nothing is paired, so that a form that a third of all
    rows share stays one count for each of its spellings.
    """
    forms = _forms(rows)
    spellings = forms.groupBy("field", "form", "raw").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    sums = spellings.groupBy("field", "form").agg(F.sum("n").alias("all"), F.min("least").alias("class_id"), F.count("*").alias("k")).where("k > 1")
    spellings = spellings.join(sums, ["field", "form"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    spellings = cut(spellings.select("field", "raw", "blocks", "class_id", (F.col("all") - F.col("n")).alias("partners")))
    return _blocked(forms.select("field", "raw", "id"), spellings).select("field", "id", "class_id", "partners")


def _forms(rows: DataFrame) -> DataFrame:
    texts = rows.select("field", "id", F.col("text").alias("text"), digest(F.col("text").cast("binary")).alias("raw")).where("text <> ''")
    forms = consistent_form(texts, ["field", "id", "raw"], "text", "form")
    return cut(forms.select("field", "id", "raw", digest(F.col("form").cast("binary")).alias("form")))


def look_alike_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b, of all pairs of rows of one field whose texts differ but have one consistent form.

    rows has field string, id bigint and text string; (field, id) is unique. Null and empty texts take no part; a text of
    blanks alone does, as it isn't empty. Rows with the very same characters are no pair. Other columns are ignored.

    Equal rows are first put together to a class per distinct text, so that copies of one text are never compared with each
    other: only classes of one form are paired. A pair of classes is expanded to pairs of rows in blocks of block rows a
    side, so that the copies of a frequent text are spread over tasks.
    """
    forms = _forms(rows)
    classes = forms.groupBy("field", "form", "raw").agg(F.count("*").alias("n"))
    several = classes.groupBy("field", "form").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    # Few rows: forms with more than one spelling.
    classes = cut(classes.join(several, ["field", "form"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")))
    a = classes.select("field", "form", F.col("raw").alias("raw_a"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block_a"))
    b = classes.select("field", "form", F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block_b"))
    pairs = a.join(b, ["field", "form"]).where("raw_a < raw_b").drop("form")
    members = _blocked(forms, classes.select("field", "raw", "blocks")).select("field", "raw", F.expr("pmod(xxhash64(id), blocks)").cast("int").alias("block"), "id")
    side = lambda x: members.select("field", F.col("raw").alias(f"raw_{x}"), F.col("block").alias(f"block_{x}"), F.col("id").alias(f"id_{x}"))
    found = pairs.join(side("a"), ["field", "raw_a", "block_a"]).join(side("b"), ["field", "raw_b", "block_b"])
    return found.select("field", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
