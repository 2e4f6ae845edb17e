"""Readers and writers of the file formats; every path may be a folder on a shared file system."""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lexigrid.functions.script import roman_column

#: Version of the index tables that write_index writes and read_index asks for.
INDEX_VERSION = 1


def read_csv(spark: SparkSession, path: str, many_lines: bool = False) -> DataFrame:
    """A CSV file with a header; every column is a nullable string and an empty field is null. A quote inside is doubled."""
    return spark.read.options(header=True, escape='"', quote='"', multiLine=many_lines, nullValue="", emptyValue="").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"', quote='"').csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(sep="\t").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The well-formed objects and the malformed lines, so that a file with a torn end can be read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", StructType([*schema.fields]).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    return parsed.where("x._bad IS NULL").select("x.*").drop("_bad"), parsed.where("x._bad IS NOT NULL").select("value")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(word, meaning) of a JSON array of entries; of equal words the last one counts."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<struct<word string, meaning string>>")).alias("pos", "e"))
    return rows.groupBy("e.word").agg(F.max_by("e.meaning", "pos").alias("meaning"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file from 1: numbered inside of each split and shifted by the splits before."""
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("m"))
    rows = rows.withColumn("part", F.shiftright("m", 33)).withColumn("inside", F.col("m").bitwiseAND(F.lit(2**33 - 1)))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(before, "part").select((F.col("before") + F.col("inside") + 1).alias("line_no"), "line")


def read_aligned(spark: SparkSession, left: str, right: str, ids: str) -> DataFrame:
    """(id, left, right) of three files whose lines belong together; pairs with an empty side are left out."""
    a, b, c = (numbered_lines(spark, p) for p in (left, right, ids))
    rows = a.withColumnRenamed("line", "left").join(b.withColumnRenamed("line", "right"), "line_no").join(c.withColumnRenamed("line", "id"), "line_no")
    return rows.where((F.length("left") > 0) & (F.length("right") > 0)).select(F.substring_index("id", "\t", 1).alias("id"), "left", "right")


def write_index(index: DataFrame, path: str, corpus_version: str) -> None:
    """The index of words by sentences, in files sorted by word, with its version beside it."""
    index.repartitionByRange("word").sortWithinPartitions("word", "id").write.mode("overwrite").parquet(f"{path}/word_index")
    meta = [("schema_version", str(INDEX_VERSION)), ("corpus_version", corpus_version)]
    index.sparkSession.createDataFrame(meta, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_index(spark: SparkSession, path: str) -> tuple[str, DataFrame | None]:
    """ready with the index; missing or mismatch with none."""
    try:
        meta = {r["key"]: r["value"] for r in spark.read.json(f"{path}/meta").limit(100).collect()}
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return "missing", None
        raise
    if meta.get("schema_version") != str(INDEX_VERSION):
        return "mismatch", None
    return "ready", spark.read.parquet(f"{path}/word_index")


def write_manifest(df: DataFrame, path: str, **parameters: object) -> None:
    """One JSON line with the number of rows, a digest that doesn't depend on their order, and the parameters."""
    row = df.select(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("digest"))
    row.withColumn("parameters", F.lit(json.dumps(parameters, sort_keys=True, default=str))).coalesce(1).write.mode("overwrite").json(path)


def append_missing(done_path: str, work: DataFrame, key: str, version: str, run) -> int:  # noqa: ANN001
    """Runs run on the rows of work that aren't in the table at done_path with this version, and appends the result: a job that
    was stopped goes on where it was. Returns the number of rows left before.
    """
    spark = work.sparkSession
    try:
        todo = work.join(spark.read.parquet(done_path).where(F.col("version") == version).select(key), key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = work
    n = todo.count()
    if n:
        run(todo).withColumn("version", F.lit(version)).write.mode("append").parquet(done_path)
    return n


def read_json_lines_to_the_first_bad(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The objects of a file up to its first malformed line, in any order; a file that was cut while it was written is read as far as it goes."""
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    fields = StructType([*schema.fields]).add("_bad", "string")
    parsed = lines.select("line_no", F.from_json("line", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    first_bad = parsed.where("x._bad IS NOT NULL").agg(F.min("line_no").alias("stop"))
    # One row.
    return parsed.crossJoin(F.broadcast(first_bad)).where("stop IS NULL OR line_no < stop").select("x.*").drop("_bad")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line; letters stay as they are, fields that are null too."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(sep="\t", quote="", escape="").csv(path)


def read_word_list(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(line_no, word) of a list of words, without blanks around them and empty lines; of its first n words, if n is given."""
    rows = numbered_lines(spark, path).select("line_no", F.trim("line").alias("word")).where("word <> ''")
    return rows if n is None else rows.orderBy("line_no").limit(n)


def transcoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, roman) of a file with a word a line, each in Roman letters; the order is that of line_no."""
    return numbered_lines(spark, path).select("line_no", roman_column(F.trim("line"), True).alias("roman"))


def unpacked(spark: SparkSession, source: str, target: str) -> int:
    """A compressed text file or folder written plainly; readers see nothing of it before it is whole. Returns the number of lines. Files of one compressed
    stream are read by one task each.
    """
    lines = spark.read.text(source)
    lines.write.mode("overwrite").text(target)
    return spark.read.text(target).count()


def wrong_digests(spark: SparkSession, path: str, expected: dict[str, str]) -> list[str]:
    """Names of the files of a published dataset, a short list, that are missing or whose SHA-256 isn't the expected one."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest"))
    got = {r["name"]: r["digest"] for r in files.where(F.col("name").isin(*expected)).collect()} if expected else {}
    return sorted(n for n, d in expected.items() if got.get(n) != d.lower())


def replace_table(df: DataFrame, path: str) -> str:
    """Writes a new version of a table beside the old ones and then names it in path/current: readers have the old version or the new one, whole, and df may
    read the old one. Returns the version's folder.
    """
    spark = df.sparkSession
    version = f"{path}/version-{uuid.uuid4().hex}"
    df.write.parquet(version)
    name = version.rsplit("/", 1)[1]
    count = spark.read.parquet(version).count()
    spark.createDataFrame([(name, count, time.time_ns())], "version string, rows bigint, at bigint").coalesce(1).write.mode("append").json(f"{path}/current")
    return version


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The version of a table that replace_table wrote last."""
    last = spark.read.schema("version string, rows bigint, at bigint").json(f"{path}/current").orderBy(F.desc("at")).first()
    return spark.read.parquet(f"{path}/{last['version']}")


def write_corpus(pairs: DataFrame, path: str, corpus_version: str) -> None:
    """The four tables of a corpus: pairs, words with dense ids, the index of words by pairs in files sorted by word, and meta."""
    from lexigrid.operators.lookup import word_index
    from lexigrid.operators.ranks import numbered

    pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    index = word_index(pairs, "id", "inuktitut").withColumnRenamed("id", "pair_id")
    words = numbered(index.groupBy("word").agg(F.min("pair_id").alias("first")).withColumn("all", F.lit(0)), "all", ["first", "word"], "id").select("id", "word")
    words.write.mode("overwrite").parquet(f"{path}/words")
    ids = pairs.sparkSession.read.parquet(f"{path}/words").withColumnRenamed("id", "word_id")
    index = index.join(ids, "word").select("word_id", "pair_id")
    index.repartitionByRange("word_id", "pair_id").sortWithinPartitions("word_id", "pair_id").write.mode("overwrite").parquet(f"{path}/word_index")
    meta = [("schema_version", str(INDEX_VERSION)), ("corpus_version", corpus_version), ("pair_count", str(pairs.count()))]
    pairs.sparkSession.createDataFrame(meta, "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def markdown(df: DataFrame, title: str, most: int = 50) -> str:
    """A report of the first most rows of a small table as text."""
    rows = df.limit(most).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def lexicon_lines(records: DataFrame) -> DataFrame:
    """(value) lines of a lexicon source from records (morpheme, id, state): the id and the form with the state in which a word goes on. Records without a form are left out."""
    rows = records.where("morpheme IS NOT NULL AND morpheme <> ''")
    return rows.select(F.concat("id", F.lit(":"), F.regexp_replace("morpheme", "([&%])", "%$1"), F.lit(" "), "state", F.lit(" ;")).alias("value"))


def called_cases(source: str, name: str) -> list[tuple[list[str], list[str]]]:
    """Texts among the arguments, and names of the calls chained to it, of every call of name in the text of a program: comments are left out, brackets and texts
    are matched. Of cases with one first text the last one counts.
    """
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or " ", source, flags=re.S)
    out: dict[str, tuple[list[str], list[str]]] = {}
    for m in re.finditer(rf"\b{re.escape(name)}\s*\(", bare):
        end = _closing(bare, m.end() - 1)
        texts = [json.loads(t) for t in re.findall(r'"(?:\\.|[^"\\])*"', bare[m.end() : end])]
        chained = []
        while c := re.match(r"\s*\.\s*(\w+)\s*\(", bare[end + 1 :]):
            chained.append(c[1])
            end = _closing(bare, end + c.end())
        if texts:
            out.pop(texts[0], None)
            out[texts[0]] = (texts, chained)
    return list(out.values())


def _closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one at at; the text's end if there is none."""
    depth = 0
    for m in re.compile(r'"(?:\\.|[^"\\])*"|[()]').finditer(text, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if depth == 0:
            return m.start()
    return len(text)


def load_tables(spark: SparkSession, paths: dict[str, str], identifier: str) -> DataFrame:
    """The rows of several CSV tables in one, in the order given, with the name of their table; columns that a table lacks are null. identifier is an expression over the
    columns; rows of different tables with one identifier are an error, as are two of one table.
    """
    out = None
    for name, path in paths.items():
        rows = read_csv(spark, path).withColumn("table_name", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    out = out.withColumn("id", F.expr(identifier))
    clash = out.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.min("table_name").alias("a"), F.max("table_name").alias("b")).where("n > 1").orderBy("id").first()
    if clash:
        raise ValueError(f"id {clash['id']} stands in {clash['a']} and {clash['b']}")
    return out


#: The columns of a gold table that say yes or no.
GOLD_FLAGS = ("has_no_correct_decomp", "is_misspelled", "is_possibly_misspelled", "is_borrowed", "decomp_unknown", "is_proper_name")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """A gold table: quoted fields may hold line breaks, blank lines are left out, flags are booleans whatever their case (false if they are neither), lists are arrays
    without empty items.
    """
    rows = read_csv(spark, path, many_lines=True)
    rows = rows.where(F.coalesce(*(F.col(c) for c in rows.columns)).isNotNull())
    flags = {c: F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False)) for c in GOLD_FLAGS if c in rows.columns}
    items = F.filter(F.transform(F.split(F.coalesce("all_correct_decomps", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.withColumns({**flags, "all_correct_decomps": items})
