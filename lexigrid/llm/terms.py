"""How often every distinct term occurs and in how many records.

Recursive radix spilling: the terms' counts, added up within each input split, are written to the shared folder in partitions
by the first bits of the terms' hashes. A partition with too many rows is divided by the next bits, and so on. Then
each partition is added up on its own by DuckDB. Where the shared folder is mounted DuckDB spills to it; elsewhere it works in
pieces that fit its memory, and no disk of a single machine is used.

Nothing here is bound to a number of tasks: a level is written by as many tasks as the input has, and each partition that is small enough has a
task of its own.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.session import cut, shared_path

#: Bits of the hash in one level, and the bits that there are.
BITS, ALL_BITS = 6, 60
#: Rows that a partition may have before it is divided.
MOST_ROWS = 2_000_000
#: Rows that are added up at a time where there is no folder to spill to.
PIECE = 500_000
#: Memory of a worker's DuckDB.
MEMORY = "400MB"

_SCHEMA = "term string, occurrences bigint, records bigint"


def term_counts(texts: DataFrame, text: str) -> DataFrame:
    """(term, occurrences) of each row's terms, a row for each distinct term of each text: the longest runs of letters,
    combining marks and digits, in lower case. The terms of a text are sorted and counted by runs, in proportion to its length
    but for the sort. Null and empty texts have none.
    """
    sorted_terms = F.array_sort(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{M}\p{Nd}]+"), F.lit(0)))
    rows = texts.select(sorted_terms.alias("t")).where(F.size("t") > 0)
    begins = F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 OR t[i] <> t[i - 1])")
    rows = rows.withColumn("b", begins)
    rows = rows.select("t", F.explode(F.expr("zip_with(b, array_append(slice(b, 2, size(b) - 1), size(t)), (x, y) -> named_struct('b', x, 'e', y))")).alias("r"))
    return rows.select(F.expr("t[r.b]").alias("term"), F.expr("CAST(r.e - r.b AS BIGINT)").alias("occurrences"))


def _connection(scratch: str | None):  # noqa: ANN202
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch or "", "preserve_insertion_order": False})
    return con


def _scratch(folder: str) -> str | None:
    """A folder for DuckDB's spilling within the shared one; None where that isn't a mounted folder."""
    if not folder.startswith(("/", "file:")):
        return None
    os.makedirs(path := folder.removeprefix("file://").removeprefix("file:") + "-scratch", exist_ok=True)
    return tempfile.mkdtemp(dir=path)


def _local_sums(scratch: str):  # noqa: ANN202
    """Within an input split: counts added up by term, by DuckDB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        place = _scratch(scratch)

        def again() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        def pieces() -> Iterator[pa.RecordBatchReader]:
            rest = again()
            if place:
                yield pa.RecordBatchReader.from_batches(first.schema, rest)
                return
            held, n = [], 0
            for b in rest:
                held.append(b)
                n += b.num_rows
                if n >= PIECE:
                    yield pa.RecordBatchReader.from_batches(first.schema, held)
                    held, n = [], 0
            if held:
                yield pa.RecordBatchReader.from_batches(first.schema, held)

        for reader in pieces():
            con = _connection(place)
            con.register("rows_in", reader)
            yield from _plain(con.sql("SELECT term, CAST(sum(occurrences) AS BIGINT) AS occurrences, count(*) AS records FROM rows_in GROUP BY term"))
            con.close()
        _remove(place)

    return run


def _plain(result) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    schema = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
    reader = result.to_arrow_reader(50_000) if hasattr(result, "to_arrow_reader") else result.fetch_record_batch(50_000)
    for batch in reader:
        yield pa.RecordBatch.from_arrays([batch.column(i).cast(f.type) for i, f in enumerate(schema)], schema=schema)


def _remove(place: str | None) -> None:
    if place:
        import shutil

        shutil.rmtree(place, ignore_errors=True)


def _partition_sums(scratch: str):  # noqa: ANN202
    """For each row with a partition's files: its terms with their sums, by DuckDB over the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyarrow import fs

        for batch in batches:
            for files in batch.column(0).to_pylist():
                system, _ = fs.FileSystem.from_uri(files[0])
                paths = [fs.FileSystem.from_uri(f)[1] for f in files]
                con = _connection(place := _scratch(scratch))
                con.register("rows_in", ds.dataset(paths, format="parquet", filesystem=system).scanner(columns=["term", "occurrences", "records"], batch_size=50_000).to_reader())
                yield from _plain(con.sql("SELECT term, CAST(sum(occurrences) AS BIGINT) AS occurrences, CAST(sum(records) AS BIGINT) AS records FROM rows_in GROUP BY term"))
                con.close()
                _remove(place)

    return run


def summed_terms(counts: DataFrame, most_rows: int = MOST_ROWS, bits: int = BITS) -> DataFrame:
    """(term, occurrences, records) of counts (term, occurrences), each distinct term once: occurrences added up, records the
    number of rows. Null terms are left out. An empty table gives an empty one.
    """
    spark = counts.sparkSession
    folder = shared_path(spark, "terms")
    rows = counts.where("term IS NOT NULL").select("term", "occurrences").mapInArrow(_local_sums(folder), _SCHEMA)
    done: list[DataFrame] = []
    level = 0
    while True:
        path = f"{folder}/level{level}"
        part = F.shiftright(F.xxhash64("term"), level * bits).bitwiseAND(F.lit(2**bits - 1)).cast("int")
        # The parts above decide too where a row goes, as the same bits stand in many partitions.
        keys = ["part", *(["above"] if level else [])]
        # Each part is written by several tasks when there are more of them than parts.
        writers = int(spark.conf.get("spark.sql.shuffle.partitions"))
        salt = F.pmod(F.xxhash64("term", F.lit(level)), F.lit(max(1, writers * 4 // 2**bits)))
        rows = rows.withColumn("part", part).withColumn("salt", salt)
        rows.repartition(max(writers, 2**bits), *keys, "salt").drop("salt").write.partitionBy(*reversed(keys)).parquet(path)
        written = spark.read.schema(f"{_SCHEMA}, above string, part int" if level else f"{_SCHEMA}, part int").parquet(path)
        written = written.select("term", "occurrences", "records", *keys, F.col("_metadata.file_path").alias("file"))
        place = F.concat_ws("-", *([F.col("above")] if level else []), F.col("part").cast("string"))
        files = written.groupBy(*keys, "file").agg(F.count("*").alias("n"))
        # A row for each partition, with the names of its files.
        sizes = files.groupBy(*keys).agg(F.sum("n").alias("n"), F.collect_list("file").alias("files")).withColumn("place", place)
        sizes = cut(sizes.select("place", "files", ((F.col("n") > most_rows) & F.lit((level + 2) * bits <= ALL_BITS)).alias("over")))
        n = {r["over"]: r["n"] for r in sizes.groupBy("over").agg(F.count("*").alias("n")).collect()}
        if n.get(False):
            done.append(sizes.where("NOT over").select("files").repartition(n[False]).mapInArrow(_partition_sums(folder), _SCHEMA))
        if not n.get(True):
            break
        large = sizes.where("over").select(F.col("place").alias("p"))
        rows = written.withColumn("above", place).join(large, F.col("above") == F.col("p"), "left_semi").select("term", "occurrences", "records", "above")
        level += 1
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], _SCHEMA)


def marked_terms(texts: DataFrame, text: str, rare: int = 2, common: float = 0.02) -> DataFrame:
    """(term, occurrences, records, mark) of all terms of texts. mark is rare for a term in at most rare records, common for
    one in more than the part common of all records, and null for others. Records are the rows whose text isn't null,
    empty ones and repeated ones included; in so few records that a term is both, it is rare.
    """
    n = texts.where(F.col(text).isNotNull()).count()
    sums = summed_terms(term_counts(texts, text))
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * n, "common")
    return sums.withColumn("mark", mark)
