"""The word-per-line pipeline: unbounded lines in, one record for each out, without state; and what a consumer sees while it runs."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lexigrid.functions.script import roman_column
from lexigrid.functions.text import script_of, search_input, simplified
from lexigrid.operators.analyzer import Affix, Analyzer, seeds


def records(lines: DataFrame) -> DataFrame:
    """(word, script, roman, looked_up) of each line that isn't blank; works on batches and streams alike."""
    word = F.trim("value")
    roman = roman_column(word, True)
    return lines.where(word != "").select(word.alias("word"), script_of(word).alias("script"), roman.alias("roman"), search_input(roman).alias("looked_up"))


def analyzed(lines: DataFrame, roots: dict[str, list[str]], affixes: list[Affix], lenient: bool | None = True, seconds: float = 10.0) -> DataFrame:
    """(word, lenient, elapsedMSecs, timedOut, exception, decompositions, decompositionsLenient) of each line that isn't blank, for batches and streams; the last column
    is left out if lenient is None. A word that runs out of time or fails has no decompositions. roots, a small lexicon, travels to the workers.
    """
    shared = lines.sparkSession.sparkContext.broadcast((roots, affixes))
    loose = bool(lenient)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, suffixes = shared.value
        search = Analyzer(suffixes)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for w in b.column(1).to_pylist():
                began, late, fault = time.monotonic(), False, None
                got: dict[str, bool] = {}
                try:
                    for form, is_loose in seeds(w, loose):
                        for d in search.first(form, lexicon, None, seconds):
                            got.setdefault(d, is_loose)
                except TimeoutError as e:
                    got, late, fault = {}, True, str(e)
                except Exception as e:  # noqa: BLE001
                    got, fault = {}, f"{type(e).__name__}: {e}"
                for c, x in zip(out, (int((time.monotonic() - began) * 1000), late, fault, list(got), list(got.values())), strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_())]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([loose] * b.num_rows), *arrays], ["word", "lenient", "elapsedMSecs", "timedOut", "exception", "decompositions", "decompositionsLenient"])

    word = F.trim("value")
    rows = lines.where(word != "").select(word.alias("word"), simplified(search_input(roman_column(word, True))).alias("roman"))
    out = rows.mapInArrow(run, "word string, lenient boolean, elapsedMSecs bigint, timedOut boolean, exception string, decompositions array<string>, decompositionsLenient array<boolean>")
    return out.drop("decompositionsLenient") if lenient is None else out


def start(spark: SparkSession, source: str, target: str, checkpoint: str, make=records) -> StreamingQuery:  # noqa: ANN001
    """Reads files of lines as they come and writes make of them as JSON; ends when all that is there is processed. The checkpoint makes the sink exact."""
    stream = spark.readStream.text(source)
    return make(stream).writeStream.format("json").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshots(answers: DataFrame) -> DataFrame:
    """(word, definitions, examples, settled) by word of a stream of answers (word, kind, n): what is known of a word so far. In update mode a consumer gets a row
    whenever more has come in and may keep the last one; settled says that every kind of source (dictionary, corpus) has answered.
    """
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    has = lambda kind: F.max((F.col("kind") == kind).cast("int")) == 1
    return answers.groupBy("word").agg(of("dictionary").alias("definitions"), of("corpus").alias("examples"), (has("dictionary") & has("corpus")).alias("settled"))


class Progress(StreamingQueryListener):
    """Rows read so far of each running query, for those who wait."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + (event.progress.numInputRows or 0)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.ended.add(str(event.id))
