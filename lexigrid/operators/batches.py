"""Work on chunks of rows by a function that may fail as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def bisected(rows: DataFrame, key: str, text: str, work: Callable[[list[str]], list[str]], chunk: int = 500) -> DataFrame:
    """(key, result, error) of each row by work, which is given lists of texts and returns as many results. A chunk that fails is halved until the rows that make it
    fail stand alone: these get the error, all others their result. A null text is no work and gets nulls.
    """
    kind = rows.schema[key].dataType.simpleString()

    def solve(texts: list[str]) -> list[tuple[str | None, str | None]]:
        if not texts:
            return []
        try:
            out = work(texts)
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} results for {len(texts)} texts")
            return [(r, None) for r in out]
        except Exception as e:  # noqa: BLE001
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return solve(texts[:half]) + solve(texts[half:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                part = b.slice(at, chunk)
                texts = part.column(1).to_pylist()
                done = iter(solve([t for t in texts if t is not None]))
                got = [(None, None) if t is None else next(done) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], [key, "result", "error"])

    return rows.select(key, text).mapInArrow(run, f"`{key}` {kind}, result string, error string")
