"""Scores of boosted trees, evaluated on batches of rows in Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A leaf is a number; a split has feat, thr, left and right, and x < thr goes left.
Tree = dict | float


def evaluate(tree: Tree, columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    if not isinstance(tree, dict):
        return np.full(n, float(tree))
    # A missing value isn't below any threshold.
    left = columns[tree["feat"]] < tree["thr"]
    return np.where(left, evaluate(tree["left"], columns, n), evaluate(tree["right"], columns, n))


def score_rows(rows: DataFrame, key: str, features: list[str], trees: list[Tree], rate: float) -> DataFrame:
    """(key, score): rate times the sum of the trees. A null feature goes right at every split."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {f: b.column(i + 1).cast(pa.float64()).to_numpy(zero_copy_only=False) for i, f in enumerate(features)}
            total = sum((evaluate(t, columns, b.num_rows) for t in trees), np.zeros(b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rate * total)], [key, "score"])

    return rows.select(key, *features).mapInArrow(run, f"`{key}` {kind}, score double")
