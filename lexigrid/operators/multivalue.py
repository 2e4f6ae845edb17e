"""Several values packed in one field.

A multi-pattern automaton finds the known whole values in a field, and dynamic programming picks the cheapest cover of the field
by delimiters, quoted values, known values and other runs of characters. A known value is cheaper than other runs, so that a
delimiter inside of it doesn't cut it: in abc/1v/def/2n the first and the third slash are protected if abc/1v and def/2n are known.

The known values are those that stand alone between delimiters that no value holds, and, where a field's rule says so, the contents of its quoted
values. A dictionary of up to DICTIONARY_BYTES is broadcast as an automaton; a larger one stays distributed, and the pieces of each
field that may be in it are joined with it. Both ways give the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.session import cut

#: Size of the dictionary up to which it is broadcast.
DICTIONARY_BYTES = 16 << 20
#: Opening mark -> closing mark. Inside of straight double quotes a doubled one stands for one.
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»"}


@dataclass(frozen=True)
class FieldSpec:
    """table and key name the rows; delimiters separate values besides blanks and line breaks, enclosing marks are dropped as
    if they were delimiters; inside are delimiters too, but for those within a known value; value is the pattern of a whole value that counts as
    known wherever it stands alone; with quoted, the contents of quoted values are known too and may hold any delimiter and blanks.
    """

    table: str
    key: str
    name: str
    delimiters: str
    enclosing: str = ""
    inside: str = ""
    value: str = r"\S+"
    quoted: bool = False
    quotes: dict[str, str] = field(default_factory=lambda: dict(QUOTES))


class Segmenter:
    """Splits one field into its values."""

    def __init__(self, spec: FieldSpec, known: list[str]) -> None:
        import ahocorasick

        self.spec = spec
        self.outside = set(spec.delimiters + spec.enclosing)
        self.weak = set(spec.inside)
        self.matches = ahocorasick.Automaton()
        for v in known:
            self.matches.add_word(v, len(v))
        self.has_known = bool(known)
        if known:
            self.matches.make_automaton()

    def known_in(self, text: str) -> list[tuple[int, int]]:
        """Begin and end of every known value in text."""
        return [(end + 1 - length, end + 1) for end, length in self.matches.iter(text)] if self.has_known else []

    def _separates(self, ch: str) -> bool:
        return ch in self.outside or ch.isspace()

    def _quoted(self, text: str, at: int) -> tuple[int, str] | None:
        """End and content of the quoted value that begins at at, if it is closed right before a separator or the end."""
        close = self.spec.quotes.get(text[at])
        if close is None:
            return None
        n, i = len(text), at + 1
        while (i := text.find(close, i)) >= 0:
            if close == '"' and text.startswith('""', i):
                i += 2
            elif i + 1 == n or self._separates(text[i + 1]) or text[i + 1] in self.spec.quotes and close != "'":
                inner = text[at + 1 : i]
                return i + 1, inner.replace('""', '"') if close == '"' else inner
            else:
                i += 1
        return None

    def split(self, text: str | None, known: list[tuple[int, int]] | None = None) -> list[str]:
        """The values in order; known are the places of known values, else they are looked for. None, an empty and a blank field have none;
        values are never empty.
        """
        if text is None or not (n := len(text)):
            return []
        known_from: dict[int, list[int]] = {}
        for at, end in self.known_in(text) if known is None else known:
            known_from.setdefault(at, []).append(end)
        strong = [self._separates(c) for c in text]
        either = [a or c in self.weak for a, c in zip(strong, text, strict=True)]
        run_end, end = [n] * (n + 1), n
        for i in range(n - 1, -1, -1):
            end = i if strong[i] else end
            run_end[i] = end
        upto = list(accumulate((int(x) for x in either), initial=0))
        either_before = lambda i, j: upto[j] > upto[i]
        # cost[i], the way on from i: the cheapest cover of the rest. Values begin only where reachable says so.
        begins, todo = {0}, [0]
        ways: dict[int, list[tuple[int, int, str | None]]] = {}
        while todo:
            i = todo.pop()
            if i == n:
                continue
            out: list[tuple[int, int, str | None]] = []
            if strong[i]:
                out.append((i + 1, 0, None))
            elif (q := self._quoted(text, i)) is not None:
                out.append((q[0], 1, q[1].strip()))
            else:
                # A known value costs 1, a run without a delimiter 2, a run with one more than any number of known values.
                rest_of_run = i > 0 and text[i - 1] in self.weak and not strong[i - 1]
                cost_of_run = 4 * n + 4 if rest_of_run else 2 * n + 2 if either_before(i, run_end[i]) else 2
                out.append((run_end[i], cost_of_run, text[i : run_end[i]]))
                out += [(e, 1, text[i:e]) for e in known_from.get(i, ()) if e == n or either[e]]
                if either[i]:
                    out.append((i + 1, 0, None))
            ways[i] = out
            for e, _, _ in out:
                if e not in begins:
                    begins.add(e)
                    todo.append(e)
        cost, best = {n: (0, 0)}, {}
        for i in sorted(ways, reverse=True):
            # Of covers of one cost the one with fewer values, and then the longer first value.
            choices = [((cost[e][0] + c, cost[e][1] + (v is not None)), -e, e, v) for e, c, v in ways[i]]
            top = min(choices, key=lambda x: x[:2])
            cost[i], best[i] = top[0], (top[2], top[3])
        values, i = [], 0
        while i < n:
            i, v = best[i]
            if v:
                values.append(v)
        return values

    def spans(self, text: str, most: int) -> list[tuple[int, int]]:
        """Begin and end of what may be a known value: up to most pieces between delimiters of any kind."""
        n = len(text)
        either = [self._separates(c) or c in self.weak for c in text]
        starts = [i for i in range(n) if not either[i] and (i == 0 or either[i - 1] or text[i - 1] in self.spec.quotes)]
        ends = [i for i in range(1, n + 1) if not either[i - 1] and (i == n or either[i])]
        out, k = [], 0
        for i in starts:
            while k < len(ends) and ends[k] <= i:
                k += 1
            out += [(i, e) for e in ends[k : k + most]]
        return out


def known_values(rows: DataFrame, spec: FieldSpec) -> DataFrame:
    """(v, pieces) of all distinct known values of a field, with the number of pieces that delimiters cut them into."""
    strong = "".join(map(re.escape, spec.delimiters + spec.enclosing + "".join(spec.quotes) + "".join(spec.quotes.values()))).replace("'", "")
    runs = F.split(F.regexp_replace(F.col(spec.name), r"^'|'$|(?<=\s)'|'(?=\s)", " "), rf"[\s{strong}]+")
    alone = rows.select(F.explode(runs).alias("v")).where(F.col("v").rlike(f"^(?:{spec.value})$"))
    if spec.quoted:
        inner = [rf"(?<![^\s{strong}]){re.escape(a)}([^{re.escape(a)}{re.escape(b)}]+){re.escape(b)}(?![^\s{strong}])" for a, b in spec.quotes.items()]
        for pattern in inner:
            alone = alone.unionByName(rows.select(F.explode(F.regexp_extract_all(spec.name, F.lit(pattern), F.lit(1))).alias("v")).select(F.trim("v").alias("v")))
    any_delimiter = "".join(map(re.escape, spec.delimiters + spec.enclosing + spec.inside))
    return alone.where("v <> ''").distinct().withColumn("pieces", F.size(F.split("v", rf"[\s{any_delimiter}]+")))


def split_values(rows: DataFrame, spec: FieldSpec, most_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """(table_name, row_id, field, pos, val): one row for each value of the field, pos from 1 in the order of the text.

    Null, empty and blank fields, and fields of delimiters alone, give no row; a value that occurs twice gives two. Repeated rows are
    split each. A quote that isn't closed belongs to its value. A run with delimiters of the kind inside that known values don't cover wholly stays
    one value. Other columns are ignored, whatever their names.
    """
    spark = rows.sparkSession
    filled = rows.select(F.col(spec.key).cast("bigint").alias("row_id"), F.col(spec.name).alias("text")).where(F.col("text").rlike(r"\S"))
    # Only values that hold a delimiter change a cover.
    known = known_values(rows, spec).where("pieces > 1")
    size = known.agg(F.coalesce(F.sum(F.octet_length("v") + 16), F.lit(0)).alias("n"), F.coalesce(F.max("pieces"), F.lit(1)).alias("most")).first()
    if size["n"] <= most_bytes:
        shared = spark.sparkContext.broadcast((spec, [r["v"] for r in known.select("v").collect()]))
        out = filled.mapInArrow(_splitter(shared, False), _VALUES)
    else:
        shared = spark.sparkContext.broadcast((spec, []))
        numbered = cut(filled.withColumn("uid", F.monotonically_increasing_id()))
        spans = numbered.select("uid", "text").mapInArrow(_spans(shared, size["most"]), "uid bigint, at int, to int, v string")
        found = spans.join(known.select("v"), "v", "left_semi").groupBy("uid").agg(F.collect_list(F.struct("at", "to")).alias("known"))
        out = numbered.join(found, "uid", "left").select("row_id", "text", "known").mapInArrow(_splitter(shared, True), _VALUES)
    return out.select(F.lit(spec.table).alias("table_name"), "row_id", F.lit(spec.name).alias("field"), "pos", "val")


_VALUES = "row_id bigint, pos bigint, val string"


def _splitter(shared, given: bool):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(*shared.value)
        for batch in batches:
            ids, pos, vals = [], [], []
            places = batch.column(2).to_pylist() if given else [None] * batch.num_rows
            for key, text, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), places, strict=True):
                for k, v in enumerate(seg.split(text, [(x["at"], x["to"]) for x in known or ()] if given else None), 1):
                    ids.append(key)
                    pos.append(k)
                    vals.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int64()), pa.array(vals, pa.string())], ["row_id", "pos", "val"])

    return run


def _spans(shared, most: int):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = Segmenter(*shared.value)
        for batch in batches:
            rows = [(u, a, e, t[a:e]) for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for a, e in seg.spans(t, most)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["uid", "at", "to", "v"])

    return run


#: A whole morpheme id, or the mark of an unknown piece.
_ID = r"[^\s/]+/[A-Za-z0-9-]+|\?"
#: The fields of the linguistic tables that hold several values.
PACKED_FIELDS = [
    FieldSpec("locations", "row_id", "variant", ",;|/"),
    FieldSpec("undecomposable_composite_words", "row_id", "combination", ",;|+", "{}", "/", _ID),
    FieldSpec("roots_schneider", "row_id", "source", ",;|/&+"),
    FieldSpec("roots_schneider", "row_id", "cf", ",;|", "", "/", _ID),
]


def packed_values(spark: SparkSession, sf_dir: str, specs: list[FieldSpec] | None = None) -> DataFrame:
    """split_values of all fields that hold several values."""
    parts = [split_values(spark.read.parquet(f"{sf_dir}/{s.table}.parquet"), s) for s in specs or PACKED_FIELDS]
    return reduce(DataFrame.unionByName, parts)
