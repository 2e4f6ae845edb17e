"""Weighted transducers in the published optimized-lookup format: reading the binary file and looking words up.

A file has a header, an alphabet, a table of indexes (input symbol and target, six bytes) and a table of transitions (input, output, target, weight,
twelve bytes). A state is a place in one of the two tables; those of the second are marked by an offset of 2^31.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_SYMBOL, NO_INDEX, SECOND = 0xFFFF, 0xFFFFFFFF, 1 << 31


@dataclass
class Transducer:
    """symbols by number, 0 the empty one; n_input of them may be read."""

    symbols: list[str]
    n_input: int
    weighted: bool
    index_input: np.ndarray
    index_target: np.ndarray
    input: np.ndarray
    output: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    flags: dict[int, tuple[str, str, str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.number = {s: i for i, s in reversed(list(enumerate(self.symbols))) if i and i < self.n_input and not s.startswith("@")}
        self.longest = max(map(len, self.number), default=1)
        for i, s in enumerate(self.symbols):
            parts = s.strip("@").split(".")
            if len(s) > 4 and s[0] == s[-1] == "@" and s[2] == "." and s[1] in "PNRDCU":
                self.flags[i] = (parts[0], parts[1], ".".join(parts[2:]))

    def tokens(self, word: str) -> list[int] | None:
        """Numbers of a word's symbols, the longest one first; None if a character is none."""
        out, at = [], 0
        while at < len(word):
            n = next((k for k in range(min(self.longest, len(word) - at), 0, -1) if word[at : at + k] in self.number), 0)
            if not n:
                return None
            out.append(self.number[word[at : at + n]])
            at += n
        return out

    def _final(self, state: int) -> float | None:
        """The weight with which a state ends a word, None where it doesn't."""
        if state >= SECOND:
            i = state - SECOND
            return float(self.weight[i]) if self.input[i] == NO_SYMBOL and self.output[i] == NO_SYMBOL and self.target[i] == 1 else None
        if self.index_input[state] != NO_SYMBOL or self.index_target[state] == NO_INDEX:
            return None
        return struct.unpack("<f", struct.pack("<I", int(self.index_target[state])))[0] if self.weighted else 0.0

    def _moves(self, state: int, symbol: int) -> Iterator[int]:
        """Places of the transitions of a state that read symbol."""
        if state >= SECOND:
            i = state - SECOND + 1
        else:
            at = state + 1 + symbol
            if at >= len(self.index_input) or self.index_input[at] != symbol:
                return
            i = int(self.index_target[at]) - SECOND
        while i < len(self.input) and self.input[i] != NO_SYMBOL:
            if self.input[i] == symbol:
                yield i
            elif self.input[i] > symbol:
                return
            i += 1

    def _flagged(self, values: dict[str, tuple[bool, str]], flag: tuple[str, str, str]) -> dict | None:
        """The values after a flag, None if it isn't satisfied: P sets, N sets the contrary, R requires, D disallows, C clears, U unifies."""
        op, name, value = flag
        now = values.get(name)
        if op == "P":
            return {**values, name: (True, value)}
        if op == "N":
            return {**values, name: (False, value)}
        if op == "C":
            return {k: v for k, v in values.items() if k != name}
        same = now is not None and (not value or (now[0] and now[1] == value) or (not now[0] and now[1] != value))
        if op == "R":
            return values if same else None
        if op == "D":
            return None if same else values
        if now is None or same:
            return values if same and now[0] else {**values, name: (True, value)}
        return None

    def lookup(self, word: str, most: int | None = None) -> list[tuple[str, float]]:
        """(output, weight) of all paths that read word, cheapest first, each output once with its least weight. Loops that read nothing are followed once
        for each state and place.
        """
        read = self.tokens(word)
        if read is None:
            return []
        found: dict[str, float] = {}
        todo: list[tuple[int, int, str, float, dict, frozenset]] = [(0, 0, "", 0.0, {}, frozenset())]
        while todo:
            state, at, text, cost, values, seen = todo.pop()
            if at == len(read) and (end := self._final(state)) is not None:
                found[text] = min(found.get(text, cost + end), cost + end)
            key = (state, at)
            for symbol in [0, *self.flags] if key not in seen else ():
                for i in self._moves(state, symbol):
                    after = values if symbol == 0 else self._flagged(values, self.flags[symbol])
                    if after is not None:
                        out = "" if int(self.output[i]) in self.flags else self.symbols[self.output[i]] if self.output[i] else ""
                        todo.append((int(self.target[i]), at, text + out, cost + float(self.weight[i]), after, seen | {key}))
            if at < len(read):
                for i in self._moves(state, read[at]):
                    out = self.symbols[self.output[i]] if self.output[i] else ""
                    todo.append((int(self.target[i]), at + 1, text + out, cost + float(self.weight[i]), values, frozenset()))
        ordered = sorted(found.items(), key=lambda x: (x[1], x[0]))
        return ordered if most is None else ordered[:most]


def read_transducer(data: bytes) -> Transducer:
    """A transducer from a file's bytes; ValueError for another format."""
    at = 0
    if data[:5] == b"HFST\0":
        # A header of named values stands before the numbers.
        (length,) = struct.unpack_from("<H", data, 5)
        at = 8 + length
    numbers = struct.unpack_from("<HHIIII9I", data, at)
    n_input, n_symbols, n_index, n_transitions, _, _, weighted = numbers[:7]
    at += struct.calcsize("<HHIIII9I")
    symbols = []
    for _ in range(n_symbols):
        end = data.index(b"\0", at)
        symbols.append(data[at:end].decode("utf-8"))
        at = end + 1
    symbols[0] = ""
    index = np.frombuffer(data, np.dtype([("input", "<u2"), ("target", "<u4")]), n_index, at)
    at += index.nbytes
    kind = [("input", "<u2"), ("output", "<u2"), ("target", "<u4"), *([("weight", "<f4")] if weighted else [])]
    moves = np.frombuffer(data, np.dtype(kind), n_transitions, at)
    if at + moves.nbytes > len(data):
        raise ValueError("the file ends too early")
    weight = moves["weight"] if weighted else np.zeros(n_transitions, "f4")
    return Transducer(symbols, n_input, bool(weighted), index["input"], index["target"], moves["input"], moves["output"], moves["target"], weight)


def write_transducer(arcs: list[tuple[int, str, str, int, float]], finals: dict[int, float]) -> bytes:
    """The file of a transducer of arcs (from, input, output, to, weight), state 0 the first; every state lies in the table of transitions but the first."""
    symbols = ["", *sorted({x for _, a, b, _, _ in arcs for x in (a, b) if x})]
    of = {s: i for i, s in enumerate(symbols)}
    states = sorted({0, *finals, *(x for a, _, _, b, _ in arcs for x in (a, b))})
    rows = {s: sorted((of[i], of[o], t, w) for f, i, o, t, w in arcs if f == s) for s in states}
    place, n = {}, 0
    for s in states:
        place[s] = n
        n += len(rows[s]) + 1
    moves = b""
    for s in states:
        moves += struct.pack("<HHIf", NO_SYMBOL, NO_SYMBOL, 1 if s in finals else NO_INDEX, finals.get(s, 0.0))
        moves += b"".join(struct.pack("<HHIf", i, o, place[t] + SECOND, w) for i, o, t, w in rows[s])
    moves += struct.pack("<HHIf", NO_SYMBOL, NO_SYMBOL, NO_INDEX, 0.0)
    index = struct.pack("<HI", NO_SYMBOL, struct.unpack("<I", struct.pack("<f", finals[0]))[0] if 0 in finals else NO_INDEX)
    for i in range(len(symbols)):
        first = next((place[0] + 1 + k for k, r in enumerate(rows[0]) if r[0] == i), None)
        index += struct.pack("<HI", NO_SYMBOL, NO_INDEX) if first is None else struct.pack("<HI", i, first + SECOND)
    head = struct.pack("<HHIIII9I", len(symbols), len(symbols), len(symbols) + 1, n + 1, len(states), len(arcs), 1, *[0] * 8)
    return head + b"".join(s.encode() + b"\0" for s in symbols) + index + moves


def lookups(words: DataFrame, path: str, most: int | None = None) -> DataFrame:
    """(word, status, outputs, weights) of each distinct word by the transducer in the file at path: found, none or unreadable (a character that it doesn't know). The
    file, some megabytes, is read on the driver and broadcast. Null and empty words are left out.
    """
    spark: SparkSession = words.sparkSession
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    shared = spark.sparkContext.broadcast(bytes(content))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = read_transducer(shared.value)
        for b in batches:
            texts = b.column(0).to_pylist()
            got = [machine.lookup(w, most) for w in texts]
            status = ["found" if g else "none" if machine.tokens(w) is not None else "unreadable" for w, g in zip(texts, got, strict=True)]
            arrays = [pa.array(status, pa.string()), pa.array([[o for o, _ in g] for g in got], pa.list_(pa.string())), pa.array([[w for _, w in g] for g in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["word", "status", "outputs", "weights"])

    rows = words.select(F.col("word")).where("word IS NOT NULL AND word <> ''").distinct()
    return rows.mapInArrow(run, "word string, status string, outputs array<string>, weights array<double>")
