"""Encoding of texts by a public byte-level BPE vocabulary, without merging.

For a piece of text every prefix has an encoding of its own, and that encoding's last token is all that has to be stored: a
token that ends the prefix is the last one exactly if the last token before it may stand beside it, that is, if the merges
never cross the border between the two. An automaton over the vocabulary gives all tokens that end at each byte; the last
one's way back gives the ids. The time grows in proportion to the piece, however long it is.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZERS = os.environ.get("LEXIGRID_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the published pattern that cuts a text into pieces, to be read with the module regex.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and pairs that a worker remembers; when there are more it starts anew.
REMEMBERED = 400_000
#: Ids that one batch of a worker's result holds at most, plus one text's.
BATCH_IDS = 1_000_000


class PrefixEncoder:
    """ranks: token's bytes -> id; the ids are in the order of the merges, single bytes first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick
        import regex

        self.cut = regex.compile(PIECES)
        self.size = {i: len(b) for b, i in ranks.items()}
        self.made = self._halves(ranks)
        self.pair = {halves: i for i, halves in self.made.items()}
        # Tokens that end at a byte come from an automaton; bytes stand for themselves as characters.
        self.matches = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.matches.add_word(b.decode("latin-1"), (len(b), i))
        self.matches.make_automaton()
        self.beside: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
        """id -> the two tokens of whose merge it is made: what merging its bytes by the lower ranks alone ends with."""
        made = {}
        for b, i in ranks.items():
            if len(b) > 1:
                parts = [b[k : k + 1] for k in range(len(b))]
                while len(parts) > 2:
                    rank, k = min((ranks.get(parts[k] + parts[k + 1], i), k) for k in range(len(parts) - 1))
                    if rank >= i:
                        raise ValueError(f"token {i} can't be made of tokens before it")
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                made[i] = (ranks[parts[0]], ranks[parts[1]])
        return made

    def may_stand_beside(self, a: int, b: int) -> bool:
        """Whether a then b is the encoding of their bytes.

        Of a the parts at its right end meet those at b's left end. A part lives from its own merge to that of the next
        larger part. The border falls if two parts that live at one time have a merge that comes before both ends; of
        equal merges the one further left comes first.
        """
        key = (a, b)
        out = self.beside.get(key)
        if out is None:
            right, left = [a], [b]
            while right[-1] in self.made:
                right.append(self.made[right[-1]][1])
            while left[-1] in self.made:
                left.append(self.made[left[-1]][0])
            never = 1 << 60
            i, j, out = len(right) - 1, len(left) - 1, True
            while i >= 0 and j >= 0:
                end_a, end_b = right[i - 1] if i else never, left[j - 1] if j else never
                merge = self.pair.get((right[i], left[j]), never)
                if merge < end_a and merge <= end_b and merge < never:
                    out = False
                    break
                if end_a <= end_b:
                    i -= 1
                else:
                    j -= 1
                if end_a == end_b == never:
                    break
            if len(self.beside) > REMEMBERED:
                self.beside.clear()
            self.beside[key] = out
        return out

    def piece(self, text: str) -> tuple[int, ...]:
        """The ids of one piece."""
        out = self.known.get(text)
        if out is not None:
            return out
        data = text.encode("utf-8").decode("latin-1")
        last = array("i", [-1]) * (len(data) + 1)
        size, beside = self.size, self.may_stand_beside
        for end, (length, token) in self.matches.iter(data):
            start = end + 1 - length
            if last[end + 1] < 0 and (not start or last[start] >= 0 and beside(last[start], token)):
                last[end + 1] = token
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= size[last[at]]
        out = tuple(reversed(ids))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.known[text] = out
        return out

    def encode(self, text: str | None) -> array:
        """The ids of a text; none for an empty or a null one."""
        ids = array("i")
        known, piece = self.known, self.piece
        for m in self.cut.finditer(text or ""):
            x = m[0]
            ids.extend(known.get(x) or piece(x))
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines with a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_encoders: dict[str, PrefixEncoder] = {}


def _encoder(name: str, content: bytes) -> PrefixEncoder:
    """One for each worker process and vocabulary."""
    if name not in _encoders:
        _encoders[name] = PrefixEncoder({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())})
    return _encoders[name]


def _lists(ids: list[array]) -> pa.Array:
    ends, flat, total = array("i", [0]), array("i"), 0
    for x in ids:
        flat.extend(x)
        total += len(x)
        ends.append(total)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>) of every row: the ids of its text without special tokens, an empty list for an empty or null
    text. Texts that spell a special token are ordinary ones. Repeated rows are encoded each; other columns are ignored.
    The vocabulary's file is read on the driver and broadcast, about a MB.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_mapper(docs.sparkSession, vocabulary, folder, True), f"`{key}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens bigint) of every row; 0 for an empty or null text."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(_mapper(docs.sparkSession, vocabulary, folder, False), f"`{key}` {kind}, n_tokens bigint")


def decode_texts(rows: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) of every row: the text that its ids spell, an empty one for an empty or null list."""
    with open(os.path.join(folder, vocabulary), "rb") as f:
        content = rows.sparkSession.sparkContext.broadcast(f.read())
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = {int(b): base64.b64decode(a) for a, b in (line.split() for line in content.value.splitlines() if line.strip())}
        for batch in batches:
            texts = [b"".join(by_id[i] for i in x or ()).decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [batch.schema.names[0], "text"])

    return rows.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def _mapper(spark: SparkSession, vocabulary: str, folder: str, whole: bool):  # noqa: ANN202
    with open(os.path.join(folder, vocabulary), "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocabulary, content.value)
        for batch in batches:
            key, names = batch.column(0), [batch.schema.names[0], "ids" if whole else "n_tokens"]
            texts, at, begun, held, n_held = batch.column(1), 0, 0, [], 0
            for at in range(batch.num_rows):
                ids = enc.encode(texts[at].as_py())
                held.append(ids if whole else len(ids))
                n_held += len(ids) if whole else 0
                if n_held > BATCH_IDS or at == batch.num_rows - 1:
                    values = _lists(held) if whole else pa.array(held, pa.int64())
                    yield pa.RecordBatch.from_arrays([key.slice(begun, at + 1 - begun), values], names)
                    begun, held, n_held = at + 1, [], 0

    return run


def decode_ids(ids: list[int], ranks: dict[bytes, int]) -> str:
    """Round trip of a text, for tests."""
    by_id = {i: b for b, i in ranks.items()}
    return b"".join(by_id[i] for i in ids).decode("utf-8")
