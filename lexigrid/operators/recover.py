"""Rows that fail to parse: valid records beside located errors.

A recursive-descent grammar reads comma-separated records. After an error it goes on at the next validated record start: the next
line of a table of lines, or, in the text of a whole file, the next line at which a record of the right width begins (recovered).
"""

from __future__ import annotations

import io
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrid.session import cut

#: Lines after which a quoted field that is still open counts as broken.
MOST_LINES = 1000


@dataclass(frozen=True)
class Fault:
    """reason and the offset in the text at which it shows; open if a quoted field has no end, blank if the line is empty."""

    reason: str
    at: int
    open: bool = field(default=False, compare=False)
    blank: bool = field(default=False, compare=False)


class Grammar:
    """record := field ("," field)*; field := quoted | bare; quoted := '"' (character | '""')* '"'; bare := characters but '"'.

    A record ends at stop, which no field runs over.
    """

    def __init__(self, text: str, delimiter: str = ",") -> None:
        self.text, self.delimiter = text, delimiter

    def record(self, at: int, stop: int) -> tuple[list[str] | Fault, int]:
        """The fields of the record at at, or the fault, and the offset where it ended."""
        fields: list[str] = []
        while True:
            value, at = self.field(at, stop)
            if isinstance(value, Fault):
                return value, at
            fields.append(value)
            if at >= stop or not self.text.startswith(self.delimiter, at):
                return fields, at
            at += 1

    def field(self, at: int, stop: int) -> tuple[str | Fault, int]:
        return self.quoted(at, stop) if self.text.startswith('"', at) and at < stop else self.bare(at, stop)

    def quoted(self, at: int, stop: int) -> tuple[str | Fault, int]:
        begin, i = at, at + 1
        while True:
            i = self.text.find('"', i, stop)
            if i < 0:
                return Fault("quoting", begin, open=True), stop
            if self.text.startswith('""', i) and i + 1 < stop:
                i += 2
                continue
            after = i + 1
            if after < stop and self.text[after] != self.delimiter:
                return Fault("quoting", after), after
            return self.text[begin + 1 : i].replace('""', '"'), after

    def bare(self, at: int, stop: int) -> tuple[str | Fault, int]:
        end = self.text.find(self.delimiter, at, stop)
        end = stop if end < 0 else end
        broken = self.text.find('"', at, end)
        return (self.text[at:end], end) if broken < 0 else (Fault("quoting", broken), broken)


def parse_line(line: str, width: int, delimiter: str = ",") -> list[str] | Fault:
    """The fields of one line, or the first fault: quoting before columns."""
    fields, end = Grammar(line, delimiter).record(0, len(line))
    if isinstance(fields, list) and len(fields) != width:
        return Fault("columns", end, blank=not line.strip())
    return fields


def recovered(lines: Iterable[str], width: int, delimiter: str = ",", most_lines: int = MOST_LINES) -> Iterator[tuple[int, list[str] | Fault]]:
    """(number of its first line from 0, fields or fault) of the records of a file's lines, in order; a quoted field may hold line breaks.

    A line at which a whole record of width fields stands by itself is a validated record start. While a quoted field is open, each
    further line is tested for being one: the quote is then taken as broken, a fault is given for the record in which it stands, and
    parsing goes on at that line. So it does when a field stays open for more than most_lines lines. After any other fault the next line is tried. Each
    line is read a bounded number of times and only the lines of an open record are held, so that the time grows with the text, whatever is broken.
    """
    todo: deque[str] = deque()
    source = iter(lines)
    number = 0

    def ahead(k: int) -> str | None:
        while len(todo) <= k:
            line = next(source, None)
            if line is None:
                return None
            todo.append(line)
        return todo[k]

    while (text := ahead(0)) is not None:
        taken, result = 1, None
        fields, end = Grammar(text, delimiter).record(0, len(text))
        if isinstance(fields, Fault) and fields.open:
            # The field is closed on a later line, or a record start shows that it is broken.
            parts, quotes = [text], None
            while quotes is None:
                more = ahead(taken)
                if more is None or taken >= most_lines or isinstance(parse_line(more, width, delimiter), list):
                    result = Fault("quoting", fields.at, True)
                    break
                parts.append(more)
                taken += 1
                # Only a line with a quote can close the field.
                if '"' in more:
                    whole = "\n".join(parts)
                    again, end = Grammar(whole, delimiter).record(0, len(whole))
                    if not (isinstance(again, Fault) and again.open):
                        quotes, fields = True, again
        if result is None:
            result = fields if isinstance(fields, Fault) or len(fields) == width else Fault("columns", end, blank=not text.strip())
        yield number, result
        for _ in range(taken):
            todo.popleft()
        number += taken


def parse_file(text: str, width: int, delimiter: str = ",") -> tuple[list[tuple[int, list[str]]], list[tuple[int, Fault]]]:
    """(line, fields) of the valid records of a text and (line, fault) of the others, by recovered."""
    records, faults = [], []
    for line, result in recovered(text.removesuffix("\n").split("\n") if text else [], width, delimiter):
        (faults if isinstance(result, Fault) else records).append((line, result))
    return records, faults


def parse_files(spark: SparkSession, path: str, names: list[str], delimiter: str = ",") -> DataFrame:
    """(file, line, names..., reason, at) of all records of the text files at path, with quoted fields that may hold line breaks: line is
    the number from 1 of a record's first line. Records that fail have null fields, a reason (quoting or columns) and the offset of the fault.

    A file whose quotes may span lines can only be read from its start, so that each is read by one task, line by line, and
    tasks are as many as files. Empty lines at a file's end are left out; an empty file gives nothing.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = ", ".join(["file string", "line bigint", *(f"`{n}` string" for n in names), "reason string", "at bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines = (x.rstrip("\r\n") for x in io.TextIOWrapper(io.BytesIO(content.as_buffer()), encoding="utf-8", errors="replace", newline="\n"))
                rows = ((n, r) for n, r in recovered(lines, len(names), delimiter) if not (isinstance(r, Fault) and r.blank))
                while held := list(islice(rows, 10_000)):
                    good = [r if isinstance(r, list) else [None] * len(names) for _, r in held]
                    faults = [None if isinstance(r, list) else r for _, r in held]
                    columns = [pa.array([g[k] for g in good], pa.string()) for k in range(len(names))]
                    ends = [pa.array([f and f.reason for f in faults], pa.string()), pa.array([None if f is None else f.at for f in faults], pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(held), pa.string()), pa.array([n + 1 for n, _ in held], pa.int64()), *columns, *ends], ["file", "line", *names, "reason", "at"])

    return files.mapInArrow(run, schema)


#: A check of a record's fields, which come without blanks at their ends: the reason if it fails, else None.
Check = Callable[[list[str]], str | None]


def parse_lines(lines: DataFrame, names: list[str], checks: Callable[[], list[Check]], key: str = "line_id", line: str = "line", delimiter: str = ",") -> DataFrame:
    """(key, names..., reason, at) of every row: its fields as strings where it is a good line, else nulls with the first
    reason that applies (quoting, columns, then the checks in order) and the offset of the fault.

    A null line fails with columns, as it has no field; an empty one has one field. Fields of good lines come without blanks at
    their ends; an empty field is an empty string. Repeated lines are parsed each. Other columns are ignored.
    """
    kind = lines.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", *(f"`{n}` string" for n in names), "reason string", "at bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = checks()
        for batch in batches:
            # One text for the batch; its record starts are known from the rows.
            texts = batch.column(1).to_pylist()
            grammar = Grammar("".join(t or "" for t in texts), delimiter)
            columns: list[list] = [[] for _ in names]
            reasons, places, at = [], [], 0
            for t in texts:
                stop = at + len(t or "")
                fields, end = grammar.record(at, stop) if t is not None else (Fault("columns", at), at)
                if isinstance(fields, list):
                    if len(fields) != len(names):
                        fields = Fault("columns", end)
                    else:
                        fields = [f.strip() for f in fields]
                        reason = next((r for test in tests if (r := test(fields))), None)
                        fields = Fault(reason, at) if reason else fields
                good = isinstance(fields, list)
                for k, c in enumerate(columns):
                    c.append(fields[k] if good else None)
                reasons.append(None if good else fields.reason)
                places.append(None if good else fields.at - at)
                at = stop
            arrays = [batch.column(0), *(pa.array(c, pa.string()) for c in columns), pa.array(reasons, pa.string()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [key, *names, "reason", "at"])

    return lines.select(key, line).mapInArrow(run, schema)


#: The fields of a noun-ending line in order.
NOUN_ENDING_FIELDS = "morpheme type case number perPoss numbPoss V-form V-action1 V-action2 t-form t-action1 t-action2 k-form k-action1 k-action2 q-form q-action1 q-action2 condPrec sources".split()
#: The letters of a form.
FORM_LETTERS = "aiuptkgmnsljvrq"
#: Bytes of action codes that are broadcast; more are joined.
CODE_BYTES = 8 << 20


def noun_ending_checks(codes: frozenset[str] | None) -> list[Check]:
    """The checks of V-form, V-action1 and condPrec; without codes, actions are only counted."""
    forms = re.compile(rf"(?:-|[{FORM_LETTERS}]+)(?: (?:-|[{FORM_LETTERS}]+))*")
    conditions = re.compile(r"!?[a-z0-9]+:[a-z0-9]+(?:,!?[a-z0-9]+:[a-z0-9]+)*")
    form, action, condition = (NOUN_ENDING_FIELDS.index(x) for x in ("V-form", "V-action1", "condPrec"))
    return [
        lambda f: None if forms.fullmatch(f[form]) else "v-form",
        lambda f: None if len(a := f[action].split(" ")) == len(f[form].split(" ")) and (codes is None or codes.issuperset(a)) else "v-action1",
        lambda f: None if not f[condition] or conditions.fullmatch(f[condition]) else "condprec",
    ]


def noun_endings(lines: DataFrame, actions: DataFrame, most_bytes: int = CODE_BYTES) -> DataFrame:
    """parse_lines of noun-ending lines against the codes of actions (code). A list of codes of up to most_bytes is broadcast; with a longer one the
    actions of the lines are joined with it. line_id is unique.
    """
    valid = actions.select("code").where(F.col("code").isNotNull()).distinct()
    if (valid.agg(F.sum(F.octet_length("code") + 16)).first()[0] or 0) <= most_bytes:
        codes = frozenset(r["code"] for r in valid.collect())
        return parse_lines(lines, NOUN_ENDING_FIELDS, lambda: noun_ending_checks(codes))
    # Conditions come after actions, so that a line that fails by its condition is asked for its actions too.
    parsed = cut(parse_lines(lines, NOUN_ENDING_FIELDS, lambda: noun_ending_checks(None)[:2]))
    used = parsed.where("reason IS NULL").select("line_id", F.explode(F.array_distinct(F.split("V-action1", " "))).alias("code"))
    bad = used.join(valid, "code", "left_anti").select("line_id", F.lit(True).alias("bad")).distinct()
    condition = (F.col("condPrec") != "") & ~F.col("condPrec").rlike(r"^!?[a-z0-9]+:[a-z0-9]+(?:,!?[a-z0-9]+:[a-z0-9]+)*$")
    out = parsed.join(bad, "line_id", "left").withColumn("why", F.coalesce("reason", F.when(F.col("bad"), "v-action1").when(condition, "condprec")))
    names = [F.when(F.col("why").isNull(), F.col(n)).alias(n) for n in NOUN_ENDING_FIELDS]
    return out.select("line_id", *names, F.col("why").alias("reason"), F.when(F.col("why").isNotNull(), F.coalesce("at", F.lit(0))).alias("at"))


def typed_endings(records: DataFrame) -> DataFrame:
    """Good records of noun endings with their types: persons as numbers (null if empty or no number), lists as arrays, empty texts as nulls,
    conditions as array of struct(attr, val, negated).
    """
    text = lambda n: F.nullif(F.col(n), F.lit(""))
    items = lambda n, sep: F.when(F.col(n) != "", F.split(F.col(n), sep))

    def condition(x: Column) -> Column:
        bare = F.regexp_replace(x, "^!", "")
        return F.struct(F.substring_index(bare, ":", 1).alias("attr"), F.substring_index(bare, ":", -1).alias("val"), x.startswith("!").alias("negated"))

    plain = [text(n).alias(n) for n in ("morpheme", "type", "case", "number")]
    numbers = [F.expr(f"TRY_CAST({n} AS INT)").alias(n) for n in ("perPoss",)]
    forms = [items(n, " ").alias(n) for n in NOUN_ENDING_FIELDS if n[1:2] == "-"]
    return records.select("line_id", *plain, *numbers, text("numbPoss").alias("numbPoss"), *forms, F.transform(items("condPrec", ","), condition).alias("condPrec"), F.transform(items("sources", ","), lambda x: F.trim(x)).alias("sources"))
