"""Questions to a service, through a client that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Reply:
    """status is ok, unauthorized, insufficient or failed; text is null unless ok."""

    status: str
    text: str | None = None
    tokens_in: int = 0
    tokens_out: int = 0
    message: str | None = None


Client = Callable[[str], Reply]


def ask(rows: DataFrame, key: str, prompt: str, make_client: Callable[[], Client]) -> DataFrame:
    """(key, status, text, tokens_in, tokens_out, message) of each row's prompt. make_client is called once for each task; an exception of a client is a failed
    reply. After an unauthorized or insufficient reply the rest of the task isn't asked and gets that status. A null prompt fails.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, stopped = make_client(), None
        for b in batches:
            out = []
            for p in b.column(1).to_pylist():
                if stopped is None:
                    try:
                        reply = Reply("failed", message="no prompt") if p is None else client(p)
                    except Exception as e:  # noqa: BLE001
                        reply = Reply("failed", message=str(e) or type(e).__name__)
                    if reply.status in ("unauthorized", "insufficient"):
                        stopped = reply
                else:
                    reply = Reply(stopped.status, message=stopped.message)
                out.append(reply)
            columns = [pa.array([getattr(r, c) for r in out], t) for c, t in (("status", pa.string()), ("text", pa.string()), ("tokens_in", pa.int64()), ("tokens_out", pa.int64()), ("message", pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [key, "status", "text", "tokens_in", "tokens_out", "message"])

    return rows.select(key, prompt).mapInArrow(run, f"`{key}` {kind}, status string, text string, tokens_in bigint, tokens_out bigint, message string")


def next_turn(turns: list[tuple[str, str]], question: str, client: Client) -> tuple[list[tuple[str, str]], Reply]:
    """The turns (role, text) of a conversation with one more question and, if it went well, the answer."""
    asked = [*turns, ("user", question)]
    try:
        reply = client("\n".join(f"{r}: {t}" for r, t in asked))
    except Exception as e:  # noqa: BLE001
        reply = Reply("failed", message=str(e) or type(e).__name__)
    return ([*asked, ("assistant", reply.text or "")] if reply.status == "ok" else turns), reply
