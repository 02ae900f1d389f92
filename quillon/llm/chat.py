"""Chat formatting by grammar round trip.

Grammar: ``conversation = { turn }``, ``turn = "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"``.
A turn is rendered plainly, read back by the deterministic parser and compared with its source; while
they differ its content is escaped.  Escaping puts one backslash into every ``<\\...\\|`` of the text,
so no control string can stand in it, and reading takes one away.

Defined cases: null role or text counts as empty; turns are ordered by turn, then role, then text,
nulls first; repeated rows are turns of their own; rows with a null conv_id form one conversation;
columns other than conv_id, turn, role and text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_schema, map_batches, schema

START, END = "<|im_start|>", "<|im_end|>"
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_HEAD = re.compile(r"[\\\n|]")
_HEAD_CODE = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}
_HEAD_BACK = {v: k for k, v in _HEAD_CODE.items()}


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return _HEAD.sub(lambda m: _HEAD_CODE[m[0]], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\[\\np]", lambda m: _HEAD_BACK[m[0]], role)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns as (role, text, start, end): start and end of the still escaped text in ``formatted``."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"a turn must begin at {at}")
        line = formatted.find("\n", at)
        close = formatted.find(END + "\n", line + 1)
        if line < 0 or close < 0:
            raise ValueError(f"the turn at {at} does not end")
        role, text = formatted[at + len(START) : line], formatted[line + 1 : close]
        if "|" in role or START in text or END in text:
            raise ValueError(f"control string inside the turn at {at}")
        out.append((unescape_role(role), unescape(text), line + 1, close))
        at = close + len(END) + 1
    return out


def render(role: str, text: str) -> str:
    """One turn, escaped only as far as its round trip needs."""
    for head, body in ((role, text), (escape_role(role), text), (escape_role(role), escape(text))):
        formatted = f"{START}{head}\n{body}{END}\n"
        try:
            turns = parse(formatted)
        except ValueError:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return formatted
    raise AssertionError("an escaped turn always reads back")


def format_turns(conversations: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each row with its rendered ``piece`` and the loss mask's bounds in it (code points; null: no loss).

    Row-local; the pieces of a conversation, joined in order, are its formatted text.
    """

    def make() -> Callable:
        def one(batch: pa.RecordBatch):
            pieces, begins, ends = [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                pieces.append(render(role or "", text or ""))
                (_, _, a, b) = parse(pieces[-1])[0]
                begins.append(a if role in trained else None)
                ends.append(b if role in trained else None)
            yield {c: batch.column(c) for c in ("conv_id", "turn", "role", "text")} | {"piece": pieces, "loss_start": begins, "loss_end": ends}

        return one

    kinds = dict(conversations.dtypes)
    return map_batches(
        conversations.select("conv_id", "turn", "role", "text"),
        make,
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, piece string, loss_start bigint, loss_end bigint",
    )


def in_order(turns: DataFrame) -> DataFrame:
    """Rows dealt by conversation and sorted in it, so that a task can stream each one; no group is collected."""
    return turns.repartition(F.col("conv_id")).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")])


def assemble(conversations: DataFrame) -> DataFrame:
    """conv_id, the whole formatted text, and the loss spans in it: array of (start, end) in code points."""
    kind = dict(conversations.dtypes)["conv_id"]
    return _streamed(conversations, f"conv_id {kind}, formatted string, loss array<struct<start:bigint,end:bigint>>", _Whole)


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns, each read back from the formatted pieces."""
    kind = dict(conversations.dtypes)["conv_id"]
    return _streamed(
        conversations,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
        _Digest,
    )


class _Whole:
    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.spans: list[dict] = []
        self.length = 0

    def add(self, piece: str, a: int | None, b: int | None) -> None:
        if a is not None:
            self.spans.append({"start": self.length + a, "end": self.length + b})
        self.pieces.append(piece)
        self.length += len(piece)

    def row(self, conv) -> dict:
        return {"conv_id": conv, "formatted": "".join(self.pieces), "loss": self.spans}


class _Digest:
    """Running digests; holds no turn."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, a: int | None, b: int | None) -> None:
        for role, text, _, _ in parse(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if a is not None:
            masked = unescape(piece[a:b])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.chars += len(piece)

    def row(self, conv) -> dict:
        return {"conv_id": conv, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def _streamed(conversations: DataFrame, ddl: str, state: type) -> DataFrame:
    want = arrow_schema(ddl)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, rows = None, None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end")]
            for conv, piece, a, b in zip(*columns, strict=True):
                if held is None or conv != now:
                    if held is not None:
                        rows.append(held.row(now))
                    now, held = conv, state()
                held.add(piece, a, b)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=want)
                rows = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.row(now)], schema=want)

    turns = in_order(format_turns(conversations)).select("conv_id", "piece", "loss_start", "loss_end")
    return turns.mapInArrow(task, schema(ddl))
