"""Binary SentencePiece models: the vocabulary in a protocol buffer, by the public field numbers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from quillon.schema import Vocab

#: Field numbers of the model, of a piece and of the trainer's settings; kinds of models.
PIECE, TRAINER = 1, 2
TEXT, SCORE, TYPE = 1, 2, 3
MODEL_TYPE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 40, 41, 42, 43
KINDS = {1: "unigram", 2: "spm"}
#: Ids where the settings name none.
USUAL = {UNK_ID: 0, BOS_ID: 1, EOS_ID: 2, PAD_ID: -1}


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and the place after it."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("the data end inside a number")
        if shift > 63:
            raise ValueError("a number is too long")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields; values of fixed width and strings are bytes."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            n, at = varint(data, at) if kind == 2 else ({1: 8, 5: 4}.get(kind, -1), at)
            if n < 0:
                raise ValueError(f"fields of kind {kind} are not read")
            if at + n > len(data):
                raise ValueError("the data end inside a field")
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def decode(data: bytes) -> Vocab:
    """The vocabulary with scores and types; ids are places."""
    tokens: list[str] = []
    scores: list[float] = []
    types: list[int] = []
    settings: dict[int, int] = {}
    for number, value in fields(data):
        if number == PIECE and isinstance(value, bytes):
            one = dict(fields(value))
            tokens.append(bytes(one.get(TEXT, b"")).decode("utf-8", "replace"))
            scores.append(struct.unpack("<f", one.get(SCORE, bytes(4)))[0])
            types.append(one.get(TYPE, 1))
        elif number == TRAINER and isinstance(value, bytes):
            settings |= {k: signed(v) for k, v in fields(value) if isinstance(v, int)}
    ids = {name: i if 0 <= (i := settings.get(k, USUAL[k])) < len(tokens) else None for name, k in (("unk", UNK_ID), ("bos", BOS_ID), ("eos", EOS_ID), ("pad", PAD_ID))}
    return Vocab(KINDS.get(settings.get(MODEL_TYPE, 1), "spm"), tuple(tokens), scores=tuple(scores), token_type=tuple(types), **ids)
