"""Where each token of an encoding lies in its text, for the pipeline."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from quillon.functions.models import META, Model, shared_model
from quillon.schema import Vocab

LAYOUT = "struct<ids:array<bigint>,tokens:array<string>,words:array<int>,offsets:array<struct<start:int,end:int>>>"
#: Bytes of text whose encodings are held at a time, or one row's; they take some ten times as much.
SLICE_BYTES = 1 << 18


def edges_of(text: str, piece: str, at: int, byte_of: dict[str, int]) -> list[int]:
    """Places in the text of the piece's character boundaries, looked for from ``at`` on.

    A piece may be the text itself, or have its bytes written as characters, or marks for its spaces and
    one in front; a piece that is nowhere stands at ``at`` without width.
    """
    k = text.find(piece, at)
    if k >= 0:
        return list(range(k, k + len(piece) + 1))
    if all(c in byte_of for c in piece):
        raw = bytes(byte_of[c] for c in piece)
        plain = raw.decode("utf-8", "ignore")
        k = text.find(plain, at)
        if k < 0 and plain.startswith(" "):
            k = text.find(plain[1:], at) - 1 if plain[1:] in text[at:] else -2
        if k >= -1:
            out, now = [max(k, at)], k
            for b in raw:
                now += b & 0xC0 != 0x80
                out.append(max(now, at))
            return out
    core = piece.lstrip(META)
    k = text.find(core, at) if core else at
    lead = len(piece) - len(core)
    return [max(at, k - lead + i) for i in range(len(piece) + 1)] if k >= 0 else [at] * (len(piece) + 1)


def layouts(model: Model, rows: Iterable[tuple[str | None, list[str] | None]], byte_of: dict[str, int], whole: bool) -> pa.StructArray:
    """ids, tokens, words and offsets of texts, or of their pieces; ``whole``: the model's own fragments are the words."""
    ids, words, starts, ends = array("q"), array("i"), array("i"), array("i")
    lengths, missing = [0], []
    walks = model.walks
    for text, pieces in rows:
        missing.append(text is None or (pieces is None and not whole))
        if not missing[-1]:
            at = 0
            for w, (piece, found) in enumerate(model.parts(text) if whole else ((p, walks[p]) for p in pieces)):
                place = text.find(piece, at)
                edges = range(place, place + len(piece) + 1) if place >= 0 else edges_of(text, piece, at, byte_of)
                for k, start, end in found:
                    ids.append(k)
                    words.append(w)
                    starts.append(edges[start])
                    ends.append(edges[end])
                at = max(at, edges[-1])
        lengths.append(len(ids))
    offsets = pa.array(lengths, pa.int32())
    places = pa.StructArray.from_arrays([_flat(starts, np.int32), _flat(ends, np.int32)], ["start", "end"])
    columns = [_flat(ids, np.int64), pa.array(model.tokens(ids), pa.string()), _flat(words, np.int32), places]
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, c) for c in columns], ["ids", "tokens", "words", "offsets"], mask=pa.array(missing, pa.bool_()))


def _flat(values: array, kind: type) -> pa.Array:
    return pa.array(np.frombuffer(values, kind) if values else np.zeros(0, kind))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of about SLICE_BYTES of text, or one row."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > start and held + n > SLICE_BYTES:
            yield start, i - start
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts) - start


def lay_out(text: Column, vocab: Vocab, pieces: Column | None = None) -> Column:
    """ids, tokens, words and offsets (characters) of each text, or of its pieces in order.

    Encodings leave the worker in slices, so what it and the JVM hold does not grow with an Arrow batch.
    """
    from quillon.operators.pretokenize import byte_alphabet

    byte_of = {c: b for b, c in enumerate(byte_alphabet())}

    if pieces is None:

        @arrow_udf(LAYOUT)
        def whole(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = shared_model(vocab)
            for texts in batches:
                for start, n in _slices(texts):
                    yield layouts(model, ((t, None) for t in texts.slice(start, n).to_pylist()), byte_of, True)

        return whole(text)

    @arrow_udf(LAYOUT)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = shared_model(vocab)
        for texts, parts in batches:
            for start, n in _slices(texts):
                rows = zip(texts.slice(start, n).to_pylist(), parts.slice(start, n).to_pylist(), strict=True)
                yield layouts(model, rows, byte_of, False)

    return cut(text, pieces)
