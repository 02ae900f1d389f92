"""Encoding text columns by Arrow-batched kernels; expressions for small vocabularies are there for comparison."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.arrow import list_of
from quillon.functions.models import META, Bpe, Unigram, shared_model, space_mark
from quillon.functions.regex import longest_of
from quillon.operators.pretokenize import bpe, find_all
from quillon.schema import Vocab

#: Vocabularies up to this size become an expression; a map expression is searched entry by entry, so larger ones go to the kernel.
NATIVE_TOKENS = 256


def _map(vocab: Vocab) -> Column:
    return F.create_map(*[F.lit(x) for t, k in vocab.ids().items() for x in (t, int(k))]).cast("map<string,bigint>")


def meta(c: Column) -> Column:
    """Spaces as ▁, with one in front."""
    return F.when(c == "", c).otherwise(F.concat(F.lit(META), F.regexp_replace(c, r"[ \t\n\r]", META)))


def pieces(c: Column, vocab: Vocab) -> Column:
    """Longest vocabulary entries, and single characters where there is none."""
    return find_all(c, longest_of(list(vocab.tokens)))


def to_ids(found: Column, vocab: Vocab) -> Column:
    """Ids of pieces by model: an unknown character is the unknown id, or left out, or written by its value."""
    table = _map(vocab)
    if vocab.model == "bpe":
        value = lambda p: F.when(F.ascii(p) < 128, F.ascii(p).cast("bigint")).otherwise(-(F.ascii(p) + 1).cast("bigint"))
        unknown = value if vocab.unk is None else (lambda p: F.lit(vocab.unk).cast("bigint"))
        return F.transform(found, lambda p: F.coalesce(F.try_element_at(table, p), unknown(p)))
    ids = F.transform(found, lambda p: F.coalesce(F.try_element_at(table, p), F.lit(vocab.unk).cast("bigint")))
    if vocab.model == "unigram":
        return F.when(F.exists(ids, lambda i: i.isNull()), F.array().cast("array<bigint>")).otherwise(ids)
    return F.filter(ids, lambda i: i.isNotNull())


def framed(ids: Column, vocab: Vocab, text: Column) -> Column:
    """With the begin and end ids where these are configured; empty text has none."""
    parts = [F.array(F.lit(i).cast("bigint")) for i, on in ((vocab.bos, vocab.add_bos),) if on and i is not None]
    parts += [ids] + [F.array(F.lit(i).cast("bigint")) for i, on in ((vocab.eos, vocab.add_eos),) if on and i is not None]
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.concat(*parts))


def encode_native(c: Column, vocab: Vocab) -> Column:
    """Expression for byte-pair, SentencePiece and unigram vocabularies without entries that begin with <, [ or #."""
    if vocab.model == "wordpiece" or len(vocab.tokens) > NATIVE_TOKENS or (vocab.model == "bpe" and any(t[:1] in ("<", "[", "#") and len(t) > 1 for t in vocab.tokens)):
        raise ValueError("this vocabulary needs the kernel")
    if vocab.model != "bpe":
        return framed(to_ids(pieces(meta(c), vocab), vocab), vocab, c)
    fragments = bpe(vocab.pre_type, space_mark(vocab))(c)
    ids = F.flatten(F.transform(fragments, lambda f: to_ids(pieces(f, vocab), vocab)))
    whole = F.try_element_at(_map(vocab), c)
    return framed(F.when(whole.isNotNull(), F.array(whole)).otherwise(ids), vocab, c)


#: Ids that a kernel gathers before it makes an Arrow array of them.
FLUSH = 1 << 20


def _ids_of(texts: pa.Array, one: Callable[[str], list[int] | None]) -> pa.Array:
    """``one`` of each text as a list column; the ids go into flat arrays, not into lists of numbers."""
    done: list[np.ndarray] = []
    flat: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts.to_pylist()):
        if text is not None:
            ids = one(text)
            lengths[k] = len(ids)
            flat += ids
            if len(flat) > FLUSH:
                done.append(np.array(flat, np.int64))
                flat = []
    done.append(np.array(flat, np.int64))
    offsets = np.zeros(len(texts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(done)), mask=texts.is_null() if texts.null_count else None)


def encode_kernel(c: Column, vocab: Vocab) -> Column:
    """Ids by the kernel; the model is built once in each worker process."""

    @F.arrow_udf("array<bigint>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared_model(vocab)
        for texts in batches:
            yield _ids_of(texts, model.encode)

    return encode(c)


def encode(c: Column, vocab: Vocab) -> Column:
    """Ids of whole texts.

    On sf0.1 with vocabularies of some dozen entries the expressions (:func:`encode_native`) took 1.2 to 2
    times as long as the kernel, so it is what serves all vocabularies.
    """
    return encode_kernel(c, vocab)


def count(c: Column, vocab: Vocab) -> Column:
    """Number of ids, without making them; the kernel sends back only the number."""

    @F.arrow_udf("bigint")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared_model(vocab)
        for texts in batches:
            yield pa.array([model.count(t) for t in texts.to_pylist()], pa.int64())

    return lengths(c)


def encode_pieces(pieces: Column, vocab: Vocab) -> Column:
    """For each text's pieces their ids: array<array<bigint>>."""

    @F.arrow_udf("array<array<bigint>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared_model(vocab)
        for column in batches:
            yield list_of(_ids_of(column.flatten(), model.piece), column)

    return encode(pieces)


def detokenize(ids: Column, vocab: Vocab) -> Column:
    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared_model(vocab)
        for some in batches:
            yield pa.array([None if x is None else model.detokenize(x) for x in some.to_pylist()], pa.string())

    return text(ids)


def unigram_score(c: Column, vocab: Vocab) -> Column:
    scores = F.create_map(*[F.lit(x) for t, s in zip(vocab.tokens, vocab.score_of(), strict=True) for x in (t, float(s))])
    lost = float(vocab.score_of()[vocab.unk]) if vocab.unk is not None else None
    each = F.transform(pieces(meta(c), vocab), lambda p: F.coalesce(F.try_element_at(scores, p), F.lit(lost).cast("double")))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)


def tokens(ids: Column, vocab: Vocab) -> Column:
    """Ids as strings; unknown ids are empty."""

    @F.arrow_udf("array<string>")
    def names(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = pa.array([*vocab.tokens, ""], pa.string())
        for column in batches:
            flat = np.asarray(column.flatten().fill_null(-1))
            known = np.where((flat >= 0) & (flat < len(vocab.tokens)), flat, len(vocab.tokens))
            yield list_of(table.take(pa.array(known)), column)

    return names(ids)


def lookup(tokens_frame: DataFrame, vocab_frame: DataFrame) -> DataFrame:
    """``token`` with its ``id`` (-1: not in the vocabulary): a join, so that neither side must be small."""
    last = vocab_frame.groupBy("token").agg(F.max("id").alias("id"))
    return tokens_frame.join(last, "token", "left").withColumn("id", F.coalesce("id", F.lit(-1)))


__all__ = ["Bpe", "Unigram", "count", "detokenize", "encode", "encode_kernel", "encode_native", "encode_pieces", "lookup", "meta", "pieces", "tokens", "unigram_score"]
