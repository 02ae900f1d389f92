"""Decoders: an array of tokens in, an array of strings out; joined they are the text."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.pretokenize import byte_alphabet

Decoder = Callable[[Column], Column]
#: English clean-up, in order.
CLEANUP = ((" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"), (" n't", "n't"), (" 'm", "'m"), (" do not", " don't"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"))


def cleaned(c: Column) -> Column:
    for find, by in CLEANUP:
        c = F.replace(c, F.lit(find), F.lit(by))
    return c


def bpe(suffix: str = "</w>") -> Decoder:
    return lambda t: F.transform(t, lambda x, i: F.replace(x, F.lit(suffix), F.when(i == F.size(t) - 1, "").otherwise(" ")))


def wordpiece(prefix: str = "##", cleanup: bool = True) -> Decoder:
    def one(x: Column, i: Column) -> Column:
        part = F.when(i == 0, x).when(x.startswith(prefix), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(F.concat(F.lit(" "), x))
        return cleaned(part) if cleanup else part

    return lambda t: F.transform(t, one)


def ctc(pad: str = "<pad>", delimiter: str = "|", cleanup: bool = True) -> Decoder:
    """Repeats once, no padding; with clean-up the delimiter is a space."""

    def apply(t: Column) -> Column:
        kept = F.filter(t, lambda x, i: (i == 0) | (x != F.get(t, i - 1)))
        parts = F.transform(kept, lambda x: F.replace(x, F.lit(pad), F.lit("")))
        if cleanup:
            parts = F.transform(parts, lambda x: F.replace(cleaned(x), F.lit(delimiter), F.lit(" ")))
        return F.filter(parts, lambda x: x != "")

    return apply


def fuse() -> Decoder:
    return lambda t: F.array(F.array_join(t, ""))


def strip(content: str, start: int = 0, stop: int = 0) -> Decoder:
    """Takes at most ``start`` and ``stop`` of a character off the ends of each token."""
    c = rf"\x{{{ord(content):X}}}"
    return lambda t: F.transform(t, lambda x: F.regexp_replace(F.regexp_replace(x, rf"\A{c}{{0,{start}}}", ""), rf"{c}{{0,{stop}}}\z" if stop else r"\z", ""))


def replace(find: str, by: str) -> Decoder:
    return lambda t: F.transform(t, lambda x: F.replace(x, F.lit(find), F.lit(by)))


def metaspace(mark: str = "▁", prefix_space: bool = True) -> Decoder:
    spaced = lambda x: F.replace(x, F.lit(mark), F.lit(" "))
    if not prefix_space:
        return lambda t: F.transform(t, spaced)
    return lambda t: F.transform(t, lambda x, i: F.when(i == 0, F.replace(x, F.lit(mark), F.lit(""))).otherwise(spaced(x)))


def byte_fallback() -> Decoder:
    """Runs of <0xHH> as UTF-8; a run that is not valid gives one U+FFFD for each byte."""
    code = re.compile(r"<0x([0-9A-Fa-f]{2})>")

    def one(tokens) -> list[str] | None:
        if tokens is None:
            return None
        out, run = [], bytearray()
        for t in [*tokens, None]:
            m = code.fullmatch(t) if t is not None else None
            if m:
                run.append(int(m[1], 16))
                continue
            if run:
                try:
                    out.append(run.decode())
                except UnicodeDecodeError:
                    out += ["�"] * len(run)
                run = bytearray()
            if t is not None:
                out.append(t)
        return out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def apply(tokens: pd.Series) -> pd.Series:
        return tokens.map(one)

    return apply


def byte_level() -> Decoder:
    """Byte characters as bytes, joined and read as UTF-8; a character that stands for no byte is byte 0."""
    value = {c: b for b, c in enumerate(byte_alphabet())}

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def apply(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: None if t is None else [bytes(value.get(c, 0) for x in t for c in x).decode("utf-8", "replace")])

    return apply


def sequence(*steps: Decoder) -> Decoder:
    def apply(t: Column) -> Column:
        for step in steps:
            t = step(t)
        return t

    return apply
