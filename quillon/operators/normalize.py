"""Normalizers as column expressions: what goes in and comes out is a string column."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.regex import CJK, CONTROL, WS_UNICODE

Normalizer = Callable[[Column], Column]


def lowercase() -> Normalizer:
    """Lower-cases each code point by itself (no final sigma, no dotted i)."""
    return lambda c: F.lower(F.translate(c, "İΣ", "iσ"))


def uppercase() -> Normalizer:
    """Upper-cases each code point by itself: a code point whose upper case is longer, like ß, stays."""
    held = "﷐"
    return lambda c: F.translate(F.upper(F.translate(c, "ß", held)), held, "ß")


def strip(left: bool = True, right: bool = True) -> Normalizer:
    ends = [rf"\A[{WS_UNICODE}]+"] * left + [rf"[{WS_UNICODE}]+\z"] * right
    return lambda c: F.regexp_replace(c, "|".join(ends), "") if ends else c


def strip_accents() -> Normalizer:
    """Drops non-spacing marks; composed letters stay."""
    return lambda c: F.regexp_replace(c, r"\p{Mn}+", "")


def unicode_form(form: str) -> Normalizer:
    @F.pandas_udf(T.StringType())
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    return normal


def replace(find: str, by: str) -> Normalizer:
    return lambda c: F.replace(c, F.lit(find), F.lit(by)) if find else c


def replace_pattern(pattern: str, by: str) -> Normalizer:
    literal = by.replace("\\", "\\\\").replace("$", "\\$")
    return lambda c: F.regexp_replace(c, pattern, literal)


def prepend(text: str) -> Normalizer:
    return lambda c: F.when(c == "", c).otherwise(F.concat(F.lit(text), c))


def append(text: str) -> Normalizer:
    return lambda c: F.when(c == "", c).otherwise(F.concat(c, F.lit(text)))


def clear() -> Normalizer:
    return lambda c: F.when(c.isNotNull(), F.lit(""))


def keep(char_class: str) -> Normalizer:
    """Keeps the characters of a regular-expression class."""
    return lambda c: F.regexp_replace(c, f"[^{char_class}]+", "")


def map_chars(source: str, target: str) -> Normalizer:
    return lambda c: F.translate(c, source, target)


def bert_clean() -> Normalizer:
    """Drops control characters; a blank before dropped ones becomes a space."""
    return lambda c: F.regexp_replace(F.regexp_replace(c, rf"[ \t\n\r][{CONTROL}]+", " "), rf"[{CONTROL}]+", "")


def pad_ideographs() -> Normalizer:
    return lambda c: F.regexp_replace(c, f"([{CJK}])", " $1 ")


def sequence(*steps: Normalizer) -> Normalizer:
    return lambda c: reduce(lambda x, f: f(x), steps, c)


def bert(clean: bool = True, ideographs: bool = True, lower: bool = True, accents: bool = True) -> Normalizer:
    return sequence(*[f for f, on in ((bert_clean(), clean), (pad_ideographs(), ideographs), (lowercase(), lower), (strip_accents(), accents)) if on])


def default(lower: bool = True, stripped: bool = True) -> Normalizer:
    return sequence(*[f for f, on in ((lowercase(), lower), (strip(), stripped)) if on])


def new(lower: bool = False, strip_ends: bool = False, accents: bool = False, form: str | None = None, also: tuple[Normalizer, ...] = ()) -> Normalizer:
    """A normalizer from options: form, then accents, case, ends, and whatever else."""
    chosen = ((unicode_form(form) if form else None, form), (strip_accents(), accents), (lowercase(), lower), (strip(), strip_ends))
    return sequence(*[f for f, on in chosen if on], *also)
