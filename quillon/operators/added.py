"""Added tokens: found before anything else splits the text, leftmost and longest first."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillon.functions.regex import WS_UNICODE, quote
from quillon.operators.pretokenize import matches
from quillon.schema import Vocab


@dataclass(frozen=True)
class AddedToken:
    content: str
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False
    normalized: bool = True
    special: bool = False

    def pattern(self) -> str:
        body = quote(self.content)
        if self.single_word:
            body = rf"(?<![\p{{L}}\p{{N}}]){body}(?![\p{{L}}\p{{N}}])"
        return (f"[{WS_UNICODE}]*" if self.lstrip else "") + body + (f"[{WS_UNICODE}]*" if self.rstrip else "")


def add(tokens: list[AddedToken], have: dict[str, int], size: int) -> tuple[dict[str, int], int]:
    """Ids of the added tokens, counted on from the model's size; empty and repeated ones add nothing."""
    out, n = dict(have), 0
    for t in tokens:
        if t.content and t.content not in out:
            out[t.content] = size + n
            n += 1
    return out, n


def _pattern(tokens: list[AddedToken]) -> str:
    return "|".join(t.pattern() for t in sorted((t for t in tokens if t.content), key=lambda t: (-len(t.content), t.content)))


def _whole(c: Column) -> Column:
    return F.filter(F.array(F.struct(c.alias("piece"), F.lit(False).alias("hit"))), lambda p: p["piece"] != "")


def _normalized(tokens: list[AddedToken], normalizer: Callable[[Column], Column]) -> list[AddedToken]:
    row = SparkSession.active().range(1).select(*[normalizer(F.lit(t.content)) for t in tokens]).head() if tokens else ()
    return [replace(t, content=text or "") for t, text in zip(tokens, row, strict=True)]


def extract(c: Column, tokens: list[AddedToken], normalizer: Callable[[Column], Column] | None = None) -> Column:
    """Array of (piece, hit): added tokens with what they take of the space around them, and the text between.

    Tokens with ``normalized`` unset are found in the text as it is; then the text between is
    normalised, and the other tokens, normalised too, are found in it.
    """
    second = [t for t in tokens if t.normalized]
    raw, normal = _pattern([t for t in tokens if not t.normalized]), _pattern(_normalized(second, normalizer) if normalizer else second)
    change = normalizer or (lambda x: x)
    again = lambda x: matches(change(x), normal) if normal else _whole(change(x))
    if not raw:
        return again(c)
    return F.flatten(F.transform(matches(c, raw), lambda p: F.when(p["hit"], F.array(p)).otherwise(again(p["piece"]))))


@dataclass(frozen=True)
class AddedVocabulary:
    """Added tokens beside a model's vocabulary; their ids go on from the model's size unless the model has them."""

    model: Vocab
    tokens: tuple[AddedToken, ...] = ()
    normalizer: Callable[[Column], Column] | None = None

    def add(self, *tokens: AddedToken) -> AddedVocabulary:
        """With more tokens; empty ones and those that are there already are left out."""
        have = {t.content for t in self.tokens}
        new = [t for t in {t.content: t for t in reversed(tokens)}.values() if t.content and t.content not in have]
        return replace(self, tokens=(*self.tokens, *reversed(new)))

    def add_special(self, *tokens: str) -> AddedVocabulary:
        return self.add(*[AddedToken(t, normalized=False, special=True) for t in tokens])

    def vocab(self) -> Vocab:
        """The model's vocabulary with the added tokens at its end."""
        have = set(self.model.tokens)
        return replace(self.model, tokens=(*self.model.tokens, *[t.content for t in self.tokens if t.content not in have]))

    def ids(self) -> dict[str, int]:
        every = self.vocab().ids()
        return {t.content: every[t.content] for t in self.tokens}

    def token_to_id(self, token: Column) -> Column:
        """The added token's id, or else the model's; null if neither knows it."""
        return F.try_element_at(F.create_map(*[F.lit(x) for t, k in (self.vocab().ids()).items() for x in (t, k)]).cast("map<string,bigint>"), token)

    def id_to_token(self, i: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for k, t in enumerate(self.vocab().tokens) for x in (k, t)]).cast("map<bigint,string>"), i.cast("bigint"))

    def is_special(self, token: Column) -> Column:
        special = [t.content for t in self.tokens if t.special]
        return token.isin(*special) if special else F.lit(False)

    def extract(self, text: Column) -> Column:
        return extract(text, list(self.tokens), self.normalizer)

    def __len__(self) -> int:
        return len(self.tokens)
