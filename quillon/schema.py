"""Vocabularies, their configuration, and the Spark types of tokens and encodings."""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass, field, fields, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TOKEN = T.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("id", "long"), ("value", "string"), ("start", "integer"), ("end", "integer"))]})
OFFSET = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
ENCODING = T.StructType(
    [
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("type_ids", T.ArrayType(T.IntegerType())),
        T.StructField("tokens", T.ArrayType(T.StringType())),
        T.StructField("offsets", T.ArrayType(OFFSET)),
        T.StructField("special_tokens_mask", T.ArrayType(T.IntegerType())),
        T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
        T.StructField("words", T.ArrayType(T.IntegerType())),
        T.StructField("sequence_ranges", T.MapType(T.IntegerType(), OFFSET)),
    ]
)


@dataclass(frozen=True)
class Vocab:
    """A vocabulary and its configuration; a token's id is its position, and of equal tokens the last one counts.

    Special ids are None where they are not set; ``unk = -1`` says that unknown text is not encoded.
    """

    model: str = "bpe"
    tokens: tuple[str, ...] = ()
    merges: tuple[tuple[str, str], ...] = ()
    scores: tuple[float, ...] = ()
    token_type: tuple[int, ...] = ()
    bos: int | None = None
    eos: int | None = None
    eot: int | None = None
    eom: int | None = None
    unk: int | None = None
    pad: int | None = None
    add_bos: bool = False
    add_eos: bool = False
    pre_type: str = "default"
    space: str = ""
    config: dict[str, str] = field(default_factory=dict)

    @cached_property
    def _digest(self) -> str:
        return hashlib.md5(pickle.dumps([getattr(self, f.name) for f in fields(self)])).hexdigest()

    def key(self) -> str:
        """A name for this vocabulary and configuration."""
        return self._digest

    def ids(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(self.tokens)}

    def score_of(self) -> list[float]:
        """Scores by id; they may come interleaved with the ids."""
        if len(self.scores) == 2 * len(self.tokens):
            return list(self.scores[1::2])
        return [*self.scores, *([0.0] * (len(self.tokens) - len(self.scores)))][: len(self.tokens)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(id, token, score, token_type)."""
        scores, kinds = self.score_of(), [*self.token_type, *([0] * len(self.tokens))]
        rows = [(k, t, float(scores[k]), int(kinds[k])) for k, t in enumerate(self.tokens)]
        return spark.createDataFrame(rows, "id bigint, token string, score double, token_type int")

    # --- set operations; ids are positions, so what is left is numbered anew

    def append(self, *tokens: str) -> Vocab:
        if taken := sorted({t for t in tokens if t in set(self.tokens)} | {t for t in tokens if tokens.count(t) > 1}):
            raise ValueError(f"tokens that are there already: {taken}")
        return replace(self, tokens=(*self.tokens, *tokens))

    def union(self, other: Vocab) -> Vocab:
        have = set(self.tokens)
        return replace(self, tokens=(*self.tokens, *dict.fromkeys(t for t in other.tokens if t not in have)))

    def intersect(self, other: Vocab) -> Vocab:
        keep = set(other.tokens)
        return replace(self, tokens=tuple(t for t in self.tokens if t in keep))

    def trim(self, other: Vocab) -> Vocab:
        drop = set(other.tokens)
        return replace(self, tokens=tuple(t for t in self.tokens if t not in drop))
