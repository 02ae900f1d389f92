"""Post-processors: special tokens around one sequence or a pair, by expressions over array columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Piece:
    """A place in a template: a sequence ("A" or "B") or a special token, with its type id."""

    name: str
    special: bool
    type_id: int = 0


def parse_template(text: str | list[str]) -> list[Piece]:
    """Pieces of ``[CLS] $A:0 [SEP] $B:1``; ``$`` alone is A, ``$n`` is A with type n."""
    out = []
    for word in text.split() if isinstance(text, str) else text:
        name, _, kind = word.rpartition(":") if re.search(r":\d+$", word) else (word, "", "")
        number = int(kind) if kind else 0
        if not name.startswith("$"):
            out.append(Piece(name, True, number))
        elif (rest := name[1:]).upper() in ("", "A", "B"):
            out.append(Piece(rest.upper() or "A", False, number))
        elif rest.isdigit():
            out.append(Piece("A", False, int(rest)))
        else:
            raise ValueError(f"not a template piece: {word!r}")
    return out


def added(pieces: list[Piece], specials: dict[str, list[int]]) -> int:
    return sum(len(specials[p.name]) for p in pieces if p.special)


def _join(pieces: list[Piece], sequence, special) -> Column:
    return F.concat(*[special(p) if p.special else sequence(p) for p in pieces])


def apply_template(pieces: list[Piece], specials: dict[str, list[int]], sequences: dict[str, Column]) -> dict[str, Column]:
    """ids, type_ids and special_tokens_mask by a template; ``sequences`` are the id arrays of A and B."""
    if missing := [p.name for p in pieces if (p.special and p.name not in specials) or (not p.special and p.name not in sequences)]:
        raise ValueError(f"the template names what is not given: {missing}")
    fixed = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    return {
        "ids": _join(pieces, lambda p: sequences[p.name].cast("array<bigint>"), lambda p: fixed(specials[p.name], "bigint")),
        "type_ids": _join(pieces, lambda p: F.transform(sequences[p.name], lambda x: F.lit(p.type_id)), lambda p: fixed([p.type_id] * len(specials[p.name]), "int")),
        "special_tokens_mask": _join(pieces, lambda p: F.transform(sequences[p.name], lambda x: F.lit(0)), lambda p: fixed([1] * len(specials[p.name]), "int")),
    }


def apply_to_encodings(pieces: list[Piece], specials: dict[str, list[int]], sequences: dict[str, Column]) -> dict[str, Column]:
    """All fields of an encoding by a template; ``sequences`` are structs of ids, tokens, words and offsets.

    Special tokens are named as in the template, have no word (-1) and an empty span.
    """
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))

    def fixed(piece: Piece, value: Column, kind: str) -> Column:
        return F.array_repeat(value, len(specials[piece.name])).cast(f"array<{kind}>")

    ids = {name: s["ids"] for name, s in sequences.items()}
    made = apply_template(pieces, specials, ids)
    made["tokens"] = _join(pieces, lambda p: sequences[p.name]["tokens"], lambda p: fixed(p, F.lit(p.name), "string"))
    made["words"] = _join(pieces, lambda p: sequences[p.name]["words"], lambda p: fixed(p, F.lit(-1), "int"))
    made["offsets"] = _join(pieces, lambda p: sequences[p.name]["offsets"], lambda p: fixed(p, zero, "struct<start:int,end:int>"))
    made["attention_mask"] = F.transform(made["ids"], lambda x: F.lit(1))
    at, entries = F.lit(0), []
    for p in pieces:
        n = F.lit(len(specials[p.name])) if p.special else F.size(ids[p.name])
        if not p.special:
            span = F.struct(at.cast("int").alias("start"), (at + n).cast("int").alias("end"))
            entries.append(F.when(n > 0, F.struct(F.lit("AB".index(p.name)).alias("key"), span.alias("value"))))
        at = at + n
    made["sequence_ranges"] = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
    return made


class Processor:
    """What is done to one encoded sequence or a pair; ``added`` is how many tokens that adds."""

    def added(self, pair: bool) -> int:
        return 0

    def apply(self, df: DataFrame, first: str, second: str | None = None) -> DataFrame:
        """``df`` with the fields of an encoding of the structs ``first`` and ``second``."""
        raise NotImplementedError


@dataclass(frozen=True)
class Default(Processor):
    """One sequence as it is; two one after the other, the second with type 1."""

    def apply(self, df: DataFrame, first: str, second: str | None = None) -> DataFrame:
        return Template("$A", "$A $B:1", {}).apply(df, first, second)


@dataclass(frozen=True)
class Template(Processor):
    single: str
    pair: str
    specials: dict[str, list[int]]

    def added(self, pair: bool) -> int:
        return added(parse_template(self.pair if pair else self.single), self.specials)

    def apply(self, df: DataFrame, first: str, second: str | None = None) -> DataFrame:
        pieces = parse_template(self.single if second is None else self.pair)
        sides = {"A": F.col(first)} | ({"B": F.col(second)} if second else {})
        return df.withColumns(apply_to_encodings(pieces, self.specials, sides))


def bert_processor(cls: int, sep: int) -> Template:
    return Template("[CLS] $A [SEP]", "[CLS] $A [SEP] $B:1 [SEP]:1", {"[CLS]": [cls], "[SEP]": [sep]})


@dataclass(frozen=True)
class ByteLevel(Processor):
    """Takes the spaces out of the offsets; changes the structs in place and adds no token."""

    prefix_space: bool = True
    trim: bool = True

    def apply(self, df: DataFrame, first: str, second: str | None = None) -> DataFrame:
        for c in filter(None, (first, second)) if self.trim else ():
            offsets = byte_level_offsets(F.col(c)["tokens"], F.col(c)["offsets"], self.prefix_space)
            df = df.withColumn(c, F.col(c).withField("offsets", offsets))
        return df


@dataclass(frozen=True)
class Roberta(Processor):
    """Byte-level offsets first, if ``trim``; then the frame."""

    cls: int
    sep: int
    prefix_space: bool = True
    trim: bool = True

    def _frame(self) -> Template:
        return Template("<s> $A </s>", "<s> $A </s> </s>:1 $B:1 </s>:1", {"<s>": [self.cls], "</s>": [self.sep]})

    def added(self, pair: bool) -> int:
        return self._frame().added(pair)

    def apply(self, df: DataFrame, first: str, second: str | None = None) -> DataFrame:
        return self._frame().apply(ByteLevel(self.prefix_space, self.trim).apply(df, first, second), first, second)


@dataclass(frozen=True)
class Sequence(Processor):
    """Processors one after the other; one that makes fields hands them on as the next one's first sequence."""

    steps: tuple[Processor, ...]

    def added(self, pair: bool) -> int:
        return sum(s.added(pair) for s in self.steps)

    def apply(self, df: DataFrame, first: str, second: str | None = None) -> DataFrame:
        made = False
        for step in self.steps:
            out = step.apply(df, first, None if made else second)
            if isinstance(step, ByteLevel):
                df = out
                continue
            inner = F.struct(*[F.col(c) for c in ("ids", "tokens", "words", "offsets")])
            df, made = out.withColumn(first, inner), True
        return df if made else Default().apply(df, first, second)


def template(df: DataFrame, single: str, specials: dict[str, list[int]], first: str, pair: str | None = None, second: str | None = None) -> DataFrame:
    """``df`` with ids, type_ids and special_tokens_mask."""
    chosen, sequences = (single, {"A": F.col(first)}) if second is None else (pair, {"A": F.col(first), "B": F.col(second)})
    return df.withColumns(apply_template(parse_template(chosen), specials, sequences))


def bert(df: DataFrame, cls: int, sep: int, first: str, second: str | None = None) -> DataFrame:
    return template(df, "[CLS] $A [SEP]", {"[CLS]": [cls], "[SEP]": [sep]}, first, "[CLS] $A [SEP] $B:1 [SEP]:1", second)


def roberta(df: DataFrame, cls: int, sep: int, first: str, second: str | None = None) -> DataFrame:
    return template(df, "<s> $A </s>", {"<s>": [cls], "</s>": [sep]}, first, "<s> $A </s> </s>:1 $B:1 </s>:1", second)


def byte_level_offsets(tokens: Column, offsets: Column, prefix_space: bool = True) -> Column:
    """Offsets without the spaces (Ġ) around tokens; the first token's single added space is not in the text."""

    def one(t: Column, o: Column) -> Column:
        lead = F.length(F.regexp_extract(t, "^Ġ*", 0))
        tail = F.length(F.regexp_extract(t, "Ġ*$", 0))
        if prefix_space:
            lead = F.when((o["start"] == 0) & (lead == 1), 0).otherwise(lead)
        start = F.least(o["start"] + lead, o["end"])
        return F.struct(start.alias("start"), F.greatest(o["end"] - F.when(start == o["end"], 0).otherwise(tail), start).alias("end"))

    return F.zip_with(tokens, offsets, one)


def overflow_pairs(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Every part of A with every part of B of the same document: (key, part_a, part_b, ids_a, ids_b)."""
    a = first.select(key, F.col("part").alias("part_a"), F.col("ids").alias("ids_a"))
    b = second.select(key, F.col("part").alias("part_b"), F.col("ids").alias("ids_b"))
    return a.join(b, key)
