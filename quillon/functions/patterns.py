"""Patterns: where they match, with the gaps between, so that the matches cover the text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.regex import quote
from quillon.operators.pretokenize import matches


@dataclass(frozen=True)
class Pattern:
    """An expression; ``inverted`` takes its gaps for matches."""

    expression: str
    inverted: bool = False

    def invert(self) -> Pattern:
        return Pattern(self.expression, not self.inverted)

    def find(self, c: Column, unit: str = "byte") -> Column:
        """Array of (start, end, match) over the whole text."""
        size = F.octet_length if unit == "byte" else F.length
        start = F.struct(F.array().cast("array<struct<start:int,end:int,match:boolean>>").alias("out"), F.lit(0).alias("at"))

        def step(a: Column, p: Column) -> Column:
            end = a["at"] + size(p["piece"])
            hit = ~p["hit"] if self.inverted else p["hit"]
            return F.struct(F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), end.alias("end"), hit.alias("match")))).alias("out"), end.alias("at"))

        found = matches(c, self.expression) if self.expression else F.filter(F.array(F.struct(c.alias("piece"), F.lit(False).alias("hit"))), lambda p: p["piece"] != "")
        return F.aggregate(found, start, step, lambda a: a["out"])


def char(c: str) -> Pattern:
    return Pattern(quote(c))


def string(text: str) -> Pattern:
    """The empty string matches nothing."""
    return Pattern(quote(text))


def regexp(expression: str) -> Pattern:
    return Pattern(expression)


def char_class(members: str) -> Pattern:
    """Each character of a class is a match of its own."""
    return Pattern(f"[{members}]")
