"""Text with the place of each of its characters in the original: normalisation that keeps offsets.

Every operation returns a new value.  ``spans[k]`` is the (start, end) in the original, in characters,
of the normalised text's character k; an inserted character has the empty span of where it stands.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = re.compile("[\t-\r \x85\xa0  -     　]")


@dataclass(frozen=True)
class Aligned:
    original: str
    text: str
    spans: tuple[tuple[int, int], ...]

    @staticmethod
    def of(text: str) -> Aligned:
        return Aligned(text, text, tuple((k, k + 1) for k in range(len(text))))

    # --- edits

    def transform(self, changes: Iterable[tuple[str, int]], skip: int = 0) -> Aligned:
        """New characters with what they do: 1 is inserted, 0 stands for one old character, -n for one and n more.

        ``skip`` old characters are dropped first.
        """
        at, out, spans = skip, [], []
        for char, change in changes:
            if change > 0:
                here = self.spans[at - 1][1] if at else 0
                spans.append(spans[-1] if spans else (here, here))
            else:
                if at - change >= len(self.spans) + (change < 0) and at >= len(self.spans):
                    raise ValueError("the changes go beyond the text")
                last = min(at - change, len(self.spans) - 1)
                spans.append((self.spans[at][0], self.spans[last][1]))
                at += 1 - change
            out.append(char)
        return Aligned(self.original, "".join(out), tuple(spans))

    def filter(self, keep: Callable[[str], bool]) -> Aligned:
        kept = [k for k, c in enumerate(self.text) if keep(c)]
        return Aligned(self.original, "".join(self.text[k] for k in kept), tuple(self.spans[k] for k in kept))

    def map(self, f: Callable[[str], str]) -> Aligned:
        """Each character by a string of any length, all of whose characters stand for it."""
        new = [f(c) for c in self.text]
        return Aligned(self.original, "".join(new), tuple(s for x, s in zip(new, self.spans, strict=True) for _ in x))

    def lowercase(self) -> Aligned:
        return self.map(lambda c: "i" if c == "İ" else c.lower())

    def uppercase(self) -> Aligned:
        return self.map(lambda c: u if len(u := c.upper()) == 1 else c)

    def remove_accents(self) -> Aligned:
        return self.filter(lambda c: unicodedata.category(c) != "Mn")

    def strip(self, left: bool = True, right: bool = True) -> Aligned:
        low, high = 0, len(self.text)
        while left and low < high and SPACE.match(self.text[low]):
            low += 1
        while right and high > low and SPACE.match(self.text[high - 1]):
            high -= 1
        return self.slice(low, high)

    def prepend(self, text: str) -> Aligned:
        at = self.spans[0][0] if self.spans else 0
        return Aligned(self.original, text + self.text, ((at, at),) * len(text) + self.spans) if self.text else self

    def append(self, text: str) -> Aligned:
        at = self.spans[-1][1] if self.spans else 0
        return Aligned(self.original, self.text + text, self.spans + ((at, at),) * len(text)) if self.text else self

    def replace(self, pattern: str | re.Pattern, by: str) -> Aligned:
        """Each match by a literal string, whose characters stand for the whole match."""
        found = re.compile(re.escape(pattern)) if isinstance(pattern, str) else pattern
        text, spans, at = [], [], 0
        for m in found.finditer(self.text):
            if m.start() == m.end():
                continue
            whole = (self.spans[m.start()][0], self.spans[m.end() - 1][1])
            text += [self.text[at : m.start()], by]
            spans += [*self.spans[at : m.start()], *([whole] * len(by))]
            at = m.end()
        return Aligned(self.original, "".join([*text, self.text[at:]]), tuple([*spans, *self.spans[at:]]))

    def normal_form(self, form: str) -> Aligned:
        """A Unicode form; each starter with the marks after it is normalised as a whole."""
        text, spans, at = [], [], 0
        while at < len(self.text):
            end = at + 1
            while end < len(self.text) and not unicodedata.is_normalized("NFC", self.text[at : end + 1]) | (unicodedata.combining(self.text[end]) == 0):
                end += 1
            while end < len(self.text) and unicodedata.combining(self.text[end]):
                end += 1
            new = unicodedata.normalize(form, self.text[at:end])
            text.append(new)
            if len(new) == end - at:
                spans += self.spans[at:end]
            else:
                spans += [(self.spans[at][0], self.spans[end - 1][1])] * len(new)
            at = end
        return Aligned(self.original, "".join(text), tuple(spans))

    # --- places

    def slice(self, start: int, end: int) -> Aligned:
        return Aligned(self.original, self.text[start:end], self.spans[start:end])

    def to_original(self, start: int, end: int) -> tuple[int, int]:
        """The original's range of a range of the normalised text."""
        if not 0 <= start <= end <= len(self.text):
            raise IndexError(f"{start}:{end} is outside a text of {len(self.text)} characters")
        if start == end:
            at = self.spans[start][0] if start < len(self.spans) else len(self.original) if not self.spans else self.spans[-1][1]
            return at, at
        return self.spans[start][0], self.spans[end - 1][1]

    def to_normalized(self, start: int, end: int) -> tuple[int, int] | None:
        """The normalised text's range of a range of the original; None if nothing of it is left."""
        inside = [k for k, (a, b) in enumerate(self.spans) if a < end and b > start]
        return (inside[0], inside[-1] + 1) if inside else None


def bytes_to_chars(text: str, start: int, end: int) -> tuple[int, int]:
    data = text.encode()
    return len(data[:start].decode("utf-8", "ignore")), len(data[:end].decode("utf-8", "ignore"))


def chars_to_bytes(text: str, start: int, end: int) -> tuple[int, int]:
    return len(text[:start].encode()), len(text[:end].encode())


def aligned(c: Column, steps: Callable[[Aligned], Aligned]) -> Column:
    """A column of struct (normalized, starts, ends); made only where offsets are asked for."""

    @F.pandas_udf("struct<normalized:string,starts:array<int>,ends:array<int>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        made = [None if t is None else steps(Aligned.of(t)) for t in texts]
        return pd.DataFrame(
            {
                "normalized": [m and m.text if m is not None else None for m in made],
                "starts": [None if m is None else [a for a, _ in m.spans] for m in made],
                "ends": [None if m is None else [b for _, b in m.spans] for m in made],
            }
        )

    return run(c)
