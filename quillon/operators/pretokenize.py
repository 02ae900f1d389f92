"""Pre-tokenizers as column expressions: a string column in, an array of pieces out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import models
from quillon.functions.arrow import strings_by_row, with_offsets
from quillon.functions.predicates import SCRIPTS
from quillon.functions.regex import BPE_MODES, BYTE_LEVEL, PUNCT, WORD, WS4, WS_RE2

__all__ = ["with_offsets"]  # from the Arrow functions, beside all that is defined here
PreTokenizer = Callable[[Column], Column]
BEHAVIORS = ("removed", "isolated", "merged_with_previous", "merged_with_next", "contiguous")
_CUT, _HIT, _GAP = "﷐", "﷑", "﷒"


def find_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def class_pattern(char_class: str, behavior: str) -> str:
    """Splitting at single characters of a class, as one expression."""
    d, rest = f"[{char_class}]", f"[^{char_class}]"
    return {
        "removed": f"{rest}+",
        "isolated": f"{d}|{rest}+",
        "merged_with_previous": f"{rest}*{d}|{rest}+",
        "merged_with_next": f"{d}?{rest}+|{d}",
        "contiguous": f"{d}+|{rest}+",
    }[behavior]


def split_class(char_class: str, behavior: str) -> PreTokenizer:
    return lambda c: find_all(c, class_pattern(char_class, behavior))


def matches(c: Column, pattern: str) -> Column:
    """Matches and gaps in order: array of (piece, hit); the noncharacters U+FDD0 to U+FDD2 may not occur in texts."""
    marked = F.regexp_replace(c, f"({pattern})", f"{_CUT}{_HIT}$1{_CUT}{_GAP}")
    parts = F.split(F.concat(F.lit(_GAP), marked), _CUT)
    both = F.transform(parts, lambda p: F.struct(F.substring(p, 2, 1 << 30).alias("piece"), (F.substring(p, 1, 1) == _HIT).alias("hit")))
    return F.filter(both, lambda p: p["piece"] != "")


def split(pattern: str, behavior: str = "removed", invert: bool = False) -> PreTokenizer:
    """Split at any expression; ``invert`` takes the gaps for delimiters."""
    if behavior not in BEHAVIORS:
        raise ValueError(f"behavior must be one of {BEHAVIORS}")

    def apply(c: Column) -> Column:
        parts = matches(c, pattern)
        hit = (lambda p: ~p["hit"]) if invert else (lambda p: p["hit"])
        if behavior == "removed":
            return F.transform(F.filter(parts, lambda p: ~hit(p)), lambda p: p["piece"])
        if behavior == "isolated":
            return F.transform(parts, lambda p: p["piece"])
        joins = {
            "merged_with_previous": lambda before, now: now and not before,
            "merged_with_next": lambda before, now: before and not now,
            "contiguous": lambda before, now: before == now,
        }[behavior]

        def merged(row: list[dict]) -> list[str]:
            out: list[list[str]] = []
            before = None
            for p in row:
                now = p["hit"] != invert
                if before is not None and joins(before, now):
                    out[-1].append(p["piece"])
                else:
                    out.append([p["piece"]])
                before = now
            return ["".join(x) for x in out]

        return strings_by_row(merged)(parts)

    return apply


def whitespace() -> PreTokenizer:
    """Runs of word characters and runs of marks."""
    return lambda c: find_all(c, f"[{WORD}]+|[^{WORD}{WS_RE2}]+")


def whitespace_split() -> PreTokenizer:
    return lambda c: find_all(c, f"[^{WS4}]+")


def delimiter(char: str) -> PreTokenizer:
    return lambda c: F.filter(F.split(c, rf"\x{{{ord(char):X}}}"), lambda p: p != "")


def punctuation(behavior: str = "isolated") -> PreTokenizer:
    return split_class(PUNCT, behavior)


def digits(individual: bool = False) -> PreTokenizer:
    return split_class(r"\p{N}", "isolated" if individual else "contiguous")


def bert() -> PreTokenizer:
    return lambda c: find_all(c, f"[{PUNCT}]|[^{PUNCT}{WS_RE2}]+")


SCHEMES = ("always", "first", "never")


def metaspace(mark: str = "▁", scheme: str = "always", first: bool = True) -> PreTokenizer:
    """Spaces as ``mark``, split before each; with one in front by ``scheme``.

    ``first``: whether what is split begins its text; only then the scheme ``first`` puts a mark before it.
    :func:`sequence` says so to its steps.
    """
    if scheme not in SCHEMES:
        raise ValueError(f"scheme must be one of {SCHEMES}")

    def apply(c: Column, first: bool | Column = first) -> Column:
        marked = F.regexp_replace(c, f"[{WS_RE2}]", mark)
        if scheme == "first":
            begins = F.lit(first) if isinstance(first, bool) else first
            marked = F.when(~begins | marked.startswith(mark) | (marked == ""), marked).otherwise(F.concat(F.lit(mark), marked))
        elif scheme != "never":
            marked = F.when(marked.startswith(mark) | (marked == ""), marked).otherwise(F.concat(F.lit(mark), marked))
        return find_all(marked, f"{mark}?[^{mark}]+|{mark}")

    apply.by_place = scheme == "first"
    return apply


def byte_alphabet() -> list[str]:
    """The character of each byte: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    kept = set(plain)
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


def byte_level_split(c: Column) -> Column:
    """Words with the space before them; white space that belongs to no word is a piece of its own."""
    return find_all(c, BYTE_LEVEL + rf"|[{WS_RE2}]+?(?= ?[^{WS_RE2}]|\z)")


def to_bytes(piece: Column) -> Column:
    """A piece with each of its UTF-8 bytes written as that byte's character."""
    table = F.array(*[F.lit(x) for x in byte_alphabet()])
    pairs = F.regexp_extract_all(F.hex(F.encode(piece, "UTF-8")), F.lit(".."), F.lit(0))
    return F.array_join(F.transform(pairs, lambda h: F.element_at(table, F.conv(h, 16, 10).cast("int") + 1)), "")


def byte_level(prefix_space: bool = False) -> PreTokenizer:
    def apply(c: Column) -> Column:
        text = F.when((c == "") | c.startswith(" "), c).otherwise(F.concat(F.lit(" "), c)) if prefix_space else c
        return F.transform(byte_level_split(text), to_bytes)

    return apply


def unicode_script() -> PreTokenizer:
    """Splits where the script changes; kana count as Han, a space belongs to any script, leading spaces are dropped."""
    kana = ("Hiragana", "Katakana", "Han")
    classes = [r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{30FC}", *(rf"\p{{Is{x}}}&&[^\x{{30FC}} ]" for x in SCRIPTS if x not in kana)]
    known = "".join(rf"\p{{Is{x}}}" for x in SCRIPTS)
    runs = "|".join(rf"[[{c}] ]+" for c in (*classes, f"^{known} "))
    return lambda c: find_all(F.regexp_replace(c, r"\A +", ""), runs)


def _by_place(step: Callable[..., Column]) -> Callable[[Column, Column], Column]:
    return lambda p, i: step(p, i == 0)


def sequence(*steps: PreTokenizer) -> PreTokenizer:
    def apply(c: Column) -> Column:
        pieces = steps[0](c)
        for step in steps[1:]:
            pieces = F.flatten(F.transform(pieces, _by_place(step) if getattr(step, "by_place", False) else step))
        return pieces

    return apply


# --- pre-tokenization of the byte-pair model


def bpe_raw(c: Column, mode: str) -> Column:
    """Fragments of a mode before spaces are treated; the modes that split inside characters do so by characters."""
    if mode == "gemma4":
        return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))
    if mode == "deepseek":
        kept = find_all(c, r"[\r\n]+")
        words = find_all(c, r" ?[A-Za-z\x{00C0}-\x{024F}]+")
        parts = F.when(F.size(kept) > 0, kept).when(F.size(words) > 0, words).otherwise(F.filter(F.array(c), lambda p: p != ""))
        return F.flatten(F.transform(parts, lambda p: find_all(p, "[0-9]|[^0-9]+")))
    if mode == "starcoder":
        lead = F.regexp_extract(c, "^[0-9]+", 0)
        rest = find_all(F.substring(c, F.length(lead) + 1, F.length(c)), BPE_MODES["gpt2"])
        rest = F.filter(rest, lambda p: ~p.rlike(r"^[\x00-\x08\x0B\x0C\x0E-\x1F!-&(-/:-@\[-`{-\x7F]"))
        return F.concat(F.filter(F.array(lead), lambda p: p != ""), rest)
    parts = find_all(c, BPE_MODES[mode])
    return F.filter(parts, lambda p: ~p.rlike(r"\A[ \t]+\z")) if mode in ("llama3", "gpt4o", "qwen35") else parts


def with_spaces(fragments: Column, mark: str = "") -> Column:
    """Drops blank fragments; with a mark, k blanks before content give k - 1 marks and a mark on the content."""
    blank = lambda p: p.rlike(r"\A[ \t\n\x0B\f\r]*\z")
    if not mark:
        return F.filter(fragments, lambda p: ~blank(p))
    return strings_by_row(lambda row: models.with_spaces(row, mark))(fragments)


def bpe(mode: str = "default", mark: str = "") -> PreTokenizer:
    return lambda c: F.array(c) if mode == "gemma4" else with_spaces(bpe_raw(c, mode), mark)
