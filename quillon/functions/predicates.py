"""Predicates of single characters and fragments, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.regex import CJK, CONTROL, PUNCT, WS_UNICODE


def _one(char_class: str):
    return lambda c: c.rlike(rf"\A[{char_class}]\z")


is_bert_punctuation = _one(PUNCT)
is_punctuation = _one(r"\p{P}")
is_bert_whitespace = _one(r" \t\n\r")
is_whitespace = _one(WS_UNICODE)
is_control = _one(CONTROL)
is_chinese = _one(CJK)


def has_space(fragment: Column) -> Column:
    """Whether a fragment begins with a space, tab or line break."""
    return fragment.rlike(r"\A[ \t\n\r]")


def trim_space(fragment: Column) -> Column:
    """A fragment without white space at its ends."""
    return F.regexp_replace(fragment, rf"\A[{WS_UNICODE}]+|[{WS_UNICODE}]+\z", "")


#: The classes of characters in fragments of the byte-pair model, in the order in which they are tried.
KINDS = (
    ("space", r" \t"),
    ("newline", r"\r\n"),
    ("letter", r"A-Za-z\x{00C0}-\x{024F}"),
    ("digit", "0-9"),
    ("cjk", r"\x{4E00}-\x{9FA5}\x{3040}-\x{309F}\x{30A0}-\x{30FF}"),
    ("mark", r"\p{M}"),
    ("ascii", r"\x{0000}-\x{007F}"),
)


def kind_of(char: Column) -> Column:
    """The class of a character; "other" if it has none."""
    out = F.lit("other")
    for name, char_class in reversed(KINDS):
        out = F.when(char.rlike(rf"\A[{char_class}]\z"), name).otherwise(out)
    return out


#: Scripts by the names that expressions know them by.
SCRIPTS = (
    "Latin Greek Cyrillic Armenian Hebrew Arabic Syriac Thaana Nko Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala "
    "Thai Lao Tibetan Myanmar Georgian Hangul Ethiopic Cherokee Canadian_Aboriginal Ogham Runic Khmer Mongolian Hiragana Katakana Bopomofo Han Yi "
    "Gothic Deseret Tagalog Hanunoo Buhid Tagbanwa Limbu Tai_Le Linear_B Ugaritic Shavian Osmanya Cypriot Braille Buginese Coptic New_Tai_Lue Glagolitic "
    "Tifinagh Syloti_Nagri Old_Persian Kharoshthi Balinese Cuneiform Phoenician Phags_Pa Sundanese Lepcha Ol_Chiki Vai Saurashtra Kayah_Li Rejang Lycian "
    "Carian Lydian Cham Tai_Tham Javanese Meetei_Mayek Inherited Common"
).split()


def script_of(char: Column) -> Column:
    """The script of a character; empty if it is none of SCRIPTS."""
    return F.coalesce(*[F.when(char.rlike(rf"\A\p{{Is{s}}}\z"), s) for s in SCRIPTS], F.lit(""))


def fixed_script_of(char: Column) -> Column:
    """Like :func:`script_of`, but kana and their long mark are Han, and the space is Any."""
    script = script_of(char)
    return F.when(char == "\u30fc", "Han").when(char == " ", "Any").when(script.isin("Hiragana", "Katakana"), "Han").otherwise(script)
