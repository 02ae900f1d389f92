"""tokenizer.json as a :class:`quillon.pipeline.Pipeline`."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column

from quillon.functions.regex import quote
from quillon.operators import decode, normalize, pretokenize
from quillon.operators.added import AddedToken, AddedVocabulary
from quillon.pipeline import Pipeline
from quillon.schema import Vocab

Stage = Callable[[Column], Column]


def _pattern(given: dict | str) -> str:
    if isinstance(given, str):
        return quote(given)
    return given["Regex"] if "Regex" in given else quote(given["String"])


def normalizer_of(c: dict | None) -> Stage | None:
    if not c:
        return None
    kind = c["type"]
    if kind == "Sequence":
        return normalize.sequence(*filter(None, map(normalizer_of, c["normalizers"])))
    if kind == "Replace":
        by = c.get("content", "")
        return normalize.replace(c["pattern"]["String"], by) if "String" in c["pattern"] else normalize.replace_pattern(c["pattern"]["Regex"], by)
    made: dict[str, Callable[[], Stage]] = {
        "BertNormalizer": lambda: normalize.bert(c.get("clean_text", True), c.get("handle_chinese_chars", True), c.get("lowercase", True), c["strip_accents"] if c.get("strip_accents") is not None else c.get("lowercase", True)),
        "Lowercase": normalize.lowercase,
        "Strip": lambda: normalize.strip(c.get("strip_left", True), c.get("strip_right", True)),
        "StripAccents": normalize.strip_accents,
        "Prepend": lambda: normalize.prepend(c["prepend"]),
    }
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return normalize.unicode_form(kind)
    if kind not in made:
        raise ValueError(f"no normalizer is called {kind!r}")
    return made[kind]()


#: The names of delimiter behaviours in files.
BEHAVIORS = {"Removed": "removed", "Isolated": "isolated", "MergedWithPrevious": "merged_with_previous", "MergedWithNext": "merged_with_next", "Contiguous": "contiguous"}


def pretokenizer_of(c: dict | None) -> Stage | None:
    if not c:
        return None
    kind = c["type"]
    scheme = c.get("prepend_scheme", "always" if c.get("add_prefix_space", True) else "never")
    made: dict[str, Callable[[], Stage]] = {
        "Sequence": lambda: pretokenize.sequence(*filter(None, map(pretokenizer_of, c["pretokenizers"]))),
        "BertPreTokenizer": pretokenize.bert,
        "Whitespace": pretokenize.whitespace,
        "WhitespaceSplit": pretokenize.whitespace_split,
        "Punctuation": lambda: pretokenize.punctuation(BEHAVIORS[c.get("behavior", "Isolated")]),
        "Digits": lambda: pretokenize.digits(c.get("individual_digits", False)),
        "CharDelimiterSplit": lambda: pretokenize.delimiter(c["delimiter"]),
        "Metaspace": lambda: pretokenize.metaspace(c.get("replacement", "▁"), scheme),
        "ByteLevel": lambda: pretokenize.byte_level(c.get("add_prefix_space", True)),
        "UnicodeScripts": pretokenize.unicode_script,
        "Split": lambda: pretokenize.split(_pattern(c["pattern"]), BEHAVIORS[c.get("behavior", "Removed")], c.get("invert", False)),
    }
    if kind not in made:
        raise ValueError(f"no pre-tokenizer is called {kind!r}")
    return made[kind]()


def decoder_of(c: dict | None) -> Stage | None:
    if not c:
        return None
    kind = c["type"]
    made: dict[str, Callable[[], Stage]] = {
        "Sequence": lambda: decode.sequence(*filter(None, map(decoder_of, c["decoders"]))),
        "BPEDecoder": lambda: decode.bpe(c.get("suffix", "</w>")),
        "WordPiece": lambda: decode.wordpiece(c.get("prefix", "##"), c.get("cleanup", True)),
        "CTC": lambda: decode.ctc(c.get("pad_token", "<pad>"), c.get("word_delimiter_token", "|"), c.get("cleanup", True)),
        "Fuse": decode.fuse,
        "Strip": lambda: decode.strip(c["content"], c.get("start", 0), c.get("stop", 0)),
        "Replace": lambda: decode.replace(c["pattern"]["String"], c.get("content", "")),
        "Metaspace": lambda: decode.metaspace(c.get("replacement", "▁"), c.get("add_prefix_space", True)),
        "ByteFallback": decode.byte_fallback,
        "ByteLevel": decode.byte_level,
    }
    if kind not in made:
        raise ValueError(f"no decoder is called {kind!r}")
    return made[kind]()


def vocabulary_of(c: dict) -> Vocab:
    """The model with its vocabulary, in the order of its ids; holes are empty tokens."""
    kind = {"BPE": "bpe", "WordPiece": "wordpiece", "Unigram": "unigram"}.get(c.get("type") or ("Unigram" if isinstance(c.get("vocab"), list) else "BPE"))
    if kind is None:
        raise ValueError(f"no model is called {c.get('type')!r}")
    if isinstance(c["vocab"], list):
        return Vocab(kind, tuple(t for t, _ in c["vocab"]), scores=tuple(float(s) for _, s in c["vocab"]), unk=c.get("unk_id"))
    tokens = [""] * (max(c["vocab"].values(), default=-1) + 1)
    for t, k in c["vocab"].items():
        tokens[k] = t
    merges = tuple(tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in c.get("merges", ()))
    return Vocab(kind, tuple(tokens), merges, unk=c["vocab"].get(c.get("unk_token")))


def frames_of(c: dict | None) -> dict:
    """single, pair and specials of a post-processor."""
    if not c:
        return {}
    kind = c["type"]
    if kind in ("BertProcessing", "RobertaProcessing"):
        (cls, cls_id), (sep, sep_id) = c["cls"], c["sep"]
        pair = f"{cls} $A {sep} $B:1 {sep}:1" if kind == "BertProcessing" else f"{cls} $A {sep} {sep}:1 $B:1 {sep}:1"
        return {"single": f"{cls} $A {sep}", "pair": pair, "specials": {cls: [cls_id], sep: [sep_id]}}
    if kind == "TemplateProcessing":

        def piece(p: dict) -> str:
            (name, value), = p.items()
            return f"${value['id']}:{value.get('type_id', 0)}" if name == "Sequence" else f"{value['id']}:{value.get('type_id', 0)}"

        given = c.get("special_tokens") or c.get("speical_tokens") or {}
        return {"single": [piece(p) for p in c["single"]], "pair": [piece(p) for p in c.get("pair") or c["single"]], "specials": {k: list(v["ids"]) for k, v in given.items()}}
    if kind == "Sequence":
        return next((f for f in map(frames_of, c["processors"]) if f), {})
    if kind == "ByteLevel":
        return {}
    raise ValueError(f"no post-processor is called {kind!r}")


def pipeline_of(config: dict | str) -> Pipeline:
    """The whole pipeline of a configuration, or of its JSON."""
    c = json.loads(config) if isinstance(config, str) else config
    vocab, norm = vocabulary_of(c["model"]), normalizer_of(c.get("normalizer"))
    flags = ("single_word", "lstrip", "rstrip", "normalized", "special")
    tokens = [AddedToken(t["content"], **{f: t[f] for f in flags if f in t}) for t in sorted(c.get("added_tokens") or (), key=lambda t: t["id"])]
    added = AddedVocabulary(vocab).add(*tokens) if tokens else None
    return Pipeline(vocab, norm, pretokenizer_of(c.get("pre_tokenizer")), decoder=decoder_of(c.get("decoder")), added=added, **frames_of(c.get("post_processor")))


def settings_of(config: dict) -> dict:
    """The arguments for :meth:`Pipeline.encode` that truncation and padding of a configuration give."""
    out: dict = {}
    if t := config.get("truncation"):
        out |= {"most": t["max_length"], "strategy": {"LongestFirst": "longest_first", "OnlyFirst": "only_first", "OnlySecond": "only_second"}[t.get("strategy", "LongestFirst")]}
        out |= {"stride": t["stride"]} if t.get("stride") else {}
    if p := config.get("padding"):
        if isinstance(p.get("strategy"), dict) and "Fixed" in p["strategy"]:
            out["pad_to"] = p["strategy"]["Fixed"]
        out |= {"pad_id": p.get("pad_id", 0), "pad_type": p.get("pad_type_id", 0), "pad_token": p.get("pad_token", "[PAD]"), "pad_left": p.get("direction", "Right") == "Left"}
    return out
