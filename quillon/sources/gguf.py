"""GGUF metadata: the key-value section of a model file, as far as it describes a tokenizer."""

from __future__ import annotations

import re
import struct

from quillon.schema import Vocab

#: Number formats by GGUF value type; 8 is a string, 9 an array.
NUMBERS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
MOST_KEY, MOST_ELEMENT = 1 << 20, 10 << 20
#: Model kinds by architecture; other names are searched for a kind.
ARCHITECTURES = {
    "bpe": "gpt2 phi-2 mpt olmo jais llama3 falcon3 pixtral qwen2 megrez stablelm2 hunyuan qwen35 gpt-4o llama4 starcoder command-r refact deepseek-llm deepseek-coder",
    "spm": "falcon",
    "unigram": "gemma palm",
    "wordpiece": "bert roberta dphat",
}
KINDS_IN_NAMES = (("bpe", "bpe"), ("spm", "spm"), ("sentencepiece", "spm"), ("unigram", "unigram"), ("wordpiece", "wordpiece"))
#: Pre-tokenization types by the names in model files; all others are default.
PRE_NAMES = {
    "qwen2": "qwen2 megrez",
    "gpt2": "gpt-2 phi-2 jina-es jina-de jina-v2-es jina-v2-de a.x-4.0 mpt olmo jais trillion granite-docling",
    "llama3": "llama3 llama-v3 llama-bpe falcon3 falcon-h1 pixtral midm-2.0 lfm2 jina-v5-nano",
    "starcoder": "starcoder refact command-r smollm codeshell exaone minerva-7b",
    "deepseek": "deepseek-llm deepseek-coder deepseek-v3 hunyuan-dense joyai-llm",
    "falcon": "falcon",
    "qwen35": "qwen35",
    "stablelm2": "stablelm2 hunyuan solar-open",
    "gpt4o": "gpt-4o llama4 kanana2",
    "gemma4": "gemma4",
}
_MODEL_OF = {name: kind for kind, names in ARCHITECTURES.items() for name in names.split()}
_PRE_OF = {name: kind for kind, names in PRE_NAMES.items() for name in names.split()}


def model_of(architecture: str) -> str:
    return _MODEL_OF.get(architecture) or next((kind for part, kind in KINDS_IN_NAMES if part in architecture), architecture)


def pre_type_of(name: str) -> str:
    return _PRE_OF.get(name, "default")


#: Beginnings and parts of names by which the file reader also tells the type.
PRE_BEGINNINGS = (("gpt-2", "gpt2"), ("llama3", "llama3"), ("qwen2", "qwen2"), ("starcoder", "starcoder"), ("deepseek-llm", "deepseek"), ("deepseek-coder", "deepseek"), ("falcon", "falcon"))
PRE_PARTS = (("llama-bpe", "llama3"), ("command-r", "starcoder"))
NOT_IN_READER = frozenset("jina-es jina-de jina-v2-es jina-v2-de a.x-4.0 trillion granite-docling llama-v3 falcon-h1 midm-2.0 lfm2 jina-v5-nano smollm codeshell exaone minerva-7b deepseek-v3 hunyuan-dense joyai-llm solar-open kanana2 gemma4".split())


def reader_pre_type_of(name: str) -> str:
    """The file reader's own mapping, which knows fewer names but also beginnings of names."""
    if name in _PRE_OF and name not in NOT_IN_READER:
        return _PRE_OF[name]
    found = [kind for head, kind in PRE_BEGINNINGS if name.startswith(head)] + [kind for part, kind in PRE_PARTS if part in name]
    return found[0] if found else "default"


def merge_without_rank(merge: str) -> str:
    return merge.split(" # rank:", 1)[0]


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def number(self, code: str):
        value = struct.unpack_from("<" + code, self.data, self.at)[0]
        self.at += struct.calcsize("<" + code)
        return value

    def text(self, most: int) -> str:
        n = self.number("Q")
        if n > most or self.at + n > len(self.data):
            raise ValueError(f"a string of {n} bytes is too long")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        if kind == 8:
            return self.text(MOST_ELEMENT)
        if kind == 9:
            inner, n = self.number("I"), self.number("Q")
            if inner in NUMBERS:
                out = struct.unpack_from(f"<{n}{NUMBERS[inner]}", self.data, self.at)
                self.at += n * struct.calcsize("<" + NUMBERS[inner])
                return list(out)
            if inner != 8:
                raise ValueError(f"arrays of type {inner} are not read")
            return [self.text(MOST_ELEMENT) for _ in range(n)]
        if kind not in NUMBERS:
            raise ValueError(f"unknown value type {kind}")
        return self.number(NUMBERS[kind])


def metadata(data: bytes, header: str = "public") -> dict:
    """All keys and values.  ``header="reference"`` takes the number of keys from bytes 8 to 16."""
    r = _Reader(data)
    if data[:4] != b"GGUF":
        raise ValueError("not a GGUF file")
    r.at = 4
    if r.number("I") > 3:
        raise ValueError("GGUF versions above 3 are not read")
    first = r.number("Q")
    keys = r.number("Q") if header == "public" else first
    out = {}
    for _ in range(keys):
        if r.at >= len(data):
            break
        key = r.text(MOST_KEY)
        out[key] = r.value(r.number("I"))
        r.at = after_tensor(data, key, r.at)
    return out


#: After a key of a tensor, the next key is looked for in so many bytes; a key has so many characters at most.
TENSOR_GAP, TENSOR_KEY = 2000, 256
TENSOR_ENDS = (".weight", ".bias")
_PLAUSIBLE = re.compile(rb"[a-z][\x20-\x7e]*")


def after_tensor(data: bytes, key: str, at: int) -> int:
    """Where the next key stands after what belongs to a tensor's key; ``at`` itself for other keys or if there is none.

    A key is a length of 1 to 256, so many printable characters that begin with a small letter, and a value type.
    """
    if not key.endswith(TENSOR_ENDS):
        return at
    for place in range(at + 1, min(at + TENSOR_GAP + 1, len(data) - 12)):
        n = int.from_bytes(data[place : place + 8], "little")
        name = data[place + 8 : place + 8 + n] if 1 <= n <= TENSOR_KEY else b""
        kind = data[place + 8 + n : place + 12 + n] if name else b""
        if len(kind) == 4 and _PLAUSIBLE.fullmatch(name) and int.from_bytes(kind, "little") <= 12:
            return place
    return at


def decode(data: bytes, header: str = "public", pre: str = "canonical") -> Vocab:
    """``pre="reader"`` takes the file reader's own mapping of pre-tokenization names."""
    m = metadata(data, header)
    get = lambda k, default=None: m.get(f"tokenizer.ggml.{k}", default)
    ids = {n: get(f"{k}_token_id") for n, k in (("bos", "bos"), ("eos", "eos"), ("unk", "unknown"), ("pad", "padding"), ("eot", "eot"), ("eom", "eom"))}
    return Vocab(
        model=model_of(get("model") or m.get("general.architecture", "")),
        tokens=tuple(get("tokens", ())),
        merges=tuple(tuple(x.split(" ", 1)) for x in get("merges", ()) if " " in x),
        scores=tuple(get("scores", ())),
        token_type=tuple(get("token_type", ())),
        add_bos=bool(get("add_bos_token", False)),
        add_eos=bool(get("add_eos_token", False)),
        pre_type=(reader_pre_type_of if pre == "reader" else pre_type_of)(get("pre", "default")),
        space=get("space_char", "") or "",
        **ids,
    )


def encode_metadata(values: dict[str, tuple[int, object]]) -> bytes:
    """A GGUF file that holds only metadata; values are (type, value), arrays ((9, element type), list)."""

    def text(s: str) -> bytes:
        return struct.pack("<Q", len(s.encode())) + s.encode()

    out = [b"GGUF", struct.pack("<IQQ", 3, 0, len(values))]
    for key, (kind, value) in values.items():
        out.append(text(key))
        if isinstance(kind, tuple):
            out.append(struct.pack("<IIQ", 9, kind[1], len(value)))
            out += [text(x) if kind[1] == 8 else struct.pack("<" + NUMBERS[kind[1]], x) for x in value]
        else:
            out.append(struct.pack("<I", kind) + (text(value) if kind == 8 else struct.pack("<" + NUMBERS[kind], value)))
    return b"".join(out)
