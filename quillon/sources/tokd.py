"""TOKD version 2: a vocabulary and its configuration as tagged binary fields.

Header ``TOKD`` and the byte 2; then for each field a key byte, a little-endian u32 length and the
payload.  Empty and false fields are left out; the pre-tokenization type and the space mark are always
written.  Unknown keys are skipped.
"""

from __future__ import annotations

import json
import struct

from quillon.schema import Vocab

MAGIC, VERSION = b"TOKD", 2
#: The numbers of the pre-tokenization types on the wire.
PRE_TYPES = ("default", "gpt2", "qwen2", "llama3", "starcoder", "deepseek", "falcon", "qwen35", "stablelm2", "gpt4o", "gemma4")
#: Field keys of the special ids.
ID_KEYS = (("B", "bos"), ("E", "eos"), ("F", "eot"), ("H", "eom"), ("U", "unk"), ("P", "pad"))


#: Field keys of the named configurations and of the free entries.
CONFIG_KEYS = (("N", "normalizer"), ("R", "pre_tokenizer"), ("D", "decoder"))
ENTRY_KEY, SPM_KEY = "Z", "X"


def two_parts(a: bytes, b: bytes) -> bytes:
    """Two byte strings, each after its length."""
    return b"".join(struct.pack("<I", len(x)) + x for x in (a, b))


def from_two_parts(data: bytes) -> tuple[bytes, bytes]:
    """What :func:`two_parts` joined; a part that the data end before is empty."""
    out, at = [], 0
    for _ in range(2):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out[0], out[1]


def _field(key: str, payload: bytes) -> bytes:
    return key.encode() + struct.pack("<I", len(payload)) + payload


def encode(v: Vocab) -> bytes:
    out = [MAGIC, bytes([VERSION])]
    if v.model:
        out.append(_field("M", v.model.encode()))
    if v.tokens:
        out.append(_field("T", b"".join(t.encode() + b"\0" for t in v.tokens)))
    for key, name in ID_KEYS:
        if (i := getattr(v, name)) is not None:
            out.append(_field(key, struct.pack("<q", i) + b"\1"))
    out += [_field(key, b"\1") for key, on in (("A", v.add_bos), ("S", v.add_eos)) if on]
    out += [_field("Y", struct.pack("<i", PRE_TYPES.index(v.pre_type))), _field("C", struct.pack("<I", ord(v.space or "\0")))]
    out += [_field("m", a.encode() + b"\0" + b.encode()) for a, b in v.merges]
    if v.scores:
        out.append(_field("V", struct.pack(f"<{len(v.scores)}d", *v.scores)))
    if v.token_type:
        out.append(_field("W", struct.pack(f"<{len(v.token_type)}i", *v.token_type)))
    named = dict(v.config)
    if "spm_model" in named:
        out.append(_field(SPM_KEY, bytes.fromhex(named.pop("spm_model"))))
    for key, name in CONFIG_KEYS:
        if name in named:
            out.append(_field(key, two_parts(named.pop(name).encode(), named.pop(f"{name}_config", "").encode())))
    out += [_field(ENTRY_KEY, two_parts(k.encode(), json.dumps(x).encode())) for k, x in named.items()]
    return b"".join(out)


def decode(data: bytes) -> Vocab:
    if data[:4] != MAGIC or data[4:5] != bytes([VERSION]):
        raise ValueError("not a TOKD file of version 2")
    got: dict = {"merges": []}
    config: dict = {}
    at, names, kinds = 5, dict(ID_KEYS), dict(CONFIG_KEYS)
    while at + 5 <= len(data):
        key, size = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
        body = data[at + 5 : at + 5 + size]
        if len(body) < size:
            raise ValueError("the file ends inside a field")
        at += 5 + size
        if key == "M":
            got["model"] = body.decode()
        elif key == "T":
            got["tokens"] = tuple(t.decode() for t in body.split(b"\0")[:-1])
        elif key in names:
            got[names[key]] = struct.unpack_from("<q", body)[0] if body[8:9] != b"\0" else None
        elif key in "AS":
            got["add_bos" if key == "A" else "add_eos"] = body == b"\1"
        elif key == "Y":
            got["pre_type"] = PRE_TYPES[struct.unpack("<i", body)[0]]
        elif key == "C":
            got["space"] = chr(struct.unpack("<I", body)[0]).strip("\0")
        elif key == "m":
            got["merges"].append(tuple(x.decode() for x in body.split(b"\0", 1)))
        elif key == "V":
            got["scores"] = struct.unpack(f"<{size // 8}d", body)
        elif key == SPM_KEY:
            config["spm_model"] = body.hex()
        elif key in kinds:
            kind, inner = (x.decode("utf-8", "replace") for x in from_two_parts(body))
            config |= {kinds[key]: kind} | ({f"{kinds[key]}_config": inner} if inner else {})
        elif key == ENTRY_KEY:
            name, value = (x.decode("utf-8", "replace") for x in from_two_parts(body))
            try:
                config[name] = json.loads(value)
            except ValueError:
                config[name] = value
        elif key == "W":
            got["token_type"] = struct.unpack(f"<{size // 4}i", body)
    return Vocab(**got | {"merges": tuple(got["merges"]), "config": config})
