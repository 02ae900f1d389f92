"""Kernels against brute force, file formats, added tokens, processors, configurations and long texts."""

import json
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from quillon.functions.models import chunks_of, new_model
from quillon.operators import added, encode, encoding, normalize, postprocess, pretokenize
from quillon.pipeline import Pipeline
from quillon.plans import vocabularies as V
from quillon.schema import Vocab
from quillon.sources import config, gguf, sentencepiece, tokd


def greedy(ids, text, unknown):
    out, at = [], 0
    while at < len(text):
        n = next((n for n in range(len(text) - at, 0, -1) if text[at : at + n] in ids), 0)
        out.append(ids[text[at : at + n]] if n else unknown)
        at += n or 1
    return [i for i in out if i is not None]


@pytest.mark.parametrize("size", [40, 3000])
@pytest.mark.parametrize("marks", ["lead", "inside"])
def test_kernels_match_brute_force(size, marks):
    rng = random.Random(size)
    pick = lambda: ("▁" if rng.random() < 0.3 else "") + "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) + ("▁a" if marks == "inside" and rng.random() < 0.1 else "")
    tokens = tuple(dict.fromkeys(["<unk>", "▁", "a", *(pick() for _ in range(size))]))
    for unk in (None, 0):
        spm, uni = new_model(Vocab("spm", tokens, unk=unk)), new_model(Vocab("unigram", tokens, unk=unk))
        for _ in range(150):
            text = "".join(rng.choice("abcdéx  \n") for _ in range(rng.randint(0, 40)))
            meta = "▁" + text.replace(" ", "▁").replace("\n", "▁")
            want = greedy(spm.ids, meta, unk) if text else []
            assert spm.encode(text) == want and spm.count(text) == len(want)
            lost = unk is None and text and any(c not in spm.ids for c in set(meta)) and len("".join(tokens[i] for i in want)) < len(meta)
            assert uni.encode(text) == ([] if lost else want) and uni.count(text) == len(uni.encode(text))
            assert [k for k, _, _ in spm.walk(text)] == (want if text else [])
    bpe = new_model(Vocab("bpe", tokens, pre_type="gpt2"))
    for _ in range(150):
        text = "".join(rng.choice("abcdéx  1.") for _ in range(rng.randint(1, 40)))
        assert [k for _, found in bpe.parts(text) for k, _, _ in found] == bpe.encode(text) and bpe.count(text) == len(bpe.encode(text))


def test_caches_chunks_and_plain_search():
    m = new_model(V.BPE)
    ids = m.encode("the nation and the the")
    m.set_cache(0)
    assert m.encode("the nation and the the") == ids and not m.memo
    m.set_cache(2)
    assert m.encode("the nation and the the") == ids and len(m.memo) <= 2
    m.clear_cache()
    assert not m.memo
    text = "thé " * 9000
    assert chunks_of(text, 16384) and "".join(chunks_of(text, 16384)) == text and chunks_of("", 5) == []
    assert chunks_of("aéé", 2) == ["aé", "é"]
    assert m.chunked("the nation") == m.encode("the nation")
    assert m.plain("the") == [m.ids["the"]] and m.plain("thee") == [m.ids["t"], ord("h"), m.ids["e"], m.ids["e"]]


def test_long_texts_take_linear_time(spark):
    text = "word, " * 40_000
    df = spark.createDataFrame([(text,)], "t string")
    began = time.time()
    spans = pretokenize.with_offsets(pretokenize.punctuation()(F.col("t")))
    row = df.select(F.element_at(spans, -1).alias("last"), F.size(pretokenize.split("o", "merged_with_next")(F.col("t"))).alias("n"), F.size(pretokenize.bpe("gpt2", "Ġ")(F.col("t"))).alias("m")).head()
    assert row.last.end == len(text) and row.n == 40_001 and row.m == 80_001 and time.time() - began < 60


# --- files
def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def test_sentencepiece_model():
    piece = lambda t, s, k: (lambda b: b"\x0a" + varint(len(b)) + b)(b"\x0a" + varint(len(t.encode())) + t.encode() + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(k))
    trainer = b"\x18\x02" + varint(40 << 3) + varint(0) + varint(43 << 3) + varint((1 << 64) - 1)
    data = piece("<unk>", 0.0, 2) + piece("▁the", -1.5, 1) + b"\x12" + varint(len(trainer)) + trainer
    v = sentencepiece.decode(data)
    assert (v.model, v.tokens, v.scores, v.token_type, v.unk, v.bos, v.pad) == ("spm", ("<unk>", "▁the"), (0.0, -1.5), (2, 1), 0, 1, None)
    for bad in (data[:-1], b"\x0b", b"\xff" * 11):
        with pytest.raises(ValueError):
            sentencepiece.decode(bad)


def test_gguf_skips_what_follows_a_tensor_key():
    def entry(key, kind, body):
        return struct.pack("<Q", len(key)) + key.encode() + struct.pack("<I", kind) + body

    junk = bytes([250, 0, 255]) * 30
    data = b"GGUF" + struct.pack("<IQQ", 3, 0, 2) + entry("blk.weight", 4, struct.pack("<I", 7)) + junk + entry("tokenizer.ggml.bos_token_id", 4, struct.pack("<I", 3)) + bytes(16)
    assert gguf.metadata(data) == {"blk.weight": 7, "tokenizer.ggml.bos_token_id": 3}
    assert gguf.after_tensor(data, "general.name", 40) == 40
    assert gguf.decode(gguf.encode_metadata({"tokenizer.ggml.pre": (8, "smollm")}), pre="reader").pre_type == "default"
    assert gguf.decode(gguf.encode_metadata({"tokenizer.ggml.pre": (8, "smollm")})).pre_type == "starcoder"


def test_tokd_configuration_blobs():
    v = Vocab("bpe", ("a",), config={"normalizer": "bert", "normalizer_config": '{"x":1}', "decoder": "fuse", "free": {"k": [1, 2]}, "spm_model": "00ff"})
    assert tokd.decode(tokd.encode(v)).config == v.config
    assert tokd.from_two_parts(b"\x02\0\0\0ab") == (b"ab", b"")


# --- added tokens, processors, configurations
def test_added_vocabulary(spark):
    a = added.AddedVocabulary(V.BPE).add(added.AddedToken("the"), added.AddedToken(""), added.AddedToken("new")).add_special("<x>").add(added.AddedToken("new"))
    n = len(V.BPE.tokens)
    assert len(a) == 3 and a.ids() == {"the": V.BPE.ids()["the"], "new": n, "<x>": n + 1}
    df = spark.createDataFrame([("<x>",), ("th",), ("??",)], "t string")
    got = df.select(a.token_to_id(F.col("t")), a.is_special(F.col("t")), a.id_to_token(a.token_to_id(F.col("t")))).collect()
    assert [tuple(r) for r in got] == [(n + 1, True, "<x>"), (V.BPE.ids()["th"], False, "th"), (None, False, None)]
    p = Pipeline(V.BPE, pretokenizer=pretokenize.whitespace(), added=a)
    assert spark.createDataFrame([("the <x> new",)], "t string").select(p.ids(F.col("t"))).head()[0] == [V.BPE.ids()["the"], n + 1, n]


def test_processors_and_merging(spark):
    df = spark.createDataFrame([("the on", "an")], "a string, b string")
    plain = Pipeline(V.BPE, pretokenizer=pretokenize.byte_level())
    both = df.select(plain._laid_out(F.col("a")).alias("x"), plain._laid_out(F.col("b")).alias("y"))
    default = postprocess.Default().apply(both, "x", "y").head()
    assert default.type_ids == [0] * (len(default.ids) - 1) + [1] and default.sequence_ranges[1].end == len(default.ids)
    steps = postprocess.Sequence((postprocess.ByteLevel(False), postprocess.bert_processor(1, 2)))
    assert steps.added(False) == 2 and steps.added(True) == 3 and postprocess.Roberta(0, 2).added(True) == 4
    row = steps.apply(both, "x", "y").head()
    assert row.ids[0] == 1 and row.ids[-1] == 2 and row.special_tokens_mask[0] == 1
    two = postprocess.Roberta(0, 2).apply(both, "x", "y").head()
    assert two.tokens[0] == "<s>" and two.tokens.count("</s>") == 3
    once = both.select(F.struct(*[c.alias(k) for k, c in encoding.new_encoding(F.col("x.ids"), F.col("x.tokens"), 1).items()]).alias("e"), F.lit(None).cast("struct<ids:array<bigint>,type_ids:array<int>,tokens:array<string>,offsets:array<struct<start:int,end:int>>,special_tokens_mask:array<int>,attention_mask:array<int>,words:array<int>,sequence_ranges:map<int,struct<start:int,end:int>>>").alias("none"))
    merged = once.select(*[c.alias(k) for k, c in encoding.merge_encodings([F.col("e"), F.col("none"), F.col("e")]).items()]).head()
    n = len(merged.ids) // 2
    assert merged.ids[:n] == merged.ids[n:] and set(merged.type_ids) == {1} and merged.sequence_ranges[1].end == 2 * n
    s = spark.range(1).select(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end")).alias("s"))
    c = F.col("s")
    assert s.select(encoding.span_length(c), encoding.span_contains(c, 5), encoding.span_first(c), encoding.span_last(c)).head()[:] == (3, False, 2, 4)


def test_wordpiece_behind_a_pretokenizer(spark):
    """A continuation is found as by the model alone."""
    vocab = Vocab("wordpiece", ("[UNK]", "[CLS]", "[SEP]", "play", "##ing", "hello"), unk=0)
    p = Pipeline(vocab, normalize.bert(), pretokenize.bert(), "[CLS] $A [SEP]", "[CLS] $A [SEP] $B:1 [SEP]:1", {"[CLS]": [1], "[SEP]": [2]})
    df = spark.createDataFrame([("Hello playing", "hello"), ("", "x")], "t string, u string")
    row = p.encode(df, "t").head()
    assert row.ids == [1, 5, *new_model(vocab).encode("playing"), 2]
    assert [tuple(o) for o in row.offsets][:3] == [(0, 0), (0, 5), (6, 10)] and row.words[1:3] == [0, 1]
    pair = p.encode(df, "t", "u", most=7, pad_to=9, pad_left=True).collect()
    assert all(len(r.ids) == 9 for r in pair) and pair[0].attention_mask[:2] == [0, 0] and pair[0].sequence_ranges[0].start == 3
    parts = p.encode(df, "t", "u", most=5, stride=0).collect()  # room for one token of each
    a, b = new_model(vocab).encode("hello") + new_model(vocab).encode("playing"), new_model(vocab).encode("hello")
    n_b = min(len(b), 1)
    mine = sorted((r.part, r.ids) for r in parts if r.t)
    assert mine == [(k, [1, *a[k : k + 2 - n_b], 2, *b, 2]) for k in range(len(a))]
    with pytest.raises(ValueError):
        p.encode(df, "t", most=2)


def test_big_vocabulary_behind_a_pretokenizer(spark):
    rng = random.Random(1)
    vocab = Vocab("bpe", tuple(dict.fromkeys("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(20_000))), pre_type="gpt2")
    p = Pipeline(vocab, pretokenizer=pretokenize.whitespace())
    began = time.time()
    df = spark.createDataFrame([("abcdef hgfe",)], "t string")
    assert df.select(p.ids(F.col("t"))).head()[0] == df.select(encode.encode(F.col("t"), vocab)).head()[0] and time.time() - began < 20


def test_configuration(spark):
    c = {
        "model": {"type": "BPE", "vocab": {"th": 0, "e": 2, "the": 1}, "merges": ["th e"], "unk_token": None},
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"String": "x"}, "content": "e"}]},
        "pre_tokenizer": {"type": "Split", "pattern": {"Regex": "[ ]+"}, "behavior": "Removed"},
        "post_processor": {"type": "BertProcessing", "cls": ["[C]", 7], "sep": ["[S]", 8]},
        "decoder": {"type": "Fuse"},
        "added_tokens": [{"id": 3, "content": "<a>", "special": True, "normalized": False}],
        "truncation": {"max_length": 5, "strategy": "LongestFirst", "stride": 1},
        "padding": {"strategy": {"Fixed": 6}, "pad_id": 9, "direction": "Left"},
    }
    p = config.pipeline_of(json.dumps(c))
    df = spark.createDataFrame([("THE thx <a>",)], "t string")
    assert df.select(p.ids(F.col("t"))).head()[0] == [1, 1, 3]
    row = p.encode(df, "t", **config.settings_of(c)).orderBy("part").head()
    assert row.ids == [9, 7, 1, 1, 3, 8] and row.tokens[0] == "[PAD]"
    assert df.select(p.decode(p.ids(F.col("t")))).head()[0] == "thethe<a>"
    for part in ("normalizer", "pre_tokenizer", "decoder", "post_processor", "model"):
        with pytest.raises((ValueError, KeyError)):
            config.pipeline_of(c | {part: {"type": "nothing of this name"}})


def test_scripts(spark):
    df = spark.createDataFrame([("abc дом, カナ漢字ー x",), ("  a",)], "t string")
    got = [r[0] for r in df.select(pretokenize.unicode_script()(F.col("t"))).collect()]
    assert got == [["abc ", "дом", ", ", "カナ漢字ー ", "x"], ["a"]]


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
