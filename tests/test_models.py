"""Golden results of the models, fragments, files and columns."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from quillon.functions.models import Bpe, Spm, Unigram, WordPiece, bpe_fragments, new_model, space_mark
from quillon.operators import added, decode, encode, encoding, normalize, postprocess, pretokenize, vocabulary
from quillon.plans import vocabularies as V
from quillon.schema import Vocab
from quillon.sources import files, gguf, tokd


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).head()[0]


def arrays(spark, value, f):
    return spark.createDataFrame([(value,)], "t array<string>").select(f(F.col("t")).alias("r")).head()[0]


def test_model_goldens():
    assert Bpe(Vocab(tokens=("hello", "world", "Ġhello", "Ġworld"))).encode("hello world") == [0, 3]
    assert Bpe(Vocab(tokens=("hel", "lo", "wor", "ld", "hello", "world"))).encode("hello world") == [4, 5]
    assert Bpe(Vocab(tokens=("hello", "world", "hello world"))).encode("hello world") == [2]
    assert Bpe(Vocab(tokens=("hello", "world"))).detokenize([0, 1]) == "hello world"
    assert Bpe(Vocab(tokens=("hello", "world", "x", "hello world"), bos=100, eos=101, add_bos=True, add_eos=True)).encode("hello world") == [100, 3, 101]
    assert Bpe(Vocab(tokens=("hel", "lo"), unk=-1)).encode("xyz") == []
    assert Bpe(Vocab(tokens=("a", "b", "c", "ab", "bc", "abc"), unk=-1)).count("ab bc") == 2
    assert Spm(Vocab("spm", ("<unk>", "<s>", "</s>", "▁hello", "world"))).encode("hello world") == [3, 4]
    assert Unigram(Vocab("unigram", ("<unk>", "<s>", "</s>", "▁hello", "▁world"))).encode("hello world") == [3, 4]
    assert Unigram(Vocab("unigram", ("▁a",))).encode("ab") == []
    play = ("[UNK]", "[CLS]", "[SEP]", "play", "##ing", "hello", "world")
    assert WordPiece(Vocab("wordpiece", play)).encode("playing") == [3, 4]
    assert WordPiece(Vocab("wordpiece", play, unk=0)).encode("playing") == [3, 0, 0, 0, 4]
    assert WordPiece(Vocab("wordpiece", play)).encode("helloworld") == [5, 6]
    for model in (Bpe, Spm, Unigram, WordPiece):
        assert model(Vocab(tokens=("a",))).encode("") == [] and model(Vocab(tokens=("a",))).encode(None) is None
    assert space_mark(Vocab(tokens=("x", "▁a", "Ġb"))) == "▁"
    assert isinstance(new_model(Vocab("other", ("a",), merges=(("a", "b"),))), Bpe)
    best = Unigram(Vocab("unigram", ("▁", "a", "b", "ab"), scores=(0.0, -1.0, -1.0, -5.0)), viterbi=True)
    assert best.segment("ab") == ([0, 1, 2], -2.0)


@pytest.mark.parametrize(
    ("mode", "text", "want"),
    [
        ("qwen2", "it's a test", ["it", "'s", "a", "test"]),
        ("gpt2", "Hello world", ["Hello", "world"]),
        ("llama3", "12345", ["123", "45"]),
        ("gemma4", "hello world", ["hello world"]),
        ("default", "it's 12", ["it", "'", "s", "1", "2"]),
        ("falcon", "12345 a", ["123", "45", "a"]),
        ("deepseek", "Hello, world 1", ["Hello", " world"]),
        ("starcoder", "42 a, 'b", ["42", "a", "'", "b"]),
    ],
)
def test_fragments(spark, mode, text, want):
    assert bpe_fragments(text, mode) == want
    assert one(spark, text, pretokenize.bpe(mode)) == want


def test_fragments_agree(spark):
    """Columns and kernel on random text, with and without a space mark."""
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \t\nab'sRE12,é。_~") for _ in range(rng.randint(0, 30))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for mode in ("qwen2", "gpt2", "llama3", "default", "falcon", "qwen35", "deepseek", "starcoder"):
        for mark in ("", "Ġ"):
            got = [r[0] for r in df.select(pretokenize.bpe(mode, mark)(F.col("t"))).collect()]
            assert got == [bpe_fragments(t, mode, mark) for t in texts], mode


def test_native_and_kernel_agree(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["the", "er", "ion", " ", "\n", "é", "x", "ß", "1", "!"]) for _ in range(rng.randint(0, 25))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for vocab in (V.BPE, V.SPM, V.SPM_UNK, V.UNIGRAM):
        a, b = zip(*df.select(encode.encode_native(F.col("t"), vocab), encode.encode_kernel(F.col("t"), vocab)).collect(), strict=True)
        assert list(a) == list(b) == [new_model(vocab).encode(t) for t in texts]


def test_pretokenizers(spark):
    assert one(spark, "Hey man!", pretokenize.whitespace()) == ["Hey", "man", "!"]
    assert one(spark, "Hey, man, Good?", pretokenize.whitespace_split()) == ["Hey,", "man,", "Good?"]
    assert one(spark, "Hey 123 friend!", pretokenize.digits()) == ["Hey ", "123", " friend!"]
    assert one(spark, "Hey   friend!", pretokenize.metaspace()) == ["▁Hey", "▁", "▁", "▁friend!"]
    assert one(spark, "Hello there       dear", pretokenize.byte_level()) == ["Hello", "Ġthere", "ĠĠĠĠĠĠ", "Ġdear"]
    assert one(spark, "i⭢j", pretokenize.byte_level()) == ["i", "âŃ¢", "j"]
    assert len(one(spark, "どこで生れ。Yes", pretokenize.unicode_script())) == 3
    want = {
        "removed": ["the", "final", "countdown"],
        "isolated": ["the", "-", "final", "-", "-", "countdown"],
        "merged_with_previous": ["the-", "final-", "-", "countdown"],
        "merged_with_next": ["the", "-final", "-", "-countdown"],
        "contiguous": ["the", "-", "final", "--", "countdown"],
    }
    for behavior, pieces in want.items():
        assert one(spark, "the-final--countdown", pretokenize.split("-", behavior)) == pieces
        assert one(spark, "the-final--countdown", pretokenize.split_class("-", behavior)) == pieces
    spans = one(spark, "aé,b", lambda c: pretokenize.with_offsets(pretokenize.punctuation()(c), "byte"))
    assert [tuple(s) for s in spans] == [("aé", 0, 3), (",", 3, 4), ("b", 4, 5)]


def test_normalizers(spark):
    assert one(spark, " Hello   friend ", normalize.replace(" ", "_")) == "_Hello___friend_"
    assert one(spark, "aaaab", normalize.replace_pattern("a+", "b$1")) == "b$1b"
    assert one(spark, "İΣß", normalize.lowercase()) == "iσß" and one(spark, "ßa", normalize.uppercase()) == "ßA"
    assert one(spark, "　 a \n", normalize.strip()) == "a"
    assert one(spark, "é", normalize.strip_accents()) == "e"
    assert one(spark, "é", normalize.unicode_form("NFD")) == "é"
    assert one(spark, "a你b\x00 \x01", normalize.bert()) == "a 你 b "
    assert one(spark, "", normalize.prepend("x")) == "" and one(spark, None, normalize.default()) is None


def test_decoders(spark):
    pad = "<pad> <pad> h e e l l <pad> l o o o <pad>".split()
    assert arrays(spark, pad, decode.ctc()) == list("hello")
    assert arrays(spark, ["<0xE5>", "<0x8f>", "<0xab>", "a"], decode.byte_fallback()) == ["叫", "a"]
    assert arrays(spark, ["<0xE5>", "<0x8f>", "a"], decode.byte_fallback()) == ["�", "�", "a"]
    assert arrays(spark, ["Hey", " friend!", "HHH"], decode.strip("H", 1, 0)) == ["ey", " friend!", "HH"]
    assert arrays(spark, ["Hey", " friend!"], decode.fuse()) == ["Hey friend!"]
    assert "".join(arrays(spark, "▁ ▁ H H i i ▁ y o u".split(), decode.sequence(decode.ctc(), decode.metaspace()))) == "Hi you"
    assert arrays(spark, ["Ġhi", "âŃ¢"], decode.byte_level()) == [" hi⭢"]
    assert arrays(spark, ["a</w>", "b</w>"], decode.bpe()) == ["a ", "b"]


def test_encodings(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "ids array<bigint>")
    assert df.select(encoding.windows(F.col("ids"), 2)).head()[0] == [[1, 2], [3]]
    with pytest.raises(ValueError):
        encoding.windows(F.col("ids"), 2, 2)
    assert df.select(encoding.padded(F.col("ids"), 5, 0, True)).head()[0] == [0, 0, 1, 2, 3]
    rows = spark.createDataFrame([(a, b) for a in range(9) for b in range(9)], "a int, b int")
    for strategy in ("longest_first", "only_first", "only_second"):
        x, y = encoding.pair_lengths(F.col("a"), F.col("b"), 6, strategy)
        for a, b, n, m in rows.select("a", "b", x, y).collect():
            p, q = a, b
            while p + q > 6 and strategy == "longest_first":
                p, q = (p - 1, q) if p > q else (p, q - 1)
            if strategy != "longest_first":
                over = max(a + b - 6, 0)
                p, q = (max(a - over, 0), b) if strategy == "only_first" else (a, max(b - over, 0))
            assert (n, m) == (p, q), (strategy, a, b)
    made = postprocess.template(spark.createDataFrame([([12, 14], [15])], "a array<bigint>, b array<bigint>"), "", {"[CLS]": [1], "[SEP]": [0]}, "a", "[CLS] $A [SEP] $B:1 [SEP]:1", "b").head()
    assert made.ids == [1, 12, 14, 0, 15, 0] and made.type_ids == [0, 0, 0, 0, 1, 1]
    with pytest.raises(ValueError):
        postprocess.template(df, "[X] $A", {}, "ids")


def test_added_tokens(spark):
    tokens = [added.AddedToken("[CLS]", special=True), added.AddedToken("[SEP]", special=True)]
    assert [tuple(x) for x in one(spark, "[CLS] My [SEP]", lambda c: added.extract(c, tokens))] == [("[CLS]", True), (" My ", False), ("[SEP]", True)]
    assert [tuple(x) for x in one(spark, "nothing", lambda c: added.extract(c, tokens))] == [("nothing", False)]
    word = [added.AddedToken("an", single_word=True, lstrip=True)]
    assert [x.piece for x in one(spark, "ban an an", lambda c: added.extract(c, word)) if x.hit] == [" an", " an"]
    assert added.add([*tokens, tokens[0], added.AddedToken("")], {}, 10) == ({"[CLS]": 10, "[SEP]": 11}, 2)


def test_added_tokens_normalized(spark):
    """Normalised tokens are found in normalised text, the others in the text as it is."""
    tokens = [added.AddedToken("The"), added.AddedToken("[X]", normalized=False)]
    got = one(spark, "THE a [X] the[x]", lambda c: added.extract(c, tokens, normalize.lowercase()))
    assert [tuple(x) for x in got] == [("the", True), (" a ", False), ("[X]", True), (" ", False), ("the", True), ("[x]", False)]


def test_vocabularies(spark):
    a, b = Vocab(tokens=("x", "y", "z")), Vocab(tokens=("y", "w", "w"))
    assert a.union(b).tokens == ("x", "y", "z", "w") and a.intersect(b).tokens == ("y",) and a.trim(b).tokens == ("x", "z")
    with pytest.raises(ValueError):
        a.append("x")
    tokens = lambda df: tuple(r.token for r in df.orderBy("id").collect())
    fa, fb = (v.frame(spark).select("id", "token") for v in (a, b))
    assert tokens(vocabulary.union(fa, fb)) == a.union(b).tokens and tokens(vocabulary.trim(fa, fb)) == a.trim(b).tokens
    assert tokens(vocabulary.intersect(fa, fb)) == ("y",) and tokens(vocabulary.append(fa, ["q"])) == ("x", "y", "z", "q")


def test_files(spark, tmp_path):
    v = Vocab("wordpiece", ("[CLS]", "[SEP]", "hello", "world"), bos=102, eos=103, add_bos=True, add_eos=True)
    assert len(tokd.encode(v)) == 106 and tokd.decode(tokd.encode(v) + b"?" + struct.pack("<I", 1) + b"x") == v
    full = Vocab("bpe", ("a", "Ġ"), (("a", "b"),), (0.0, -1.5), (1, 2), 0, 1, 2, 3, -1, 4, True, False, "llama3", "Ġ")
    assert tokd.decode(tokd.encode(full)) == full
    with pytest.raises(ValueError):
        tokd.decode(b"TOKE")
    files.save_tokd(spark, full, f"file://{tmp_path}/v.tokd")
    assert files.load(spark, f"file://{tmp_path}/v.tokd", "tokd") == full
    assert [tuple(r)[3:6] for r in files.read_vocabularies(spark, f"file://{tmp_path}/v.tokd", "tokd").collect()] == [(0, "a", 0.0), (1, "Ġ", -1.5)]
    data = gguf.encode_metadata(
        {
            "general.architecture": (8, "gpt2"),
            "tokenizer.ggml.tokens": ((9, 8), ["a", "b"]),
            "tokenizer.ggml.scores": ((9, 6), [0.5, 1.0]),
            "tokenizer.ggml.merges": ((9, 8), ["a b"]),
            "tokenizer.ggml.bos_token_id": (4, 1),
            "tokenizer.ggml.add_bos_token": (7, True),
            "tokenizer.ggml.pre": (8, "llama-bpe"),
        }
    )
    got = gguf.decode(data)
    assert (got.model, got.tokens, got.merges, got.bos, got.add_bos, got.pre_type) == ("bpe", ("a", "b"), (("a", "b"),), 1, True, "llama3")
    assert gguf.pre_type_of("falcon-h1") == "llama3" and gguf.reader_pre_type_of("falcon-h1") == "falcon"
    assert gguf.model_of("my-sentencepiece") == "spm" and gguf.merge_without_rank("a b # rank:3") == "a b"


def test_streaming(spark, tmp_path):
    from quillon.streaming.encode import encode_stream

    spark.createDataFrame([("the end",), ("",)], "text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("text string").parquet(f"{tmp_path}/in")
    query = encode_stream(stream, V.SPM_UNK).writeStream.format("memory").queryName("encoded").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.n_tokens for r in spark.table("encoded").collect()) == [0, len(Spm(V.SPM_UNK).encode("the end"))]
