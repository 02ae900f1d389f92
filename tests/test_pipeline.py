"""Alignment, patterns, the assembled pipeline and the SQL functions."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import patterns
from quillon.functions.alignment import Aligned, aligned, bytes_to_chars, chars_to_bytes
from quillon.functions.sql import register
from quillon.operators import decode, normalize, pretokenize
from quillon.pipeline import Pipeline
from quillon.plans import vocabularies as V


def test_alignment(spark):
    nfd = Aligned.of("élégant").normal_form("NFD")
    assert nfd.text == "élégant" and nfd.spans[:3] == ((0, 1), (0, 1), (1, 2))
    bare = nfd.remove_accents()
    assert bare.text == "elegant" and bare.to_original(0, 3) == (0, 3)
    assert Aligned.of("éa").normal_form("NFC").spans == ((0, 2), (2, 3))
    x = Aligned.of("  Hello ").strip().lowercase().replace("ll", "L").prepend("▁")
    assert x.text == "▁heLo" and x.to_original(3, 4) == (4, 6) and x.to_normalized(4, 5) == (3, 4) and x.to_normalized(0, 2) is None
    y = Aligned.of("abc").transform([("x", 1), ("b", -1), ("c", 0)])
    assert y.text == "xbc" and y.spans == ((0, 0), (0, 2), (2, 3))
    with pytest.raises(IndexError):
        x.to_original(2, 99)
    assert bytes_to_chars("Löwe", 1, 3) == (1, 2) and chars_to_bytes("Löwe", 1, 2) == (1, 3)
    got = spark.createDataFrame([("É ",), (None,), ("",)], "t string").select(aligned(F.col("t"), lambda a: a.strip().lowercase()).alias("r")).collect()
    assert (got[0].r.normalized, got[0].r.starts, got[0].r.ends) == ("é", [0], [1]) and got[2].r.normalized == ""


def test_patterns(spark):
    df = spark.createDataFrame([("aabbb",), ("",)], "t string")
    find = lambda p: [[tuple(x) for x in r[0]] for r in df.select(p.find(F.col("t"))).collect()]
    assert find(patterns.char("b"))[0] == [(0, 2, False), (2, 3, True), (3, 4, True), (4, 5, True)]
    assert find(patterns.regexp("b+")) == [[(0, 2, False), (2, 5, True)], []]
    assert find(patterns.regexp("b+").invert())[0] == [(0, 2, True), (2, 5, False)]
    assert find(patterns.string(""))[0] == [(0, 5, False)]
    assert find(patterns.char_class("a"))[0] == [(0, 1, True), (1, 2, True), (2, 5, False)]


def test_pipeline(spark):
    df = spark.createDataFrame([("The  on", "er"), ("", "the the")], "a string, b string")
    p = Pipeline(V.SPM_UNK, normalizer=normalize.lowercase(), single="[CLS] $A [SEP]", pair="[CLS] $A [SEP] $B:1 [SEP]:1", specials={"[CLS]": [1], "[SEP]": [2]})
    one = p.encode(df, "a", most=5, pad_to=6).collect()
    assert one[0].ids[0] == 1 and len(one[0].ids) == 6 and one[0].attention_mask == [1, 1, 1, 1, 1, 0]
    assert one[1].ids == [1, 2, 0, 0, 0, 0]
    two = p.encode(df, "a", "b", most=7).collect()
    assert len(two[0].ids) <= 7 and two[0].type_ids[-1] == 1
    assert [r[0] for r in df.select(p.count(F.col("b"))).collect()] == [2, 2]
    q = Pipeline(V.BPE, pretokenizer=pretokenize.whitespace(), decoder=decode.fuse())
    assert df.select(q.decode(q.ids(F.col("b")))).collect()[1][0] == "thethe"


def test_sql(spark):
    register(spark, "spm", V.SPM_UNK)
    assert spark.sql("select encode_spm('the'), count_spm('the the'), decode_spm(encode_spm('the'))").head()[:] == ([4], 2, "the")
    assert [r.token for r in spark.sql("select * from tokens_spm('the of') order by pos").collect()] == ["▁the", "▁of"]
