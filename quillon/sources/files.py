"""Vocabulary files as Spark tables: one row for each token, with the file's configuration.

Files are read by Spark (``binaryFile``), so any store that Spark reads will do.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillon.schema import Vocab
from quillon.sources import gguf, sentencepiece, tokd

TOKENS = "path string, model string, pre_type string, id bigint, token string, score double, token_type int"
DECODERS: dict[str, Callable[[bytes], Vocab]] = {"tokd": tokd.decode, "gguf": gguf.decode, "sentencepiece": sentencepiece.decode}


def read_vocabularies(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Every token of every file under ``path``; ``kind`` is tokd, gguf or sentencepiece."""
    decode = DECODERS[kind]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                v = decode(content)
                n, types = len(v.tokens), [*v.token_type, *([0] * len(v.tokens))]
                yield pd.DataFrame({"path": name, "model": v.model, "pre_type": v.pre_type, "id": range(n), "token": v.tokens, "score": v.score_of(), "token_type": types[:n]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, TOKENS)


def load(spark: SparkSession, path: str, kind: str) -> Vocab:
    """One vocabulary file, for use on the driver."""
    return DECODERS[kind](bytes(spark.read.format("binaryFile").load(path).select("content").head()[0]))


def save_tokd(spark: SparkSession, vocab: Vocab, path: str) -> None:
    """Write a TOKD file through Spark's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(tokd.encode(vocab)))
    stream.close()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def load_config(spark: SparkSession, path: str) -> dict:
    """A tokenizer.json as a dictionary; the key of special tokens is read in both spellings."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    config = json.loads(text)
    for bad in ("speical_tokens",):
        if bad in config and "special_tokens" not in config:
            config["special_tokens"] = config.pop(bad)
    return config
