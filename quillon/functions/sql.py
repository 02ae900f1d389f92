"""SQL names for a vocabulary's functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from quillon.functions.models import shared_model
from quillon.schema import Vocab


def register(spark: SparkSession, name: str, vocab: Vocab) -> None:
    """``encode_<name>(text)``, ``count_<name>(text)``, ``decode_<name>(ids)`` and the table function ``tokens_<name>(text)``."""
    @F.arrow_udf("array<bigint>")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([shared_model(vocab).encode(t) for t in texts.to_pylist()], pa.list_(pa.int64()))

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([shared_model(vocab).count(t) for t in texts.to_pylist()], pa.int64())

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else shared_model(vocab).detokenize(x) for x in ids.to_pylist()], pa.string())

    class Tokens:
        def eval(self, text: str):
            m = shared_model(vocab)
            for pos, i in enumerate(m.encode(text) or []):
                yield pos, i, m.token(i)

    for kind, f in (("encode", encode), ("count", count), ("decode", decode)):
        spark.udf.register(f"{kind}_{name}", f)
    spark.udtf.register(f"tokens_{name}", udtf(Tokens, returnType="pos int, id bigint, token string"))
