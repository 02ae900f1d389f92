"""Encoding streams: every operator is row-local, so a stream is encoded as a table is, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.encode import encode
from quillon.schema import Vocab


def encode_stream(stream: DataFrame, vocab: Vocab, text: str = "text") -> DataFrame:
    """``stream`` with ids and n_tokens."""
    return stream.withColumn("ids", encode(F.col(text), vocab)).withColumn("n_tokens", F.size("ids"))


def token_rate(stream: DataFrame, vocab: Vocab, time: str, window: str = "5 minutes", late: str = "10 minutes", text: str = "text") -> DataFrame:
    """Tokens by time window; rows later than ``late`` are left out."""
    counted = encode_stream(stream, vocab, text).withWatermark(time, late)
    return counted.groupBy(F.window(time, window)).agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_texts"))
