"""Vocabularies as tables (id, token): set operations by semi and anti joins, ids numbered anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def renumbered(df: DataFrame, *order: str) -> DataFrame:
    """A vocabulary's ids are positions; it is one table of bounded size, so one ordered window numbers it."""
    return df.withColumn("id", F.row_number().over(W.orderBy(*order)).cast("bigint") - 1)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return renumbered(a.join(b.select("token").distinct(), "token", "left_semi"), "id").select("id", "token")


def trim(a: DataFrame, b: DataFrame) -> DataFrame:
    return renumbered(a.join(b.select("token").distinct(), "token", "left_anti"), "id").select("id", "token")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    new = b.groupBy("token").agg(F.min("id").alias("id")).join(a.select("token"), "token", "left_anti")
    both = a.select("token", "id", F.lit(0).alias("side")).unionByName(new.select("token", "id", F.lit(1).alias("side")))
    return renumbered(both, "side", "id").select("id", "token")


def append(a: DataFrame, tokens: list[str]) -> DataFrame:
    """Raises if a token is there already or given twice."""
    if len(set(tokens)) < len(tokens) or a.filter(F.col("token").isin(tokens)).limit(1).count():
        raise ValueError("a token is in the vocabulary already")
    new = a.sparkSession.createDataFrame(list(enumerate(tokens)), "id bigint, token string")
    return union(a, new)


def coverage(pieces: DataFrame, vocab: DataFrame) -> DataFrame:
    """token, n, known: how often each piece occurs and whether the vocabulary has it."""
    counts = pieces.groupBy("token").agg(F.count("*").alias("n"))
    return counts.join(vocab.select("token", F.lit(True).alias("known")).distinct(), "token", "left").withColumn("known", F.coalesce("known", F.lit(False)))
