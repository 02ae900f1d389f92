"""Joins with hot keys write no files, and scans hold few rows at a time."""

from pyspark.sql import functions as F

from quillon.llm import neardup
from quillon.llm.common import SCAN_ROWS, bounded_batches


def test_spread_join_without_files(spark, monkeypatch):
    left = spark.range(1200).select(F.when(F.col("id") < 900, b"h").when(F.col("id") < 1010, b"i").otherwise(F.col("id").cast("string").cast("binary")).alias("hub"), F.col("id").cast("string").cast("binary").alias("node"))
    right = left.select("hub").distinct().filter("hub != cast('1100' as binary)").withColumn("twice", F.concat("hub", "hub"))
    monkeypatch.setattr(neardup, "cut", None)
    got = neardup.spread_join(left, left, right, "hub")
    rows = sorted((bytes(r.hub), bytes(r.node), bytes(r.twice)) for r in got.select("hub", "node", "twice").collect())
    assert rows == sorted((bytes(r.hub), bytes(r.node), bytes(r.hub) * 2) for r in left.collect() if bytes(r.hub) != b"1100")
    places = {r.hub.decode(): r.n for r in got.groupBy("hub").agg(F.countDistinct("place").alias("n")).collect()}
    assert places["h"] == neardup.PLACES and places["i"] > 8 and places["1011"] == 1


def test_scan_rows(spark):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(key, "4096")
    bounded_batches(spark)
    assert spark.conf.get(key) == str(SCAN_ROWS)
    spark.conf.set(key, "10")
    bounded_batches(spark)
    assert spark.conf.get(key) == "10"
    spark.conf.unset(key)
