"""Streams of recognised texts: cleaned as they come, redeliveries dropped, quality by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.functions import text_rules


def text_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def cleaned_stream(stream: DataFrame, text: str) -> DataFrame:
    """The pipeline of text rules; stateless, so it runs on a stream as it is."""
    return text_rules.process_text(stream, text)


def without_redeliveries(stream: DataFrame, keys: list[str], time: str, late: str = "30 days") -> DataFrame:
    """Rows whose keys did not come before within the watermark; state is kept for that long only."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def quality_by_window(stream: DataFrame, text: str, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, texts, valid words, words) of the texts by event time."""
    t = stream.withWatermark(time, late).select(F.col(time).alias("_time"), F.col(text).alias("_text"))
    return t.groupBy(F.window("_time", window).alias("window")).agg(F.count("*").alias("texts"), F.sum(text_rules.valid_words(F.col("_text"))).alias("valid_words"), F.sum(F.size(text_rules.words(F.col("_text")))).alias("words"))
