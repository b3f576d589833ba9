"""Decoding of frames as they come. Decoding keeps no state, so a streaming DataFrame of
frames decodes like a batch; what is added here is counting by time with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.plans.config import ParseConfig
from packetloom.plans.decode import decode
from packetloom.sources.capture import stream_captures, with_time


def decoded_stream(spark: SparkSession, path: str, config: ParseConfig = ParseConfig(), **options: str) -> DataFrame:
    """Frames of the captures that come to a folder, decoded, with ts."""
    rows = with_time(stream_captures(spark, path, **options)).withColumnRenamed("error", "capture_error")
    return decode(rows, config=config)


def talkers(decoded: DataFrame, window: str = "1 hour", late: str = "10 minutes", size: str = "data") -> DataFrame:
    """Packets and bytes by time window and pair of IPv4 addresses; frames that come later
    than ``late`` behind the newest are left out."""
    return (
        decoded.withWatermark("ts", late)
        .groupBy(F.window("ts", window), F.col("ipv4.source").alias("source"), F.col("ipv4.destination").alias("destination"))
        .agg(F.count("*").alias("packets"), F.sum(F.length(size)).alias("bytes"))
    )
