"""``python -m packetloom``: decodes one TCP SYN and prints its addresses, ports and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.bytes import mac_text
from packetloom.plans.decode import decode

SYN = bytes.fromhex("ffffffffffff aabbccddeeff 0800" "45000028 12344000 40060000 0a000001 0a000002" "d4310050 00000001 00000000 5002ffff 00000000")


def demo(spark: SparkSession) -> DataFrame:
    t = F.col("transport.tcp")
    row = decode(spark.createDataFrame([(bytearray(SYN),)], "data binary"))
    return row.select(
        mac_text(F.col("ethernet.source")).alias("mac"), F.col("ipv4.source").alias("source"), F.col("ipv4.destination").alias("destination"),
        t["source_port"].alias("source_port"), t["destination_port"].alias("destination_port"), t["sequence_number"].alias("sequence_number"), t["flags"]["syn"].alias("syn"), t["flags"]["ack"].alias("ack"),
    )


if __name__ == "__main__":
    demo(SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()).show(truncate=False)
