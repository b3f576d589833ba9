"""IPv6 texts against Python's, and how often a text's groups are worked out."""

import ipaddress
import random

from pyspark.sql import functions as F

from packetloom.functions.bytes import ipv6_text


def test_texts_of_addresses(spark):
    r = random.Random(5)
    some = [b"".join(r.choice((b"\0\0", b"\0\0", b"\0\1", b"\x10\0", b"\xab\xcd")) for _ in range(8)) for _ in range(2000)]
    some += [bytes(16), bytes(15) + b"\1", b"\1" + bytes(15), bytes(10) + b"\xff\xff\x0a\0\0\xff", bytes(8) + b"\xff\xff" + bytes(6)]
    rows = spark.createDataFrame([(bytearray(b),) for b in some] + [(None,)], "b binary").select("b", ipv6_text(F.col("b")).alias("text"))
    plan = str(rows._jdf.queryExecution().optimizedPlan())
    assert plan.count("regexp_replace(") == 2
    for x in rows.collect():
        assert x["text"] == (None if x["b"] is None else str(ipaddress.IPv6Address(bytes(x["b"]))))
