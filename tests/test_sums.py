"""One's complement sums against plain Python, and what they may cost."""

import random

from pyspark.sql import functions as F

from packetloom.functions.checksum import checksum, folded, word_sum
from packetloom.sources import synth as S


def plain(b: bytes) -> int:
    total = sum(b[i] * 256 + (b[i + 1] if i + 1 < len(b) else 0) for i in range(0, len(b), 2))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total


def test_sums_of_every_length(spark):
    r = random.Random(3)
    some = [r.randbytes(n) for n in [*range(64), 1500, 65535]] + [b"\xff" * n for n in (1, 2, 6, 7, 12, 24, 25, 48, 65536)] + [b"\0" * n for n in (1, 24, 25, 60)]
    rows = spark.createDataFrame([(bytearray(b),) for b in some] + [(None,)], "b binary")
    got = rows.select("b", folded(word_sum(F.col("b"))).alias("folded"), checksum(F.col("b")).alias("sum")).collect()
    for x in got:
        assert (x["folded"], x["sum"]) == ((None, None) if x["b"] is None else (plain(x["b"]), 0xFFFF - plain(x["b"])))


def test_message_is_worked_out_once_for_all_words(spark):
    """The sum of a message of 1024 bytes that itself has a sum put in: the lambdas over its
    words hold the message as a value, not the expression that makes it."""
    message = S.with_checksum(S.join(S.zeros(F.col("id") + 1020), S.hexed("00010002")), 2)
    rows = spark.range(3).select(checksum(message).alias("sum"))
    plan = str(rows._jdf.queryExecution().optimizedPlan())
    starts = [i for i in range(len(plan)) if plan.startswith("lambdafunction(", i)]
    assert starts
    for start in starts:
        depth, end = 1, start + len("lambdafunction(")
        while depth:
            depth += {"(": 1, ")": -1}.get(plan[end], 0)
            end += 1
        assert "concat(" not in plan[start:end]
    assert [x["sum"] for x in rows.collect()] == [0, 0, 0]
