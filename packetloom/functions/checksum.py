"""One's complement sums of 16-bit words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.bytes import let, raw

#: Messages of at most so many bytes are summed without a loop.
SHORT = 24


def _six(b: Column, at: Column | int) -> Column:
    """Six bytes as one number, filled up with zeros where the message ends before."""
    return F.conv(F.rpad(F.hex(raw(b, at, 6)), 12, "0"), 16, 10).cast("bigint")


def word_sum(b: Column) -> Column:
    """A number that folds to the same as the sum of the 16-bit words, and is 0 only with it: as
    2**16 leaves 1 by 0xFFFF, three words can be read as one number. A last odd byte counts as
    a word's high byte. b is read several times, so it should be a column of its own."""
    size = F.length(b)
    short = sum((F.when(size > at, _six(b, at)).otherwise(0) for at in range(6, SHORT, 6)), _six(b, 0))

    # within the lambdas b is a value: as an expression it would be worked out for each word
    def looped(b: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.length(b) - 1, F.lit(0)), F.lit(6)), lambda i: _six(b, i))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, x: folded(s + x))

    return F.when(size <= SHORT, short).otherwise(let(b, looped))


def folded(total: Column) -> Column:
    """The sum with its carries added in, below 2**16: its remainder by 0xFFFF, but 0xFFFF for
    multiples of that other than 0 (-1 leaves -1)."""
    return (total - 1) % 0xFFFF + 1


def checksum(b: Column) -> Column:
    """The complement of the folded sum; 0 over a message that holds a right checksum."""
    return F.lit(0xFFFF) - folded(word_sum(b))


def icmpv6_checksum(source: Column, destination: Column, message: Column) -> Column:
    """Over the pseudo header (addresses of 16 bytes, length, next header 58) and message."""
    pseudo = word_sum(F.concat(source, destination)) + F.length(message) + 58
    return F.lit(0xFFFF) - folded(pseudo + word_sum(message))
