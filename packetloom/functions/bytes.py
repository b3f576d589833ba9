"""Readers of big-endian numbers and addresses in BINARY columns.

Offsets count from 0 and may be columns. The plain readers give NULL past the end; a
multi-byte read that runs over the end is NULL as well, never a shorter number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

At = Column | int


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _col(x: At) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def raw(b: Column, at: At, size: At) -> Column:
    """Bytes, without a guard: for reads inside a length check."""
    return F.substring(b, _col(at) + 1, _col(size))


def _number(b: Column, at: At, size: int) -> Column:
    return F.conv(F.hex(raw(b, at, size)), 16, 10)


def word(b: Column, at: At) -> Column:
    """Eight bytes as one number (signed), without a guard. A read costs about the same for one
    byte as for eight, so headers are read in words and taken apart by ``bits``."""
    return F.conv(F.hex(raw(b, at, 8)), 16, -10).cast("bigint")


def u8(b: Column, at: At) -> Column:
    return _number(b, at, 1).cast("int")


def _guarded(b: Column, at: At, size: int, kind: str) -> Column:
    return F.when(F.length(b) >= _col(at) + size, _number(b, at, size).cast(kind))


def u16(b: Column, at: At) -> Column:
    return _guarded(b, at, 2, "int")


def u24(b: Column, at: At) -> Column:
    return _guarded(b, at, 3, "bigint")


def u32(b: Column, at: At) -> Column:
    return _guarded(b, at, 4, "bigint")


def piece(b: Column, at: At, size: int) -> Column:
    """So many bytes, or NULL if there are fewer."""
    return F.when(F.length(b) >= _col(at) + size, raw(b, at, size))


def bits(value: Column, shift: int, width: int) -> Column:
    return F.shiftright(value, shift).bitwiseAND((1 << width) - 1)


def flag(value: Column, bit: int) -> Column:
    return bits(value, bit, 1) == 1


def mac_text(mac: Column) -> Column:
    """aa:bb:cc:dd:ee:ff"""
    return F.regexp_replace(F.lower(F.hex(mac)), "(..)(?!$)", "$1:")


def ipv4(b: Column, at: At) -> Column:
    """Dotted quad at an offset."""
    four = F.concat_ws(".", *[u8(b, _col(at) + i) for i in range(4)])
    return F.when(F.length(b) >= _col(at) + 4, four)


def ipv4_of(number: Column) -> Column:
    """Dotted quad of a number's low 32 bits."""
    return F.concat_ws(".", *[bits(number, shift, 8) for shift in (24, 16, 8, 0)])


def ipv4_number(text: Column) -> Column:
    """A dotted quad as a number, for range predicates."""
    part = F.split(text, r"\.")
    return sum((F.get(part, F.lit(i)).cast("bigint") * (1 << (24 - 8 * i)) for i in range(1, 4)), F.get(part, F.lit(0)).cast("bigint") * (1 << 24))


def ipv6(b: Column, at: At) -> Column:
    """Canonical text of 16 bytes at an offset: lower case, the first longest run of two or
    more zero groups as ``::``, mapped IPv4 addresses dotted."""
    return F.when(F.length(b) >= _col(at) + 16, ipv6_text(raw(b, at, 16)))


def ipv6_text(address: Column) -> Column:
    def text(digits: Column) -> Column:
        groups = F.regexp_replace(F.regexp_replace(digits, "(....)(?!$)", "$1:"), "(^|:)0{1,3}(?=[0-9a-f])", "$1")
        mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", *[F.conv(F.substring(digits, at, 2), 16, 10) for at in (25, 27, 29, 31)]))
        return F.when(digits.startswith("0" * 20 + "ffff"), mapped).otherwise(let(groups, shortened))

    def shortened(groups: Column) -> Column:
        out = groups
        for run in range(2, 9):  # the longest is tried first: it is the outermost case
            zeros = f"0(?::0){{{run - 1}}}"
            pattern = f"^((?:[0-9a-f]+:)*?){zeros}(?![0-9a-f]):?(.*)$"
            before, after = F.regexp_extract(groups, pattern, 1), F.regexp_extract(groups, pattern, 2)
            # a look for the digits first: a pattern is far more work
            there = groups.contains("0" + ":0" * (run - 1)) & groups.rlike(pattern)
            out = F.when(there, F.concat(F.when(before == "", "::").otherwise(F.concat(before, F.lit(":"))), after)).otherwise(out)
        return out

    # both are read many times, so each is worked out once
    return let(F.lower(F.hex(address)), text)
