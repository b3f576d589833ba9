"""Frames from columns: native expressions that encode headers, for tests and queries.

The counterpart of the decoders, written from the formats and not from them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def num(value: Column | int, size: int) -> Column:
    """Big-endian bytes of a non-negative number."""
    return F.unhex(F.lpad(F.hex(_col(value).cast("bigint")), 2 * size, "0"))


def hexed(text: str) -> Column:
    return F.lit(bytearray.fromhex(text))


def join(*parts: Column) -> Column:
    return F.concat(*parts)


def zeros(size: Column | int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), _col(size).cast("int")))


def quad(value: Column) -> Column:
    """10.x.y.z from the low 24 bits of a number, as text."""
    v = value.cast("bigint")
    return F.concat_ws(".", F.lit("10"), *[F.shiftright(v, s).bitwiseAND(255).cast("string") for s in (16, 8, 0)])


def address(value: Column) -> Column:
    return F.concat(hexed("0a"), num(value.cast("bigint").bitwiseAND(0xFFFFFF), 3))


def ethernet(ethertype: Column | int, payload: Column, tags: list[tuple[int, Column]] | None = None) -> Column:
    """tags: (ethertype, tci) from the outside in."""
    head = F.concat(hexed("020000000001"), hexed("020000000002"))
    for kind, tci in tags or []:
        head = F.concat(head, num(kind, 2), num(tci, 2))
    return F.concat(head, num(ethertype, 2), payload)


def ipv4(protocol: Column | int, source: Column, destination: Column, payload: Column, *, ttl: Column | int = 64, fragment: Column | int = 0, total: Column | None = None, identification: Column | int = 1) -> Column:
    """source, destination: numbers whose low 24 bits make 10.x.y.z."""
    total = F.length(payload) + 20 if total is None else total
    return F.concat(hexed("4500"), num(total, 2), num(identification, 2), num(fragment, 2), num(ttl, 1), num(protocol, 1), hexed("0000"), address(source), address(destination), payload)


def ipv6(next_header: Column | int, payload: Column, *, flow: Column | int = 0, hops: Column | int = 64, source: Column | None = None, destination: Column | None = None) -> Column:
    one = hexed("fe800000000000000000000000000001")
    return F.concat(num(F.lit(6 << 28).cast("bigint") + _col(flow), 4), num(F.length(payload), 2), num(next_header, 1), num(hops, 1), one if source is None else source, one if destination is None else destination, payload)


def tcp(source: Column, destination: Column, flags: Column | int, *, sequence: Column | int = 0, acknowledgment: Column | int = 0, window: Column | int = 1024, options: Column | None = None, payload: Column | None = None) -> Column:
    """options: bytes, a multiple of 4."""
    options = hexed("") if options is None else options
    words = (F.length(options) / 4 + 5).cast("int")
    parts = [num(source, 2), num(destination, 2), num(sequence, 4), num(acknowledgment, 4), num(words * 16, 1), num(flags, 1), num(window, 2), hexed("00000000"), options]
    return F.concat(*parts, *([payload] if payload is not None else []))


def udp(source: Column | int, destination: Column | int, payload: Column) -> Column:
    return F.concat(num(source, 2), num(destination, 2), num(F.length(payload) + 8, 2), hexed("0000"), payload)


def label(text: Column) -> Column:
    raw = F.encode(text, "UTF-8")
    return F.concat(num(F.length(raw), 1), raw)


def dns_query(identifier: Column, labels: list[Column], qtype: Column | int = 1) -> Column:
    return F.concat(num(identifier, 2), hexed("01000001000000000000"), *[label(x) for x in labels], hexed("00"), num(qtype, 2), hexed("0001"))


def extension(next_header: Column | int, words: int = 0) -> Column:
    """An IPv6 options header of 8 * (words + 1) bytes."""
    return F.concat(num(next_header, 1), num(words, 1), zeros(8 * (words + 1) - 2))


def mpls(entries: list[tuple[Column, int, int]]) -> Column:
    """(label, bottom, ttl)"""
    return F.concat(*[num(F.shiftleft(x.cast("bigint"), 12) + (bottom << 8) + ttl, 4) for x, bottom, ttl in entries])


def with_checksum(message: Column, at: int) -> Column:
    """The message with its one's complement checksum in the two bytes (zero so far) at ``at``.
    It should be a column of its own, as it is read several times."""
    from packetloom.functions.checksum import checksum

    return F.concat(F.substring(message, F.lit(1), F.lit(at)), num(checksum(message), 2), F.substring(message, F.lit(at + 3), F.length(message)))
