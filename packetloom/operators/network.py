"""Network layer: IPv4 and IPv6 headers, IPv6 extension headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.bytes import At, _col, bits, ipv4_of, ipv6, raw, u8, u16, u32, word


def ipv4_error(b: Column, at: At) -> Column:
    """Of the header itself; lengths against the capture are judged by the caller."""
    return _ipv4_error(F.length(b) - _col(at), u8(b, at))


def _ipv4_error(left: Column, first: Column) -> Column:
    return (
        F.when(left < 20, "InvalidLength")
        .when((bits(first, 4, 4) != 4) | (bits(first, 0, 4) < 5), "InvalidHeader")
        .when(left < bits(first, 0, 4) * 4, "InvalidLength")
    )


def ipv4_words_error(left: Column, head: Column) -> Column:
    """``ipv4_error`` from the header's first word."""
    return _ipv4_error(left, bits(head, 56, 8))


def ipv4_header(b: Column, at: At) -> Column:
    at = _col(at)
    return ipv4_of_words(b, at, word(b, at), word(b, at + 8), u32(b, at + 16))


def ipv4_of_words(b: Column, at: Column, head: Column, middle: Column, last: Column) -> Column:
    """The header from its first 8, next 8 and next 4 bytes."""
    part = lambda w, shift, width: bits(w, shift, width).cast("int")
    ihl = part(head, 56, 4)
    return F.struct(
        part(head, 60, 4).alias("version"), ihl.alias("ihl"), part(head, 50, 6).alias("dscp"), part(head, 48, 2).alias("ecn"),
        part(head, 32, 16).alias("total_length"), part(head, 16, 16).alias("identification"), part(head, 13, 3).alias("flags"), part(head, 0, 13).alias("fragment_offset"),
        part(middle, 56, 8).alias("ttl"), part(middle, 48, 8).alias("protocol"), part(middle, 32, 16).alias("checksum"), ipv4_of(middle).alias("source"), ipv4_of(last).alias("destination"),
        F.when(ihl > 5, raw(b, at + 20, ihl * 4 - 20)).alias("options"),
    )


def ipv6_error(b: Column, at: At) -> Column:
    at = _col(at)
    return F.when(F.length(b) - at < 40, "InvalidLength").when(bits(u8(b, at), 4, 4) != 6, "InvalidHeader")


def ipv6_header(b: Column, at: At) -> Column:
    return ipv6_of_words(b, _col(at), word(b, at))


def ipv6_of_words(b: Column, at: Column, head: Column) -> Column:
    part = lambda shift, width: bits(head, shift, width).cast("int")
    return F.struct(
        part(60, 4).alias("version"), part(52, 8).alias("traffic_class"), bits(head, 32, 20).alias("flow_label"),
        part(16, 16).alias("payload_length"), part(8, 8).alias("next_header"), part(0, 8).alias("hop_limit"), ipv6(b, at + 8).alias("source"), ipv6(b, at + 24).alias("destination"),
    )


def extension_walk(b: Column, at: At, limit: int) -> Column:
    """(next_header, offset, non_initial, limited, error, done) behind the extension headers of
    the IPv6 packet at ``at``, which ends where its payload length says. offset counts from
    ``at``. The limit is tested before the next header is looked at."""
    at = _col(at)
    end = u16(b, at + 4) + 40

    def state(next_header, offset, non_initial=F.lit(False), limited=F.lit(False), error=F.lit(None).cast("string"), done=F.lit(False)) -> Column:
        return F.struct(next_header.alias("next_header"), offset.alias("offset"), non_initial.alias("non_initial"), limited.alias("limited"), error.alias("error"), done.alias("done"))

    def step(s: Column, i: Column) -> Column:
        kind, offset = s["next_header"], s["offset"]
        no = F.lit(False)
        stop = state(kind, offset, done=F.lit(True))
        bad = state(kind, offset, error=F.lit("InvalidLength"), done=F.lit(True))
        following, size = u8(b, at + offset), u8(b, at + offset + 1)
        size = F.when(kind == 44, 8).when(kind == 51, (size + 2) * 4).otherwise((size + 1) * 8)
        least = F.when(kind == 44, 8).otherwise(2)
        later = F.when(kind == 44, bits(u16(b, at + offset + 2), 3, 13) != 0).otherwise(no)
        moved = state(following, offset + size, non_initial=later, done=later)
        return (
            F.when(s["done"], s)
            .when(i > limit, state(kind, offset, limited=F.lit(True), done=F.lit(True)))
            .when(~kind.isin(0, 43, 44, 51, 60), stop)
            .when(offset + least > end, bad)
            .when(offset + size > end, bad)
            .otherwise(moved)
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(limit + 1)), state(u8(b, at + 6), F.lit(40)), step)
