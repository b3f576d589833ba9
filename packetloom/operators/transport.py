"""Layers above IP: TCP with options, UDP, ICMP, ICMPv6, IGMP, GRE, AH, ESP.

Decoders take a BINARY column, the offset at which the header starts and the end of what
belongs to the packet; nothing is read beyond the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.bytes import bits, flag, ipv4, raw, u8, u16, u32, word

TCP, UDP, ICMP, ICMPV6, IGMP, GRE, AH, ESP = 6, 17, 1, 58, 2, 47, 51, 50
_LEAST = {ICMP: 8, ICMPV6: 8, IGMP: 8, GRE: 4, AH: 12, ESP: 8}


def tcp_error(b: Column, at: Column, end: Column) -> Column:
    return _tcp_error(end - at, bits(u8(b, at + 12), 4, 4))


def _tcp_error(left: Column, words: Column) -> Column:
    return F.when(left < 20, "InvalidLength").when(words < 5, "InvalidHeader").when(left < words * 4, "InvalidLength")


def udp_error(b: Column, at: Column, end: Column) -> Column:
    return _udp_error(end - at, u16(b, at + 4))


def _udp_error(left: Column, length: Column) -> Column:
    return F.when(left < 8, "InvalidLength").when(length < 8, "InvalidHeader").when(length > left, "InvalidLength")


def words_error(protocol: Column, left: Column, head: Column, middle: Column) -> Column:
    """What is wrong with a layer of which so many bytes are left; head and middle: the first
    two words of TCP, the first of UDP."""
    out = F.when(protocol == TCP, _tcp_error(left, bits(middle, 28, 4))).when(protocol == UDP, _udp_error(left, bits(head, 16, 16)))
    for number, least in _LEAST.items():
        out = out.when((protocol == number) & (left < least), "InvalidLength")
    return out


def tcp(b: Column, at: Column) -> Column:
    return tcp_of_words(b, at, word(b, at), word(b, at + 8), u32(b, at + 16))


def tcp_of_words(b: Column, at: Column, head: Column, middle: Column, last: Column) -> Column:
    """The header from its first 8, next 8 and next 4 bytes."""
    part = lambda w, shift, width: bits(w, shift, width).cast("int")
    words = part(middle, 28, 4)
    names = ("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr", "ns")
    flags = F.struct(*[flag(middle, 16 + i).alias(n) for i, n in enumerate(names)])
    return F.struct(
        part(head, 48, 16).alias("source_port"), part(head, 32, 16).alias("destination_port"), bits(head, 0, 32).alias("sequence_number"), bits(middle, 32, 32).alias("acknowledgment_number"),
        words.alias("data_offset"), flags.alias("flags"), part(middle, 0, 16).alias("window_size"), part(last, 16, 16).alias("checksum"), part(last, 0, 16).alias("urgent_pointer"),
        F.when(words > 5, raw(b, at + 20, words * 4 - 20)).alias("options"),
    )


def _option_pattern() -> str:
    """A whole option in hex digits: padding, or kind, length and so many bytes as it says."""
    sized = "|".join(f"{n:02X}.{{{2 * n - 4}}}" for n in range(2, 41))
    return f"01|(?!0[01])..(?:{sized})"


def _option(kind: int, least: int, rest: str) -> str:
    """The last option of a kind before the end or a broken one, of ``least`` bytes at least."""
    short = "|".join(f"{n:02X}" for n in range(2, least))
    return f"^(?:{_option_pattern()})*(?={_option_pattern()}){kind:02X}" + (f"(?!{short})" if short else "") + f"..{rest}"


def tcp_options(options: Column) -> Column:
    """(mss, window_scale, sack_permitted, ts_val, ts_ecr) of a TCP header's option bytes; NULL
    bytes give the empty struct. A broken option ends the walk."""
    digits = F.hex(options)

    def number(pattern: str, kind: str) -> Column:
        return F.conv(F.nullif(F.regexp_extract(digits, pattern, 1), F.lit("")), 16, 10).cast(kind)

    return F.struct(
        number(_option(2, 4, "(.{4})"), "int").alias("mss"), number(_option(3, 3, "(..)"), "int").alias("window_scale"), F.coalesce(digits.rlike(_option(4, 2, "")), F.lit(False)).alias("sack_permitted"),
        number(_option(8, 10, "(.{8}).{8}"), "bigint").alias("ts_val"), number(_option(8, 10, ".{8}(.{8})"), "bigint").alias("ts_ecr"),
    )


def udp(b: Column, at: Column) -> Column:
    return udp_of_word(word(b, at))


def udp_of_word(head: Column) -> Column:
    names = ("source_port", "destination_port", "length", "checksum")
    return F.struct(*[bits(head, 48 - 16 * i, 16).cast("int").alias(n) for i, n in enumerate(names)])


def icmp(b: Column, at: Column) -> Column:
    """Of ICMP and ICMPv6 alike."""
    return F.struct(u8(b, at).alias("icmp_type"), u8(b, at + 1).alias("icmp_code"), u16(b, at + 2).alias("checksum"))


def igmp(b: Column, at: Column) -> Column:
    return F.struct(u8(b, at).alias("msg_type"), ipv4(b, at + 4).alias("group_address"))


def gre(b: Column, at: Column) -> Column:
    return F.struct(u16(b, at + 2).alias("protocol_type"))


def ah(b: Column, at: Column) -> Column:
    return F.struct(u8(b, at).alias("next_header"), u8(b, at + 1).alias("payload_len"), u32(b, at + 4).alias("spi"), u32(b, at + 8).alias("sequence"))


def esp(b: Column, at: Column) -> Column:
    return F.struct(u32(b, at).alias("spi"), u32(b, at + 4).alias("sequence"))
