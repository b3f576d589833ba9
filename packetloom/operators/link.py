"""Link layer: frames' classes, Ethernet with VLAN tags, cooked captures, ARP, PPPoE, MPLS.

Each decoder takes a BINARY column and the offset it starts at, and gives a struct of its
fields. What a decoder cannot read is told by its ``*_error`` function: NULL, or the kind
of the first check that fails.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.bytes import At, _col, bits, flag, ipv4, raw, u8, u16, u32
from packetloom.functions.names import arp_operation

VLAN = (0x8100, 0x88A8)
#: Ethertypes that settle that a frame is Ethernet; PPPoE is not among them.
COMMON = (0x0800, 0x0806, 0x86DD, 0x8100, 0x88A8, 0x8847, 0x8848)


def is_common_ethertype(value: Column) -> Column:
    return F.coalesce(value.isin(*COMMON), F.lit(False))


def looks_like_sll(b: Column) -> Column:
    return (F.length(b) >= 16) & (u16(b, 0) <= 4) & (u16(b, 4) == 6)


def looks_like_sll2(b: Column) -> Column:
    return (F.length(b) >= 20) & u16(b, 0).isin(0x0800, 0x0806, 0x86DD)


def link_kind(b: Column, ethertype: Column | None = None) -> Column:
    """ethernet, sll or sll2; the order of the tests matters. ethertype: of byte 12, if read."""
    ethertype = u16(b, 12) if ethertype is None else ethertype
    return F.when(is_common_ethertype(ethertype), "ethernet").when(looks_like_sll(b), "sll").when(looks_like_sll2(b), "sll2").otherwise("ethernet")


def vlan_walk(b: Column) -> Column:
    """(ethertype, offset, tags, short) behind the VLAN tags of an Ethernet frame that has any."""
    first = F.struct(u16(b, 12).alias("ethertype"), F.lit(14).alias("offset"), F.array().cast("array<int>").alias("tags"), F.lit(False).alias("short"))

    def step(s: Column, _: Column) -> Column:
        more = s["ethertype"].isin(*VLAN) & ~s["short"]
        fits = F.length(b) >= s["offset"] + 4
        tagged = F.struct(u16(b, s["offset"] + 2).alias("ethertype"), (s["offset"] + 4).alias("offset"), F.concat(s["tags"], F.array(u16(b, s["offset"]))).alias("tags"), F.lit(False).alias("short"))
        stuck = F.struct(s["ethertype"].alias("ethertype"), s["offset"].alias("offset"), s["tags"].alias("tags"), F.lit(True).alias("short"))
        return F.when(~more, s).when(fits, tagged).otherwise(stuck)

    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(b) - 14) / 4).cast("int")))
    return F.aggregate(steps, first, step)


def cooked(kind: Column, ethernet: Column, sll: Column, sll2: Column) -> Column:
    """A value by the kind of link."""
    return F.when(kind == "sll", sll).when(kind == "sll2", sll2).otherwise(ethernet)


def arp_error(b: Column, at: At) -> Column:
    at = _col(at)
    return F.when(F.length(b) - at < 28, "InvalidLength").when((u8(b, at + 4) != 6) | (u8(b, at + 5) != 4), "InvalidHeader")


def arp(b: Column, at: At) -> Column:
    at = _col(at)
    return F.struct(
        u16(b, at).alias("hardware_type"), u16(b, at + 2).alias("protocol_type"), u8(b, at + 4).alias("hardware_len"), u8(b, at + 5).alias("protocol_len"),
        arp_operation(u16(b, at + 6)).alias("operation"), u16(b, at + 6).alias("operation_code"),
        raw(b, at + 8, 6).alias("sender_hardware_addr"), ipv4(b, at + 14).alias("sender_protocol_addr"),
        raw(b, at + 18, 6).alias("target_hardware_addr"), ipv4(b, at + 24).alias("target_protocol_addr"),
    )


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value), digits, "0")


def arp_bytes(p: Column) -> Column:
    """The 28 bytes of an ARP struct."""
    quad = lambda text: F.concat(*[_hex(F.get(F.split(text, r"\."), F.lit(i)).cast("bigint"), 2) for i in range(4)])
    return F.unhex(F.concat(
        _hex(p["hardware_type"], 4), _hex(p["protocol_type"], 4), _hex(p["hardware_len"], 2), _hex(p["protocol_len"], 2), _hex(p["operation_code"], 4),
        F.hex(p["sender_hardware_addr"]), quad(p["sender_protocol_addr"]), F.hex(p["target_hardware_addr"]), quad(p["target_protocol_addr"]),
    ))


def pppoe_error(b: Column, at: At) -> Column:
    return F.when(F.length(b) - _col(at) < 6, "InvalidLength")


def pppoe(b: Column, at: At) -> Column:
    at = _col(at)
    return F.struct(u8(b, at + 1).alias("code"), u16(b, at + 2).alias("session_id"), u16(b, at + 4).alias("length"))


def mpls_error(b: Column, at: At) -> Column:
    return F.when(F.length(b) - _col(at) < 4, "InvalidLength")


def mpls_walk(b: Column, at: At, limit: int) -> Column:
    """(labels, end, done, limited): end counts from ``at``; limited: more labels
    follow the last that the limit allows."""
    at, limit = _col(at), max(1, limit)
    empty = F.array().cast("array<struct<label: bigint, exp: int, bottom_of_stack: boolean, ttl: int>>")
    first = F.struct(empty.alias("labels"), F.lit(0).alias("end"), F.lit(False).alias("done"), F.lit(False).alias("limited"))

    def step(s: Column, i: Column) -> Column:
        word = u32(b, at + s["end"])
        entry = F.struct(bits(word, 12, 20).alias("label"), bits(word, 9, 3).cast("int").alias("exp"), flag(word, 8).alias("bottom_of_stack"), bits(word, 0, 8).cast("int").alias("ttl"))
        bottom = flag(word, 8)
        read = F.struct(F.concat(s["labels"], F.array(entry)).alias("labels"), (s["end"] + 4).alias("end"), bottom.alias("done"), (~bottom & (i == limit) & (F.length(b) - at - s["end"] >= 8)).alias("limited"))
        return F.when(s["done"] | word.isNull(), s).otherwise(read)

    return F.aggregate(F.sequence(F.lit(1), F.lit(limit)), first, step)
