"""Stand-alone layers over a BINARY message: acceptance tests, validity, and full parses.

``can_parse_*`` and ``is_valid_*`` are predicates. A parse gives a struct of ``value`` and
``error`` (kind, proto_id), of which one is NULL. Unlike the frame decoder these verify
checksums, and IGMP is parsed in full.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.bytes import bits, ipv4, raw, u8, u16
from packetloom.functions.checksum import checksum, folded, icmpv6_checksum, word_sum
from packetloom.operators import link, network, transport
from packetloom.operators.dns import dns_parsed

def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)



def _n(b: Column) -> Column:
    return F.length(b)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _sound(b: Column) -> Column:
    return checksum(b) == 0


can_parse_any = lambda b: _sure(_n(b) > 0)
is_valid_any = can_parse_any


def can_parse_arp(b: Column) -> Column:
    return _sure((_n(b) >= 28) & (u16(b, 0) == 1) & (u16(b, 2) == 0x0800))


def is_valid_arp(b: Column) -> Column:
    return _sure((_n(b) >= 28) & (u8(b, 4) == 6) & (u8(b, 5) == 4))


def can_parse_ipv4(b: Column) -> Column:
    return _sure((_n(b) >= 20) & (bits(u8(b, 0), 4, 4) == 4))


def is_valid_ipv4(b: Column) -> Column:
    """The sum covers the first 20 bytes whatever the header's length."""
    return _sure((_n(b) >= 20) & (bits(u8(b, 0), 0, 4) >= 5) & (u16(b, 2) <= _n(b)) & (folded(word_sum(raw(b, 0, 20))) == 0xFFFF))


def can_parse_ipv6(b: Column) -> Column:
    return _sure((_n(b) >= 40) & (bits(u8(b, 0), 4, 4) == 6))


def is_valid_ipv6(b: Column) -> Column:
    return _sure((_n(b) >= 40) & (u16(b, 4) + 40 <= _n(b)) & (bits(u8(b, 0), 4, 4) == 6))


def can_parse_icmp(b: Column) -> Column:
    return _sure((_n(b) >= 8) & (u8(b, 0) <= 18))


def is_valid_icmp(b: Column) -> Column:
    return _sure((_n(b) >= 8) & _sound(b))


def can_parse_icmpv6(b: Column) -> Column:
    return _sure((_n(b) >= 8) & (u8(b, 0) <= 137))


def is_valid_icmpv6(b: Column) -> Column:
    return _sure((_n(b) >= 8) & (u8(b, 0).between(1, 4) | u8(b, 0).between(128, 129) | u8(b, 0).between(133, 137)))


def can_parse_igmp(b: Column) -> Column:
    return _sure((_n(b) >= 8) & u8(b, 0).isin(0x11, 0x12, 0x16, 0x17, 0x22))


def is_valid_igmp(b: Column) -> Column:
    return _sure((_n(b) >= 8) & _sound(b))


def can_parse_tcp(b: Column) -> Column:
    words = bits(u8(b, 12), 4, 4)
    return _sure((_n(b) >= 20) & (words >= 5) & (_n(b) >= words * 4))


is_valid_tcp = can_parse_tcp


def can_parse_udp(b: Column) -> Column:
    return _sure((_n(b) >= 8) & u16(b, 4).between(8, _n(b)))


is_valid_udp = can_parse_udp


def can_parse_dns(b: Column) -> Column:
    return _sure((_n(b) >= 12) & (bits(u8(b, 2), 3, 4) == 0))


def is_valid_dns(b: Column) -> Column:
    records = u16(b, 4) + u16(b, 6) + u16(b, 8) + u16(b, 10)
    return _sure((_n(b) >= 12) & (records > 0) & (_n(b) >= 12 + 12 * records))


def _outcome(value: Column, error: Column, proto_id: Column | None = None) -> Column:
    """value and error; the error is worked out once."""
    number = _none("int") if proto_id is None else proto_id
    return F.get(F.transform(F.array(error), lambda e: F.struct(F.when(e.isNull(), value).alias("value"), F.when(e.isNotNull(), F.struct(e.alias("kind"), F.when(e == "UnsupportedProtocol", number).alias("proto_id"))).alias("error"))), F.lit(0))


def parse_arp(b: Column) -> Column:
    return _outcome(link.arp(b, 0), link.arp_error(b, 0))


def parse_ipv4(b: Column) -> Column:
    """A total length under the header's is let pass; one over what is there is not."""
    error = F.coalesce(network.ipv4_error(b, 0), F.when(u16(b, 2) > _n(b), "InvalidLength"))
    return _outcome(network.ipv4_header(b, 0), error)


def parse_ipv6(b: Column) -> Column:
    return _outcome(network.ipv6_header(b, 0), F.when((_n(b) < 40) | (bits(u8(b, 0), 4, 4) != 6), "InvalidHeader"))


def parse_icmp(b: Column) -> Column:
    return _outcome(transport.icmp(b, F.lit(0)), F.when(_n(b) < 8, "InvalidLength").when(~_sound(b), "InvalidHeader"))


def parse_icmpv6(b: Column, source: Column, destination: Column) -> Column:
    """source, destination: addresses of 16 bytes."""
    return _outcome(transport.icmp(b, F.lit(0)), F.when(_n(b) < 8, "InvalidLength").when(icmpv6_checksum(source, destination, b) != 0, "InvalidHeader"))


def parse_tcp(b: Column) -> Column:
    return _outcome(transport.tcp(b, F.lit(0)), transport.tcp_error(b, F.lit(0), _n(b)))


def parse_udp(b: Column) -> Column:
    return _outcome(transport.udp(b, F.lit(0)), transport.udp_error(b, F.lit(0), _n(b)))


def parse_dns(b: Column) -> Column:
    out = dns_parsed(b)
    return F.struct(out["message"].alias("value"), F.when(out["error"].isNotNull(), F.struct(out["error"].alias("kind"), _none("int").alias("proto_id"))).alias("error"))


def _addresses(b: Column, at: Column, count: Column) -> Column:
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: ipv4(b, at + i * 4))).otherwise(F.array().cast("array<string>"))


_RECORDS = "array<struct<record_type: int, aux_data_len: int, num_sources: int, multicast_address: string, source_addresses: array<string>, aux_data: binary>>"


def _group_records(b: Column) -> Column:
    """(at, records, bad) of a version 3 report."""
    count = u16(b, 6)
    first = F.struct(F.lit(8).alias("at"), F.array().cast(_RECORDS).alias("records"), F.lit(False).alias("bad"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        sources, aux = u16(b, at + 2), u8(b, at + 1)
        size = sources * 4 + aux * 4 + 8
        fits = _sure((at + 8 <= _n(b)) & (at + size <= _n(b)))
        record = F.struct(u8(b, at).alias("record_type"), aux.alias("aux_data_len"), sources.alias("num_sources"), ipv4(b, at + 4).alias("multicast_address"), _addresses(b, at + 8, sources).alias("source_addresses"), raw(b, at + 8 + sources * 4, aux * 4).alias("aux_data"))
        moved = F.struct((at + size).alias("at"), F.concat(s["records"], F.array(record)).alias("records"), F.lit(False).alias("bad"))
        stuck = F.struct(at.alias("at"), s["records"].alias("records"), F.lit(True).alias("bad"))
        return F.when(s["bad"], s).when(fits, moved).otherwise(stuck)

    # a record takes 8 bytes at least: one more than fit is sure to fail
    most = F.least(count, F.floor(_n(b) / 8).cast("int"))
    return F.when(count > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), first, step)).otherwise(first)


def parse_igmp(b: Column) -> Column:
    """value: kind (query, query-v3, report-v1, report-v2, leave-group, report-v3), typ,
    max_resp, checksum, group_address, s_flag, qrv, qqic, num_sources, source_addresses,
    reserved, num_group_records, group_records; what a kind lacks is NULL.

    A version 3 query is read with the S flag at byte 9, QQIC at 10, the number of sources at
    11 and sources from 13 on.
    """
    typ, size = u8(b, 0), _n(b)
    query, v3 = typ == 0x11, (typ == 0x11) & (size != 8)
    kind = F.when(v3, "query-v3").when(query, "query").when(typ == 0x12, "report-v1").when(typ == 0x16, "report-v2").when(typ == 0x17, "leave-group").when(typ == 0x22, "report-v3")
    sources = u16(b, 11)

    def built(walk: Column) -> Column:
        error = (
            F.when(size < 8, "InvalidLength")
            .when(kind.isNull(), "UnsupportedProtocol")
            .when(v3 & (size < 13), "InvalidLength")
            .when(v3 & (size < sources * 4 + 13), "InvalidLength")
            .when(walk["bad"], "InvalidLength")
            .when(~_sound(b), "InvalidHeader")
        )
        report = kind == "report-v3"
        value = F.struct(
            kind.alias("kind"), typ.alias("typ"), F.when(query, u8(b, 1)).alias("max_resp"), u16(b, 2).alias("checksum"), F.when(~report, ipv4(b, 4)).alias("group_address"),
            F.when(v3, bits(u8(b, 9), 7, 1) == 1).alias("s_flag"), F.when(v3, bits(u8(b, 9), 0, 3)).alias("qrv"), F.when(v3, u8(b, 10)).alias("qqic"),
            F.when(v3, sources).alias("num_sources"), F.when(v3, _addresses(b, F.lit(13), sources)).alias("source_addresses"),
            F.when(report, u8(b, 1)).alias("reserved"), F.when(report, u16(b, 6)).alias("num_group_records"), walk["records"].alias("group_records"),
        )
        return _outcome(value, error, typ)

    return F.get(F.transform(F.array(F.when((typ == 0x22) & (size >= 8), _group_records(b))), built), F.lit(0))


def parse_openvpn(b: Column) -> Column:
    return _outcome(F.struct(u8(b, 0).alias("flags"), u8(b, 1).alias("version")), F.when(_n(b) < 2, "InvalidLength"))


def parse_wireguard(b: Column) -> Column:
    """A handshake initiation: a little-endian type of 1 and 16 bytes. proto_id of other types is
    255 at most."""
    kind = u8(b, 0) + u8(b, 1) * 256 + (u8(b, 2) * 65_536 + u8(b, 3).cast("bigint") * 16_777_216)
    error = F.when(_n(b) < 4, "InvalidLength").when(kind != 1, "UnsupportedProtocol").when(_n(b) < 16, "InvalidLength")
    return _outcome(F.struct(kind.alias("message_type")), error, F.least(kind, F.lit(255)).cast("int"))


def identify_network(b: Column) -> Column:
    """(protocol, error): ipv4 or ipv6 by the first half byte."""
    version = bits(u8(b, 0), 4, 4)
    name = F.when(version == 4, "ipv4").when(version == 6, "ipv6")
    return _outcome(name, F.when(_n(b) == 0, "InvalidLength").when(name.isNull(), "UnsupportedProtocol"), version)


def capture_kind(b: Column) -> Column:
    """(format, network_offset) by the older test: cooked capture version 1, then Ethernet, of
    IPv4, IPv6 and ARP only; NULL for anything else and for fewer than 14 bytes."""
    known = (0x0800, 0x86DD, 0x0806)
    sll = u16(b, 0).isin(0, 4) & (u16(b, 4) == 6) & u16(b, 14).isin(*known)
    kind = lambda name, at: F.struct(F.lit(name).alias("format"), F.lit(at).alias("network_offset"))
    return F.when(_n(b) < 14, None).when(_sure(sll), kind("linux-cooked-v1", 16)).when(u16(b, 12).isin(*known), kind("ethernet-ii", 14))


def transport_by_shape(b: Column) -> Column:
    """tcp or udp, whichever header fits, TCP first and whatever the IP protocol says."""
    tcp, udp = parse_tcp(b)["value"], parse_udp(b)["value"]
    return F.when(can_parse_tcp(b), F.struct(F.lit("tcp").alias("kind"), tcp.alias("tcp"), F.when(F.lit(False), udp).alias("udp"))).when(can_parse_udp(b), F.struct(F.lit("udp").alias("kind"), F.when(F.lit(False), tcp).alias("tcp"), udp.alias("udp")))


def hexdump(b: Column) -> Column:
    """Lines of 16 bytes: offset (4 digits at least), hex, and printable ASCII; each ends in a
    line feed."""

    def line(at: Column) -> Column:
        part = raw(b, at, 16)
        digits = F.rpad(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 "), 48, " ")
        text = F.regexp_replace(F.decode(part, "ISO-8859-1"), "[^ -~]", ".")
        offset = F.lower(F.hex(at))
        return F.concat(F.lpad(offset, F.greatest(F.length(offset), F.lit(4)), "0"), F.lit("   "), digits, F.lit("  "), text, F.lit("\n"))

    starts = F.filter(F.sequence(F.lit(0), F.greatest(_n(b) - 1, F.lit(0)), F.lit(16)), lambda i: i < _n(b))
    return F.array_join(F.transform(starts, line), "")


__all__ = [n for n in dir() if n.startswith(("can_parse", "is_valid", "parse_")) or n in ("identify_network", "capture_kind", "transport_by_shape", "hexdump")]
