"""Processors by name, and the older walk through a frame's layers.

A protocol processor tests and parses one message. A layer processor gives (payload, error):
what the next layer reads, or the kind of error that leaves it as it was. ``parse_layers``
runs the layers of a frame in order; errors of a layer do not stop it, only a capture format
that it does not know does. Differences from the frame decoder are the walk's own: IPv4 is
first looked for at the frame's very start, TCP is told by its shape, and DNS is looked for
in the whole frame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.bytes import let, raw, u16
from packetloom.operators import validated as V


@dataclass(frozen=True)
class ProtocolProcessor:
    """parse: a struct of value and error; the tests are predicates."""

    name: str
    parse: Callable[..., Column]
    can_parse: Callable[[Column], Column] = V.can_parse_any
    is_valid: Callable[[Column], Column] = V.is_valid_any


@dataclass(frozen=True)
class LayerProcessor:
    """process: bytes -> a struct of payload and error."""

    name: str
    process: Callable[[Column], Column]


PROTOCOLS = {
    p.name: p
    for p in (
        ProtocolProcessor("arp", V.parse_arp, V.can_parse_arp, V.is_valid_arp),
        ProtocolProcessor("ipv4", V.parse_ipv4, V.can_parse_ipv4, V.is_valid_ipv4),
        ProtocolProcessor("ipv6", V.parse_ipv6, V.can_parse_ipv6, V.is_valid_ipv6),
        ProtocolProcessor("icmp", V.parse_icmp, V.can_parse_icmp, V.is_valid_icmp),
        ProtocolProcessor("icmpv6", V.parse_icmpv6, V.can_parse_icmpv6, V.is_valid_icmpv6),
        ProtocolProcessor("igmp", V.parse_igmp, V.can_parse_igmp, V.is_valid_igmp),
        ProtocolProcessor("tcp", V.parse_tcp, V.can_parse_tcp, V.is_valid_tcp),
        ProtocolProcessor("udp", V.parse_udp, V.can_parse_udp, V.is_valid_udp),
        ProtocolProcessor("dns", V.parse_dns, V.can_parse_dns, V.is_valid_dns),
        ProtocolProcessor("openvpn", V.parse_openvpn),
        ProtocolProcessor("wireguard", V.parse_wireguard),
    )
}


def _payload(value: Column, error: Column) -> Column:
    return F.struct(value.alias("payload"), error.alias("error"))


def datalink(frame: Column) -> Column:
    """Behind an Ethernet header; an ARP message must be one."""
    rest = raw(frame, 14, F.length(frame))
    arp = F.when(u16(frame, 12) == 0x0806, V.parse_arp(rest)["error"]["kind"])
    return let(arp, lambda e: _payload(F.when(F.length(frame) >= 14, rest), F.when(F.length(frame) < 14, "InvalidLength").otherwise(e)))


def network(packet: Column) -> Column:
    """Behind an IPv4 or IPv6 header, as far as its lengths say; extension headers stay."""

    def cut(x: Column) -> Column:
        v4, v6 = x["v4"], x["v6"]
        ihl, total = v4["value"]["ihl"] * 4, v4["value"]["total_length"]
        size = v6["value"]["payload_length"]
        error = F.coalesce(x["kind"]["error"]["kind"], v4["error"]["kind"], v6["error"]["kind"], F.when(total < ihl, "InvalidLength"), F.when(size + 40 > F.length(packet), "InvalidLength"))
        body = F.when(v4["value"].isNotNull(), raw(packet, ihl, total - ihl)).otherwise(raw(packet, 40, size))
        return let(error, lambda e: _payload(F.when(e.isNull(), body), e))

    kind = V.identify_network(packet)
    return let(kind, lambda k: let(F.struct(k.alias("kind"), F.when(k["value"] == "ipv4", V.parse_ipv4(packet)).alias("v4"), F.when(k["value"] == "ipv6", V.parse_ipv6(packet)).alias("v6")), cut))


def transport(segment: Column) -> Column:
    """TCP or UDP by shape, of which nothing is passed on."""
    return _payload(F.lit(None).cast("binary"), F.when(V.transport_by_shape(segment).isNull(), "UnsupportedProtocol"))


LAYERS = {p.name: p for p in (LayerProcessor("datalink", datalink), LayerProcessor("network", network), LayerProcessor("transport", transport))}


def application(frame: Column, destination_port: Column) -> Column:
    """(kind, dns): dns where the port is 53 and the whole frame reads as a message, else unknown."""
    message = F.when((destination_port == 53) & V.can_parse_dns(frame), V.parse_dns(frame)["value"])
    return let(message, lambda m: F.struct(F.when(m.isNotNull(), "dns").otherwise("unknown").alias("kind"), m.alias("dns")))


def parse_layers(frame: Column) -> Column:
    """(format, network_offset, network_ipv4, transport, application, error) of a frame."""

    def with_network(c: Column) -> Column:
        """What the network layer finds, and what it passes on."""
        rest = raw(frame, c["network_offset"], F.length(frame))
        whole = F.when(V.can_parse_ipv4(frame), V.parse_ipv4(frame)["value"])

        def passed(x: Column) -> Column:
            header = x["header"]
            ihl, total = header["ihl"] * 4, header["total_length"]
            fits = (total >= ihl) & (total <= F.length(rest))
            body = F.when(header.isNotNull(), F.when(fits, raw(rest, ihl, total - ihl)).otherwise(rest)).otherwise(F.coalesce(x["other"]["payload"], rest))
            # an offset beyond the frame leaves what the link layer passed on
            return F.struct(c.alias("capture"), header.alias("header"), F.when(c["network_offset"] < F.length(frame), body).otherwise(raw(frame, 14, F.length(frame))).alias("segment"))

        inside = c["network_offset"] < F.length(frame)
        found = lambda h: F.struct(h.alias("header"), F.when(inside & h.isNull(), network(rest)).alias("other"))
        return let(let(F.when(inside, whole), found), passed)

    def with_transport(x: Column) -> Column:
        return let(V.transport_by_shape(x["segment"]), lambda t: F.struct(
            x["capture"]["format"].alias("format"), x["capture"]["network_offset"].alias("network_offset"), x["header"].alias("network_ipv4"), t.alias("transport"),
            F.when(t.isNotNull(), application(frame, F.coalesce(t["tcp"]["destination_port"], t["udp"]["destination_port"]))).alias("application"), F.lit(None).cast("string").alias("error"),
        ))

    def checked(c: Column) -> Column:
        parsed = let(with_network(c), with_transport)
        names = ("format", "network_offset", "network_ipv4", "transport", "application")
        return let(F.when(c.isNotNull(), parsed), lambda p: F.struct(*[p[n].alias(n) for n in names], F.when(p.isNull(), "MalformedPacket").alias("error")))

    return let(V.capture_kind(frame), checked)
