"""What UDP carries: probes by port and shape, and tunnels' headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.bytes import bits, raw, u8, u16, u24
from packetloom.functions.names import WIREGUARD


def port_is(udp: Column, *ports: int) -> Column:
    return udp["source_port"].isin(*ports) | udp["destination_port"].isin(*ports)


def likely_dns(m: Column) -> Column:
    return (F.length(m) >= 12) & (bits(u8(m, 2), 3, 4) <= 5) & (raw(m, 4, 8) != F.lit(bytearray(8)))


def likely_dhcp(m: Column) -> Column:
    return (F.length(m) >= 240) & u8(m, 0).isin(1, 2) & (F.hex(raw(m, 236, 4)) == "63825363")


def likely_ntp(m: Column) -> Column:
    return (F.length(m) >= 48) & bits(u8(m, 0), 3, 3).between(1, 4) & bits(u8(m, 0), 0, 3).between(1, 7)


def wireguard_type(m: Column) -> Column:
    """Name of the message type, or NULL for an unknown type or too few bytes."""
    out = F.lit(None).cast("string")
    for number, (name, least) in WIREGUARD.items():
        out = F.when((u8(m, 0) == number) & (F.length(m) >= least), name).otherwise(out)
    return out


def vxlan(m: Column) -> Column:
    return F.when(F.length(m) >= 8, F.struct(u24(m, 4).alias("vni")))


def geneve(m: Column) -> Column:
    return F.when(F.length(m) >= 8, F.struct(bits(u8(m, 0), 6, 2).alias("version"), u16(m, 2).alias("protocol_type"), u24(m, 4).alias("vni")))


def hints(udp: Column, m: Column) -> Column:
    """Names of the applications that a datagram looks like, in the order of the probes."""
    found = [
        F.when(port_is(udp, 53) & likely_dns(m), "dns"),
        F.when(port_is(udp, 5353) & likely_dns(m), "mdns"),
        F.when(port_is(udp, 67, 68) & likely_dhcp(m), "dhcp"),
        F.when(port_is(udp, 123) & likely_ntp(m), "ntp"),
        F.when(port_is(udp, 51820, 51821) & wireguard_type(m).isNotNull(), "wireguard"),
    ]
    return F.coalesce(F.array_compact(F.array(*found)), F.array().cast("array<string>"))
