"""Names of numbers, and of what a decoded packet holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ethertypes by name.
ETHERTYPES = {
    0x0800: "ipv4",
    0x0806: "arp",
    0x8100: "vlan",
    0x86DD: "ipv6",
    0x8847: "mpls-unicast",
    0x8848: "mpls-multicast",
    0x8863: "pppoe-discovery",
    0x8864: "pppoe-session",
    0x88A8: "qinq",
    0x88CC: "lldp",
    0x88F7: "ptp",
}

# IP protocols by name.
IP_PROTOCOLS = {
    1: "icmp",
    2: "igmp",
    6: "tcp",
    17: "udp",
    47: "gre",
    50: "esp",
    51: "ah",
    58: "icmpv6",
    89: "ospf",
    103: "pim",
    112: "vrrp",
    115: "l2tp",
    132: "sctp",
    137: "mpls-in-ip",
}

# Warnings by code, with class, subcode and message.
WARNINGS = {
    "Ipv4Truncated": ("network", "ipv4-truncated", "IPv4 total length exceeds capture; L4 may be truncated"),
    "Ipv4Fragmented": ("network", "ipv4-fragmented", "IPv4 fragment; no reassembly, L4 may be incomplete"),
    "Ipv6ExtensionDepthLimit": ("network", "ipv6-ext-depth-limit", "IPv6 extension header depth limit reached; skipping L4/L7 parse"),
    "Ipv6NonInitialFragment": ("network", "ipv6-non-initial-fragment", "IPv6 non-initial fragment encountered; skipping L4/L7 parse without reassembly"),
    "PppoeNoPayload": ("tunnel", "pppoe-no-payload", "PPPoE header only; payload not decoded"),
    "MplsLabelDepthLimit": ("tunnel", "mpls-label-depth-limit", "MPLS label depth limit reached; skipping inner payload decode"),
    "MplsInner": ("tunnel", "mpls-inner", "MPLS inner payload; no nested decode yet"),
    "UnsupportedEthertype": ("link", "unsupported-ethertype", "L2 only; unsupported ethertype, L3+ not parsed"),
    "GreInner": ("tunnel", "gre-inner", "GRE inner payload; no nested decode yet"),
    "VxlanInner": ("tunnel", "vxlan-inner", "VXLAN inner payload; no nested decode yet"),
    "GeneveInner": ("tunnel", "geneve-inner", "GENEVE inner payload; no nested decode yet"),
    "AhInner": ("tunnel", "ah-inner", "AH payload present; no nested decode yet"),
    "EspInner": ("tunnel", "esp-inner", "ESP payload present; no nested decode yet"),
}

# WireGuard message types with the least bytes of each.
WIREGUARD = {1: ("handshake-initiation", 148), 2: ("handshake-response", 92), 3: ("cookie-reply", 64), 4: ("transport-data", 32)}

# Texts of errors.
ERRORS = {
    "MissingField": "Required field is missing",
    "InvalidLength": "Invalid packet length",
    "InvalidHeader": "Invalid packet header",
    "MalformedPacket": "Malformed packet",
    "UnsupportedProtocol": "Unsupported protocol ID: ",
    "InsufficientData": "Insufficient data in packet",
    "ValidationError": "Validation error: ",
}


def _lookup(value: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value.cast("int")), F.lit("unknown"))


def ethertype_name(value: Column) -> Column:
    return _lookup(value, ETHERTYPES)


def ip_protocol_name(value: Column) -> Column:
    return _lookup(value, IP_PROTOCOLS)


def layer_protocol_name(value: Column) -> Column:
    """TCP or UDP in capitals, else NULL."""
    return F.when(value == 6, "TCP").when(value == 17, "UDP")


def link_protocol_name(ethernet: Column) -> Column:
    return F.when(ethernet.isNotNull(), ethertype_name(ethernet["ethertype"]))


def network_protocol_name(arp: Column, ipv4: Column, ipv6: Column) -> Column:
    return F.when(arp.isNotNull(), "arp").when(ipv4.isNotNull(), "ipv4").when(ipv6.isNotNull(), "ipv6")


def transport_protocol_name(transport: Column) -> Column:
    return transport["kind"]


def warning_subcodes(warnings: Column) -> Column:
    return F.transform(warnings, lambda w: w["subcode"])


TUNNELS = ("gre", "vxlan", "geneve", "mpls", "pppoe", "ah", "esp", "wireguard")


def tunnel_names(**members: Column) -> Column:
    """Names of the tunnels that are there, in the order of TUNNELS."""
    return F.array_compact(F.array(*[F.when(members[t].isNotNull(), t) for t in TUNNELS]))


def arp_operation(code: Column) -> Column:
    return F.when(code == 1, "Request").when(code == 2, "Reply").otherwise(F.concat(F.lit("Unknown("), code.cast("string"), F.lit(")")))


def arp_operation_code(name: Column) -> Column:
    return F.when(name == "Request", 1).when(name == "Reply", 2).otherwise(F.regexp_extract(name, r"Unknown\((\d+)\)", 1).try_cast("int"))


def error_text(error: Column) -> Column:
    """The text of an error struct (kind, proto_id, detail)."""
    out = F.lit(None).cast("string")
    for kind, text in ERRORS.items():
        said = F.concat(F.lit(text), error["proto_id"].cast("string")) if kind == "UnsupportedProtocol" else F.concat(F.lit(text), F.coalesce(error["detail"], F.lit(""))) if kind == "ValidationError" else F.lit(text)
        out = F.when(error["kind"] == kind, said).otherwise(out)
    return out


def port_of(transport: Column, side: str) -> Column:
    """source or destination port, of tcp or else udp."""
    return F.coalesce(transport["tcp"][f"{side}_port"], transport["udp"][f"{side}_port"])
