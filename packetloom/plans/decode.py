"""Frames to decoded rows: a chain of projections, one for each layer.

No row moves: the plan of a decode has no exchange and no Python. Each stage names what the
next one reads more than once, so an expression is worked out once; members that a query
does not use are pruned with everything that only they need.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.bytes import bits, raw, u16, u32, word
from packetloom.functions.names import WARNINGS
from packetloom.operators import app, link, network, transport
from packetloom.operators.dns import dns, plain_name
from packetloom.plans.config import ParseConfig

MEMBERS = (
    "ethernet", "arp", "ipv4", "ipv6", "transport", "icmp", "icmpv6", "igmp", "tcp_options", "gre",
    "pppoe", "vxlan", "geneve", "ah", "esp", "wireguard", "mpls", "dns",
)
ARRAYS = ("udp_hints", "warnings")
_WARNING = "array<struct<code: string, ethertype: int, protocol: string, subcode: string, offset: int, message: string>>"


def warning(code: str, offset: Column, ethertype: Column | None = None) -> Column:
    protocol, subcode, message = WARNINGS[code]
    number = F.lit(None).cast("int") if ethertype is None else ethertype
    return F.struct(F.lit(code).alias("code"), number.alias("ethertype"), F.lit(protocol).alias("protocol"), F.lit(subcode).alias("subcode"), offset.cast("int").alias("offset"), F.lit(message).alias("message"))


def _held(name: str) -> Column:
    """A column as it is, by way of a lambda. A projection with a lambda is compiled by itself,
    in methods of bounded size; without any the whole chain would be one method, too large
    to compile, and every query would pay for the attempt."""
    return F.get(F.transform(F.array(F.col(name)), lambda x: x), F.lit(0))


@lru_cache(32)
def _stages(application: str, config: ParseConfig) -> tuple[list[tuple[Column, ...]], list[Column]]:
    """What each projection adds to what is there, and what the last one gives. Columns name no
    table, so an application makes them once."""
    c, b = F.col, F.col("_b")
    stages: list[tuple[Column, ...]] = []

    def stage(*columns: Column) -> None:
        stages.append(columns)

    # link
    stage(u16(b, 12).alias("_t12"))
    first = c("_t12")
    link_kind, tagged = (link.link_kind(b, first), first.isin(*link.VLAN)) if config.payloads else (F.lit("ethernet"), F.lit(False))
    stage(link_kind.alias("_link"), F.when(tagged, link.vlan_walk(b)).alias("_vlan"))
    vlan = c("_vlan")
    stage(
        link.cooked(c("_link"), F.coalesce(vlan["ethertype"], first), u16(b, 14), u16(b, 0)).alias("_type"),
        F.when(b.isNotNull(), link.cooked(c("_link"), F.coalesce(vlan["offset"], F.lit(14)), F.lit(16), F.lit(20))).alias("_l3"),
    )
    at, left = c("_l3"), c("_n") - c("_l3")
    # of a sound frame: what follows, and its first two words
    sound = ~F.coalesce(vlan["short"], F.lit(False)) & (at < c("_n"))
    kind = F.when(c("_type") == 0x0800, "ipv4").when(c("_type") == 0x86DD, "ipv6").when(c("_type") == 0x0806, "arp").when(c("_type").isin(0x8863, 0x8864), "pppoe").when(c("_type").isin(0x8847, 0x8848), "mpls").otherwise("other")
    ip = c("_type").isin(0x0800, 0x86DD)
    if not config.payloads:
        kind, ip = F.lit("other"), F.lit(False)
    stage(
        F.when(sound, kind).alias("_kind"), F.when(~sound, "InvalidLength").alias("_e1"),
        F.when(ip & (left >= 20), word(b, at)).alias("_i0"), F.when((c("_type") == 0x0800) & (left >= 20), word(b, at + 8)).alias("_i1"),
    )

    # network
    kind, i0, i1 = c("_kind"), c("_i0"), c("_i1")
    head = F.when(kind == "ipv4", network.ipv4_words_error(left, i0)).when(kind == "ipv6", network.ipv6_error(b, at)).when(kind == "arp", link.arp_error(b, at)).when(kind == "pppoe", link.pppoe_error(b, at)).when(kind == "mpls", link.mpls_error(b, at))
    if config.strict:
        head = head.when(kind == "other", "ValidationError")
    stage(F.coalesce("_e1", head).alias("_e2"))
    fine = c("_e2").isNull()
    v4, v6 = fine & (kind == "ipv4"), fine & (kind == "ipv6")
    total, ihl, payload = bits(i0, 32, 16).cast("int"), bits(i0, 56, 4).cast("int") * 4, bits(i0, 16, 16).cast("int")
    cut = total > left
    length = F.when(v4 & (total < ihl), "InvalidLength").when(v6 & (payload + 40 > left), "InvalidLength")
    if config.strict:
        length = length.when(v4 & cut, "InvalidLength")
    stage(
        F.when(fine & (kind == "mpls"), link.mpls_walk(b, at, config.max_mpls_labels)).alias("_mpls"),
        F.coalesce("_e2", length).alias("_e3"),
    )
    fine = c("_e3").isNull()
    v4, v6 = fine & (kind == "ipv4"), fine & (kind == "ipv6")
    stage(F.when(v6, network.extension_walk(b, at, config.max_ipv6_extension_headers)).alias("_walk"), _held("_e3").alias("_h3"))
    fine = c("_h3").isNull()
    v4, v6 = fine & (kind == "ipv4"), fine & (kind == "ipv6")
    walk = c("_walk")
    skipped = walk["limited"] | walk["non_initial"]
    stage(
        F.when(v4, bits(i1, 48, 8).cast("int")).when(walk["error"].isNull() & ~skipped, walk["next_header"]).alias("_proto"),
        F.when(v4, at + ihl).when(v6, at + walk["offset"]).alias("_l4"),
        F.when(v4, at + F.least(total, left)).when(v6, at + 40 + payload).alias("_end"),
    )

    # transport
    proto, l4, end = c("_proto"), c("_l4"), c("_end")
    stage(
        F.when(proto.isin(transport.TCP, transport.UDP) & (end - l4 >= 8), word(b, l4)).alias("_t0"),
        F.when((proto == transport.TCP) & (end - l4 >= 20), word(b, l4 + 8)).alias("_t1"), _held("_h3").alias("_h4"),
    )
    t0, t1 = c("_t0"), c("_t1")
    stage(F.coalesce(c("_h4"), walk["error"], transport.words_error(proto, end - l4, t0, t1)).alias("_error"), F.when(t0.isNotNull(), transport.udp_of_word(t0)).alias("_ports"))
    good = c("_error").isNull()
    stage(
        F.when(good & (proto == transport.UDP), c("_ports")).alias("_udp"),
        F.when(good & (proto == transport.UDP), raw(b, l4 + 8, c("_ports.length") - 8)).alias("_app"),
        _held("_error").alias("_h5"),
    )
    good = c("_h5").isNull()
    udp = c("_udp")
    m = c("_app")
    asked = app.port_is(udp, 53, 5353) & app.likely_dns(m)
    stage(F.when(asked, plain_name(m)).alias("_name"), _held("_h5").alias("_h6"))
    good = c("_h6").isNull()
    stage(
        F.when(udp.isNotNull(), app.hints(udp, m)).alias("_hints"),
        F.when(c("_name").isNotNull(), dns(m, c("_name"))).alias("_dns"),
        F.when(app.port_is(udp, 4789), app.vxlan(m)).alias("_vxlan"),
        F.when(app.port_is(udp, 6081), app.geneve(m)).alias("_geneve"),
        F.when(app.port_is(udp, 51820, 51821) & app.wireguard_type(m).isNotNull(), F.struct(app.wireguard_type(m).alias("message_type"))).alias("_wireguard"),
    )

    # rows
    mpls = c("_mpls")
    fragment = (kind == "ipv4") & (i0.bitwiseAND(0x3FFF) != 0)
    tunnel = proto.isin(transport.GRE, transport.AH, transport.ESP) | c("_vxlan").isNotNull() | c("_geneve").isNotNull()
    any_ = ((kind == "ipv4") & cut) | fragment | walk["limited"] | walk["non_initial"] | kind.isin("pppoe", "mpls", "other") | tunnel
    warned = F.when(any_, F.array_compact(F.array(
        F.when((kind == "ipv4") & cut, warning("Ipv4Truncated", at)),
        F.when(fragment, warning("Ipv4Fragmented", at + 6)),
        F.when(walk["limited"], warning("Ipv6ExtensionDepthLimit", l4)),
        F.when(walk["non_initial"], warning("Ipv6NonInitialFragment", l4)),
        F.when(kind == "pppoe", warning("PppoeNoPayload", at)),
        F.when(mpls["limited"], warning("MplsLabelDepthLimit", at + mpls["end"])),
        F.when(mpls["end"] < left, warning("MplsInner", at + mpls["end"])),
        F.when(kind == "other", warning("UnsupportedEthertype", F.lit(12), c("_type"))),
        F.when(proto == transport.GRE, warning("GreInner", l4)),
        F.when(c("_vxlan").isNotNull(), warning("VxlanInner", l4)),
        F.when(c("_geneve").isNotNull(), warning("GeneveInner", l4)),
        F.when((proto == transport.AH), warning("AhInner", l4)),
        F.when(proto == transport.ESP, warning("EspInner", l4)),
    )))
    tcp = good & (proto == transport.TCP)
    zero = F.lit(bytearray(6))
    frame = F.struct(
        link.cooked(c("_link"), raw(b, 0, 6), zero, zero).alias("destination"), link.cooked(c("_link"), raw(b, 6, 6), zero, zero).alias("source"), c("_type").alias("ethertype"),
        F.coalesce(vlan["tags"], F.array().cast("array<int>")).alias("vlan_tags"), at.alias("payload_offset"),
    )
    detail = F.when(c("_error") == "ValidationError", F.concat(F.lit("unsupported ethertype: 0x"), F.lpad(F.lower(F.hex("_type")), 4, "0")))
    out = {
        "ethernet": F.when(b.isNotNull(), frame),
        "arp": F.when(kind == "arp", link.arp(b, at)),
        "ipv4": F.when(kind == "ipv4", network.ipv4_of_words(b, at, i0, i1, u32(b, at + 16))),
        "ipv6": F.when(kind == "ipv6", network.ipv6_of_words(b, at, i0)),
        "transport": F.when(tcp | udp.isNotNull(), F.struct(F.when(tcp, "tcp").otherwise("udp").alias("kind"), F.when(tcp, transport.tcp_of_words(b, l4, t0, t1, u32(b, l4 + 16))).alias("tcp"), udp.alias("udp"))),
        "icmp": F.when(proto == transport.ICMP, transport.icmp(b, l4)),
        "icmpv6": F.when(proto == transport.ICMPV6, transport.icmp(b, l4)),
        "igmp": F.when(proto == transport.IGMP, transport.igmp(b, l4)),
        "tcp_options": F.when(tcp, transport.tcp_options(F.when(bits(t1, 28, 4) > 5, raw(b, l4 + 20, bits(t1, 28, 4).cast("int") * 4 - 20)))),
        "gre": F.when(proto == transport.GRE, transport.gre(b, l4)),
        "pppoe": F.when(kind == "pppoe", link.pppoe(b, at)),
        "vxlan": c("_vxlan"),
        "geneve": c("_geneve"),
        "ah": F.when(proto == transport.AH, transport.ah(b, l4)),
        "esp": F.when(proto == transport.ESP, transport.esp(b, l4)),
        "wireguard": c("_wireguard"),
        "mpls": F.when(mpls.isNotNull(), F.struct(mpls["labels"].alias("labels"))),
        "dns": c("_dns"),
    }
    members = [F.when(good, value).alias(name) for name, value in out.items()]
    arrays = [F.coalesce(F.when(good, c("_hints")), F.array().cast("array<string>")).alias("udp_hints"), F.coalesce(F.when(good, warned), F.array().cast(_WARNING)).alias("warnings")]
    error = F.when(~good, F.struct(c("_error").alias("kind"), F.lit(None).cast("int").alias("proto_id"), detail.alias("detail"))).alias("error")
    return stages, [*members, *arrays, error]


def decode(frames: DataFrame, data: str = "data", config: ParseConfig = ParseConfig()) -> DataFrame:
    """frames with a column for each of MEMBERS and ARRAYS, and ``error``.

    A row decodes whole or not at all: where error (kind, proto_id, detail) is not NULL, all
    members are NULL and both arrays empty. A NULL frame has neither error nor members.
    """
    kept = [F.col(f"`{c}`") for c in frames.columns]
    stages, out = _stages(frames.sparkSession.sparkContext.applicationId, config)
    rows = frames.select(*kept, F.col(data).alias("_b"), F.length(data).alias("_n"))
    for columns in stages:
        rows = rows.select("*", *columns)
    return rows.select(*kept, *out)
