"""Queries over stand-alone layers, views, texts and capture readers: messages are encoded from
the driver's tables, and the SQL says from the same columns what each must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import names, views
from packetloom.operators import layers, registry, validated
from packetloom.plans.config import MODES, DecodeConfig, ParseConfig
from packetloom.plans.decode import decode
from packetloom.queries import _ip, _read, dealt, query
from packetloom.sources import capture
from packetloom.sources import synth as S

c = F.col


def _case(k: Column, *values: Column) -> Column:
    """The k-th value."""
    out = F.when(k == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(k == i, v)
    return out


def _told(x: Column) -> Column:
    """Of a parse: its error's kind, or ok."""
    return F.coalesce(x["error"]["kind"], F.lit("ok"))


# ---------------------------------------------------------------- acceptance tests

#: By case: the message as hex (x: the key's 16 bits), and (can_parse, is_valid) of arp, ipv4,
#: ipv6, icmp, icmpv6, igmp, tcp, udp, dns and any bytes, 1 for true.
_MESSAGES = [
    ("", "00 00 00 00 00 00 00 00 00 00"),
    ("0001 0800 0604 0001 000000000000 0a000001 000000000000 0a000002", "11 00 00 10 10 00 00 00 00 11"),
    ("0006 0800 0604 0001 000000000000 0a000001 000000000000 0a000002", "01 00 00 10 10 00 00 00 00 11"),
    ("0001 0800 0804 0001 000000000000 0a000001 000000000000 0a000002", "10 00 00 10 10 00 00 00 00 11"),
    ("60000000 0008 3a40" + "00" * 32 + "8000000000010002", "00 00 11 00 10 00 00 11 10 11"),
    ("60000000 0009 3a40" + "00" * 32 + "8000000000010002", "00 00 10 00 10 00 00 11 10 11"),
    ("50000000 0008 3a40" + "00" * 32 + "8000000000010002", "00 00 00 00 10 00 00 11 10 11"),
    ("8700000000010002", "00 00 00 00 11 00 00 00 00 11"),
    ("8400000000010002", "00 00 00 00 10 00 00 00 00 11"),
    ("8a00000000010002", "00 00 00 00 00 00 00 00 00 11"),
    ("0800f7fc00010002", "00 00 00 11 10 01 00 00 00 11"),
    ("12000dff e0000000", "00 00 00 11 10 11 00 00 00 11"),
    ("12000dfe e0000000", "00 00 00 10 10 10 00 00 00 11"),
    ("33000dff e0000000", "00 00 00 00 10 00 00 00 00 11"),
    ("d431 0050 00000001 00000000 5002 ffff 0000 0000", "00 00 00 00 00 00 11 00 10 11"),
    ("d431 0050 00000001 00000000 6002 ffff 0000 0000", "00 00 00 00 00 00 00 00 10 11"),
    ("d431 0050 00000001 00000000 4002 ffff 0000 0000", "00 00 00 00 00 00 00 00 10 11"),
    ("d431 0035 0009 0000 01", "00 00 00 00 00 00 00 11 00 11"),
    ("d431 0035 000a 0000 01", "00 00 00 00 00 00 00 00 00 11"),
    ("d431 0035 0007 0000 01", "00 00 00 00 00 00 00 00 00 11"),
    ("1234 0100 0001 0000 0000 0000" + "00" * 12, "00 00 00 10 10 10 00 00 11 11"),
    ("1234 0100 0001 0000 0000 0000" + "00" * 11, "00 00 00 10 10 10 00 00 10 11"),
    ("1234 0800 0001 0000 0000 0000" + "00" * 12, "00 00 00 10 10 10 00 00 01 11"),
    ("1234 8180 0000 0000 0000 0000" + "00" * 12, "00 00 00 10 10 10 00 00 10 11"),
    ("4500 0014 0001 0000 4001 66e6 0a000001 0a000002", "00 11 00 01 10 01 00 00 10 11"),
]
_TESTS = ("arp", "ipv4", "ipv6", "icmp", "icmpv6", "igmp", "tcp", "udp", "dns", "openvpn")


@query("SELECT CAST(n_nationkey AS BIGINT) AS key, list_element([" + ", ".join(f"'{said}'" for _, said in _MESSAGES) + "], n_nationkey + 1) AS said FROM nation")
def acceptance_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tests of every processor, on a message for each border of each test."""
    b = _case(c("n_nationkey"), *[S.hexed(h) for h, _ in _MESSAGES])
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", b.alias("b"))
    bit = lambda x: F.when(x, "1").otherwise("0")
    tests = [F.concat(bit(layers.PROTOCOLS[p].can_parse(c("b"))), bit(layers.PROTOCOLS[p].is_valid(c("b")))) for p in _TESTS]
    return rows.select(c("n_nationkey").cast("long").alias("key"), F.concat_ws(" ", *tests).alias("said"))


# ---------------------------------------------------------------- parses


@query(f"""
SELECT p_partkey AS key, CASE k WHEN 1 THEN 'InvalidHeader' WHEN 2 THEN 'InvalidLength' ELSE 'ok' END AS arp, CASE k WHEN 1 THEN 'InvalidHeader' WHEN 2 THEN 'InvalidLength' ELSE 'ok' END AS ipv4,
  CASE WHEN k IN (1, 2) THEN 'InvalidHeader' ELSE 'ok' END AS ipv6, CASE k WHEN 1 THEN 'InvalidHeader' WHEN 2 THEN 'InvalidLength' ELSE 'ok' END AS icmp, CASE k WHEN 1 THEN 'InvalidHeader' WHEN 2 THEN 'InvalidLength' ELSE 'ok' END AS tcp,
  CASE k WHEN 1 THEN 'InvalidHeader' WHEN 2 THEN 'InvalidLength' ELSE 'ok' END AS udp, CASE k WHEN 1 THEN 'MalformedPacket' WHEN 2 THEN 'InvalidLength' ELSE 'ok' END AS dns, CASE k WHEN 2 THEN 'InvalidLength' ELSE 'ok' END AS openvpn,
  CASE k WHEN 1 THEN 'UnsupportedProtocol 2' WHEN 2 THEN 'InvalidLength' WHEN 3 THEN 'UnsupportedProtocol 255' ELSE 'ok' END AS wireguard,
  CASE WHEN k IN (0, 3) THEN {_ip('p_partkey')} END AS sender, CASE WHEN k IN (0, 3) THEN {_ip('p_partkey')} END AS source, CASE WHEN k IN (0, 3) THEN '01020304' END AS options,
  CAST(CASE WHEN k IN (0, 3) THEN p_partkey % 1048576 END AS BIGINT) AS flow, CAST(CASE WHEN k IN (0, 3) THEN 8 END AS BIGINT) AS icmp_type, CAST(CASE WHEN k IN (0, 3) THEN p_partkey % 65536 END AS BIGINT) AS tcp_port,
  CAST(CASE WHEN k IN (0, 3) THEN p_partkey % 65536 END AS BIGINT) AS udp_port, CASE WHEN k IN (0, 3) THEN 'p' || p_partkey || '.test' END AS qname, CAST(CASE WHEN k <> 2 THEN 56 END AS BIGINT) AS flags
FROM (SELECT p_partkey, p_partkey % 4 AS k FROM part)""")
def layer_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stand-alone parse: sound, with a bad header, cut short, and sound again."""
    key = c("p_partkey")
    k = key % 4
    bad, cut = k == 1, k == 2
    port = S.num(key % 65536, 2)

    def of(good: Column, header: Column, size: int) -> Column:
        return F.when(bad, header).when(cut, F.substring(good, F.lit(1), F.lit(size))).otherwise(good)

    arp = lambda kind: S.join(S.hexed("0001 0800"), S.hexed(kind), S.hexed("0002 020000000002"), S.address(key), S.hexed("000000000000 0a000001"))
    ip4 = lambda first: S.join(S.hexed(first), S.hexed("00 0019 0001 0000 40 01 0000"), S.address(key), S.hexed("0a000002 01020304 ff"))
    ip6 = lambda version: S.join(S.num(F.lit(version << 28).cast("bigint") + key % 1048576, 4), S.hexed("0000 3b40"), S.zeros(32))
    echo = S.with_checksum(c("echo"), 2)
    tcp = lambda words: S.join(port, S.hexed("0050 00000001 00000002"), S.hexed(words), S.hexed("10 0400 0000 0000"))
    udp = lambda size: S.join(port, S.hexed("0035"), S.hexed(size), S.hexed("0000 61"))
    label = F.concat(F.lit("p"), key.cast("string"))
    dns = lambda x: S.dns_query(key % 65536, [x, F.lit("test")])
    guard = S.join(_case(k, *[S.hexed(h) for h in ("01000000", "02000000", "01000000", "00010000")]), S.zeros(12))
    rows = dealt(spark, sf_dir, "part", "p_partkey").select("p_partkey", S.join(S.hexed("08000000"), port, S.hexed("0001")).alias("echo")).select(
        "p_partkey", of(arp("0604"), arp("0804"), 27).alias("a"), of(ip4("46"), ip4("44"), 24).alias("i4"), of(ip6(6), ip6(4), 39).alias("i6"), of(echo, S.join(S.hexed("08ff0000"), port, S.hexed("0001")), 7).alias("i"),
        of(tcp("50"), tcp("40"), 19).alias("t"), of(udp("0009"), udp("0007"), 8).alias("u"), of(dns(label), dns(F.concat(F.lit("_"), label)), 15).alias("d"), F.when(cut, S.hexed("38")).otherwise(S.hexed("3801")).alias("o"),
        F.when(cut, F.substring(guard, F.lit(1), F.lit(15))).otherwise(guard).alias("w"),
    )
    x = rows.select("p_partkey", *[layers.PROTOCOLS[p].parse(c(m)).alias(p) for p, m in (("arp", "a"), ("ipv4", "i4"), ("ipv6", "i6"), ("icmp", "i"), ("tcp", "t"), ("udp", "u"), ("dns", "d"), ("openvpn", "o"), ("wireguard", "w"))])
    wireguard = F.concat_ws(" ", _told(c("wireguard")), c("wireguard.error.proto_id").cast("string"))
    return x.select(
        key.alias("key"), *[_told(c(p)).alias(p) for p in ("arp", "ipv4", "ipv6", "icmp", "tcp", "udp", "dns", "openvpn")], wireguard.alias("wireguard"), c("arp.value.sender_protocol_addr").alias("sender"), c("ipv4.value.source").alias("source"),
        F.hex("ipv4.value.options").alias("options"), c("ipv6.value.flow_label").alias("flow"), c("icmp.value.icmp_type").cast("long").alias("icmp_type"), c("tcp.value.source_port").cast("long").alias("tcp_port"),
        c("udp.value.source_port").cast("long").alias("udp_port"), F.get(c("dns.value.questions"), F.lit(0))["qname"].alias("qname"), c("openvpn.value.flags").cast("long").alias("flags"),
    )


@query(f"""
SELECT c_custkey AS key, CASE WHEN k = 4 THEN 'InvalidLength' ELSE 'ok' END AS outcome, CASE WHEN k < 4 THEN CASE WHEN k = 3 THEN 'report-v3' ELSE 'query-v3' END END AS kind,
  CASE k WHEN 0 THEN '' WHEN 1 THEN {_ip('c_custkey')} WHEN 2 THEN {_ip('c_custkey')} || ',10.0.0.2' WHEN 3 THEN {_ip('c_custkey')} || ',10.0.0.2|10.0.0.3' END AS sources,
  k < 3 AND c_custkey % 2 = 1 AS s_flag, CAST(CASE WHEN k < 3 THEN c_custkey % 8 END AS BIGINT) AS qrv, CAST(CASE WHEN k < 3 THEN 20 END AS BIGINT) AS qqic, CAST(CASE WHEN k = 3 THEN 2 END AS BIGINT) AS records, CASE WHEN k = 3 THEN 'AABBCCDD' END AS aux
FROM (SELECT c_custkey, c_custkey % 5 AS k FROM customer)""")
def igmp_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 3 queries with no, one and two sources, a report of two records, and a count of
    sources that the message does not hold."""
    key = c("c_custkey")
    k = key % 5
    head = S.join(S.hexed("110a0000 e0000001 00"), S.num(key % 2 * 128 + key % 8, 1), S.hexed("14"))
    one, two = S.address(key), S.hexed("0a000002")
    report = S.join(S.hexed("22000000 00000002 01010002 e0000001"), one, two, S.hexed("aabbccdd 02000001 e0000002 0a000003"))
    m = _case(k, S.join(head, S.hexed("0000")), S.join(head, S.hexed("0001"), one), S.join(head, S.hexed("0002"), one, two), report, S.join(head, S.hexed("0003"), one))
    rows = dealt(spark, sf_dir, "customer", "c_custkey").select("c_custkey", m.alias("bare")).select("c_custkey", S.with_checksum(c("bare"), 2).alias("m"))
    x = rows.select("c_custkey", validated.parse_igmp(c("m")).alias("x")).select("c_custkey", "x", c("x.value").alias("v"))
    of_records = F.array_join(F.transform("v.group_records", lambda r: F.array_join(r["source_addresses"], ",")), "|")
    return x.select(
        key.alias("key"), _told(c("x")).alias("outcome"), c("v.kind").alias("kind"), F.coalesce(F.array_join("v.source_addresses", ","), of_records).alias("sources"),
        F.coalesce(c("v.s_flag"), F.lit(False)).alias("s_flag"), c("v.qrv").cast("long").alias("qrv"), c("v.qqic").cast("long").alias("qqic"), c("v.num_group_records").cast("long").alias("records"), F.hex(F.get(c("v.group_records"), F.lit(0))["aux_data"]).alias("aux"),
    )


# ---------------------------------------------------------------- views


@query(f"""
SELECT s_suppkey AS key, {_ip('s_suppkey')} AS v4_source, CAST(17 AS BIGINT) AS v4_protocol, CAST(9 AS BIGINT) AS v4_payload, CAST(17 AS BIGINT) AS v6_next, CAST(3 AS BIGINT) AS v6_payload, lower(lpad(printf('%x', s_suppkey), 8, '0')) AS v6_tail,
  CAST(s_suppkey AS BIGINT) AS xid, {_ip('s_suppkey')} AS yiaddr, CAST(2 AS BIGINT) AS options, CAST(2048 AS BIGINT) AS gre_type, CAST(1 AS BIGINT) AS gre_payload, s_suppkey % 2 = 1 AS has_vni, CAST(s_suppkey AS BIGINT) AS vni,
  CAST(2 AS BIGINT) AS arp_operation, {_ip('s_suppkey')} AS arp_target, s_suppkey % 2 = 1 AS is_response, CAST(s_suppkey % 65536 AS BIGINT) AS dns_id, CAST(3 AS BIGINT) AS dns_answers,
  CAST(s_suppkey % 65536 AS BIGINT) AS tcp_port, CAST(2 AS BIGINT) AS tcp_payload, CAST(8 AS BIGINT) AS icmp_type, CAST(s_suppkey % 65536 AS BIGINT) AS icmp_sum, CAST(135 AS BIGINT) AS icmpv6_type, CAST(5 AS BIGINT) AS icmpv6_payload,
  CAST(s_suppkey % 65536 AS BIGINT) AS sll_type, CAST(34525 AS BIGINT) AS sll_protocol, CAST(s_suppkey AS BIGINT) AS sll2_index, CAST(4 AS BIGINT) AS sll2_type, CAST(14 AS BIGINT) AS cut_off
FROM supplier""")
def all_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view over one header, and over one byte less than it takes."""
    key = c("s_suppkey")
    two, three, four = (S.num(key % (1 << 8 * n), n) for n in (2, 3, 4))
    odd = key % 2
    heads = {
        "ipv4": (S.join(S.hexed("4500 001d 0001 0000 40 11 0000"), S.address(key), S.hexed("0a000002"), S.zeros(9), S.hexed("ffff")), 20),
        "ipv6": (S.join(S.hexed("60000000 0003 1140"), S.zeros(12), four, S.zeros(16), S.hexed("616263ff")), 40),
        "udp": (S.join(two, S.hexed("0035 0009 0000 61")), 8),
        "dhcp": (S.join(S.hexed("02010600"), four, S.zeros(8), S.address(key), S.zeros(216), S.hexed("63825363 35ff")), 240),
        "gre": (S.hexed("0000 0800 ff"), 4),
        "vxlan": (S.join(S.num(odd * 8, 1), S.zeros(3), three, S.zeros(1)), 8),
        "arp": (S.join(S.hexed("0001 0800 0604 0002 020000000002 0a000001 020000000003"), S.address(key)), 28),
        "dns": (S.join(two, S.num(odd * 32768, 2), S.hexed("0001 0003 0000 0000")), 12),
        "tcp": (S.join(two, S.hexed("0050 00000001 00000002 60 10 0400 0000 0000 01010101 6162")), 20),
        "icmp": (S.join(S.hexed("0800"), two, S.hexed("00")), 4),
        "icmpv6": (S.join(S.hexed("8700"), two, S.zeros(5)), 4),
        "sll": (S.join(two, S.hexed("0001 0006 020000000002 0000 86dd 00")), 16),
        "sll2": (S.join(S.hexed("0800 0000"), four, S.hexed("0001 04 06 0200000000020000 00")), 20),
        "ethernet": (S.join(S.zeros(12), S.hexed("0800")), 14),
    }
    rows = dealt(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", *[b.alias(f"b_{n}") for n, (b, _) in heads.items()], *[F.substring(b, F.lit(1), F.lit(least - 1)).alias(f"s_{n}") for n, (b, least) in heads.items()])
    v = rows.select("s_suppkey", *[views.view(n, f"b_{n}").alias(n) for n in heads], sum((views.view(n, f"s_{n}").isNull().cast("int") for n in heads), F.lit(0)).cast("long").alias("cut_off"))
    n = lambda x: c(x).cast("long")
    size = lambda x: F.length(x).cast("long")
    return v.select(
        key.alias("key"), c("ipv4.source").alias("v4_source"), n("ipv4.protocol").alias("v4_protocol"), size("ipv4.payload").alias("v4_payload"), n("ipv6.next_header").alias("v6_next"), size("ipv6.payload").alias("v6_payload"),
        F.lower(F.substring(F.hex("ipv6.source"), 25, 8)).alias("v6_tail"), n("dhcp.xid").alias("xid"), c("dhcp.yiaddr").alias("yiaddr"), size("dhcp.options").alias("options"), n("gre.protocol_type").alias("gre_type"), size("gre.payload").alias("gre_payload"),
        c("vxlan.has_vni_flag").alias("has_vni"), n("vxlan.vni").alias("vni"), n("arp.operation").alias("arp_operation"), c("arp.target_protocol_addr").alias("arp_target"), c("dns.is_response").alias("is_response"), n("dns.transaction_id").alias("dns_id"),
        n("dns.answer_count").alias("dns_answers"), n("tcp.source_port").alias("tcp_port"), size("tcp.payload").alias("tcp_payload"), n("icmp.icmp_type").alias("icmp_type"), n("icmp.checksum").alias("icmp_sum"), n("icmpv6.icmp_type").alias("icmpv6_type"),
        size("icmpv6.payload").alias("icmpv6_payload"), n("sll.packet_type").alias("sll_type"), n("sll.protocol").alias("sll_protocol"), n("sll2.if_index").alias("sll2_index"), n("sll2.packet_type").alias("sll2_type"), "cut_off",
    )


# ---------------------------------------------------------------- IPv6 headers, IPv4 options


@query("""
SELECT c_custkey AS key, CASE WHEN k IN (1, 5) THEN NULL ELSE 'udp' END AS transport, CASE k WHEN 1 THEN 'ipv6-non-initial-fragment@62' ELSE '' END AS warnings, CASE k WHEN 5 THEN 'InvalidLength' END AS error, CASE k WHEN 6 THEN '01020304' END AS options
FROM (SELECT c_custkey, c_custkey % 7 AS k FROM customer)""")
def more_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv6: first and later fragments, hop-by-hop, routing, AH, a header that is cut off; IPv4
    with options."""
    k, datagram = c("c_custkey") % 7, S.udp(1000, 2000, S.hexed("00"))
    kinds = [44, 44, 0, 43, 51, 60]
    chains = [S.join(S.hexed(h), datagram) for h in ("1100 0001 00000001", "1100 0008 00000001", "1100 000000000000", "1102 0401" + "00" * 20, "1101 0000 0000000100000002", "11ff 000000000000")]
    v6 = _case(k, *[S.ethernet(0x86DD, S.ipv6(n, chain)) for n, chain in zip(kinds, chains)])
    v4 = S.ethernet(0x0800, S.join(S.hexed("4600 0021 0001 0000 40 11 0000 0a000001 0a000002 01020304"), datagram))
    d = decode(dealt(spark, sf_dir, "customer", "c_custkey").withColumn("data", F.when(k == 6, v4).otherwise(v6)))
    said = F.array_join(F.transform("warnings", lambda w: F.concat(w["subcode"], F.lit("@"), w["offset"].cast("string"))), ",")
    return d.select(c("c_custkey").alias("key"), names.transport_protocol_name(c("transport")).alias("transport"), said.alias("warnings"), c("error.kind").alias("error"), F.hex("ipv4.options").alias("options"))


# ---------------------------------------------------------------- texts


@query("""
SELECT CAST(n_nationkey AS BIGINT) AS key, CASE n_nationkey % 4 WHEN 0 THEN 'link' WHEN 1 THEN 'network' WHEN 2 THEN 'network' ELSE 'tunnel' END AS class, CASE n_nationkey % 2 WHEN 0 THEN 'permissive' ELSE 'strict' END AS mode,
  CASE n_nationkey % 2 WHEN 0 THEN 'TCP' ELSE 'UDP' END AS transport, CAST(n_nationkey + 1000 AS BIGINT) AS source_port, CAST(n_nationkey + 2000 AS BIGINT) AS destination_port,
  CASE n_nationkey % 4 WHEN 0 THEN 'ipv4' WHEN 1 THEN 'ipv6' WHEN 2 THEN 'UnsupportedProtocol 5' ELSE 'InvalidLength' END AS network,
  CASE n_nationkey % 7 WHEN 0 THEN 'Required field is missing' WHEN 1 THEN 'Invalid packet length' WHEN 2 THEN 'Invalid packet header' WHEN 3 THEN 'Malformed packet' WHEN 4 THEN 'Unsupported protocol ID: ' || n_nationkey
    WHEN 5 THEN 'Insufficient data in packet' ELSE 'Validation error: ' || n_name END AS layer_error,
  CASE n_nationkey % 4 WHEN 0 THEN 'Malformed header for protocol: ' || n_name WHEN 1 THEN 'Insufficient bytes: needed ' || (n_nationkey + 5) || ', available ' || n_nationkey
    WHEN 2 THEN 'Unsupported protocol: ' || n_name ELSE 'Decode depth limit exceeded: ' || (n_nationkey + 5) END AS decode_error
FROM nation""")
def names_and_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name = c("n_nationkey"), c("n_name")
    codes = ["UnsupportedEthertype", "Ipv4Truncated", "Ipv6NonInitialFragment", "GreInner"]
    tcp = F.struct((key + 1000).alias("source_port"), (key + 2000).alias("destination_port"))
    none = F.when(F.lit(False), tcp)
    info = F.when(key % 2 == 0, F.struct(tcp.alias("tcp"), none.alias("udp"))).otherwise(F.struct(none.alias("tcp"), tcp.alias("udp")))
    kinds = ["MissingField", "InvalidLength", "InvalidHeader", "MalformedPacket", "UnsupportedProtocol", "InsufficientData", "ValidationError"]
    error = F.struct(_case(key % 7, *map(F.lit, kinds)).alias("kind"), key.cast("int").alias("proto_id"), name.alias("detail"))
    failed = _case(key % 4, *map(F.lit, ("MalformedHeader", "InsufficientBytes", "UnsupportedProtocol", "DepthLimitExceeded")))
    rows = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", info.alias("i"), error.alias("e"), validated.identify_network(_case(key % 4, *[S.hexed(h) for h in ("45", "60", "50", "")])).alias("p"))
    network = F.coalesce(c("p.value"), F.concat_ws(" ", c("p.error.kind"), c("p.error.proto_id").cast("string")))
    return rows.select(
        key.cast("long").alias("key"), _case(key % 4, *[F.lit(names.WARNINGS[x][0]) for x in codes]).alias("class"), _case(key % 2, *map(F.lit, MODES)).alias("mode"),
        F.when(c("i.tcp").isNotNull(), names.layer_protocol_name(F.lit(6))).otherwise(names.layer_protocol_name(F.lit(17))).alias("transport"), names.port_of(c("i"), "source").cast("long").alias("source_port"), names.port_of(c("i"), "destination").cast("long").alias("destination_port"),
        network.alias("network"), names.error_text(c("e")).alias("layer_error"), registry.decode_error_text(failed, name, key + 5, key).alias("decode_error"),
    )


# ---------------------------------------------------------------- plug-ins


@query("""
SELECT o_orderkey AS key, CASE WHEN o_orderkey % 100 >= 64 THEN 'Insufficient bytes: needed ' || (o_orderkey % 100) || ', available 63' END AS error,
  CASE WHEN o_orderkey % 100 BETWEEN 32 AND 63 THEN 'long' WHEN o_orderkey % 100 BETWEEN 1 AND 31 THEN 'short' END AS matched, CAST(CASE WHEN o_orderkey % 100 BETWEEN 32 AND 63 THEN 2 WHEN o_orderkey % 100 BETWEEN 1 AND 31 THEN 1 ELSE 0 END AS BIGINT) AS events, true AS idle, CAST(65535 AS BIGINT) AS usual
FROM orders""")
def plug_in_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of 63 bytes; events in order; an empty registry matches nothing."""
    one = lambda n: (lambda b: registry.event(n, F.lit(0), F.length(b)))
    held = registry.Registry().register(registry.Dissector("short", lambda b: F.when(F.length(b) > 0, F.lit(1)), lambda b: F.array(one("short")(b))))
    held.register(registry.Dissector("long", lambda b: F.when(F.length(b) >= 32, F.lit(2)), lambda b: F.array(one("head")(b), one("body")(b))))
    rows = dealt(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", S.zeros(c("o_orderkey") % 100).alias("b"))
    x = rows.select("o_orderkey", held.decode(c("b"), DecodeConfig(max_packet_bytes=63)).alias("r"), registry.Registry().decode(c("b"), DecodeConfig(max_packet_bytes=63)).alias("none"))
    events = F.when(F.size("r.events") == 2, F.when((F.get("r.events", F.lit(0))["protocol"] == "head") & (F.get("r.events", F.lit(1))["protocol"] == "body"), 2)).otherwise(F.coalesce(F.size("r.events"), F.lit(0)))
    return x.select(
        c("o_orderkey").alias("key"), registry.error_text(c("r.error")).alias("error"), c("r.matched").alias("matched"), F.greatest(events, F.lit(0)).cast("long").alias("events"),
        (c("none.matched").isNull() & (F.size("none.events") <= 0)).alias("idle"), F.lit(DecodeConfig().max_packet_bytes).cast("long").alias("usual"),
    )


# ---------------------------------------------------------------- the older walk


@query(f"""
SELECT event_id AS key, CASE WHEN k = 0 THEN 'linux-cooked-v1' WHEN k < 6 THEN 'ethernet-ii' END AS format, CAST(CASE WHEN k = 0 THEN 16 WHEN k < 6 THEN 14 END AS BIGINT) AS network_offset,
  CASE k WHEN 4 THEN '8.0.69.0' END AS ipv4_source, CASE k WHEN 0 THEN 'udp' WHEN 1 THEN 'tcp' WHEN 2 THEN 'udp' WHEN 3 THEN 'tcp' END AS transport,
  CAST(CASE k WHEN 0 THEN 2000 WHEN 1 THEN 80 WHEN 2 THEN 53 WHEN 3 THEN 53 END AS BIGINT) AS port, CASE WHEN k < 4 THEN 'unknown' END AS application, CASE WHEN k >= 6 THEN 'MalformedPacket' END AS error,
  CASE k WHEN 5 THEN 'InvalidHeader' WHEN 7 THEN 'InvalidLength' ELSE 'ok' END AS link_layer
FROM (SELECT event_id, event_id % 8 AS k FROM events)""")
def older_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cooked and Ethernet frames, UDP that has the shape of TCP, an address that looks like an
    IPv4 header, ARP with a bad header, VLAN tags and frames too short for a format."""
    key = c("event_id")
    k = key % 8
    datagram = S.udp(1000, 2000, S.hexed("00"))
    shaped = S.udp(1000, 53, S.join(S.hexed("00000000 50"), S.zeros(7)))  # its twelfth byte reads as five words
    eth = lambda kind, body: S.join(S.hexed("020000000001 020000000002"), S.num(kind, 2), body)
    frame = _case(
        k,
        S.join(S.hexed("0000 0001 0006 0200000000010000 0800"), S.ipv4(17, key, key, datagram)),
        eth(0x0800, S.ipv4(6, key, key, S.tcp(key % 1000 + 1, F.lit(80), 2))),
        eth(0x86DD, S.ipv6(17, S.udp(1000, 53, S.hexed("00")))),
        eth(0x0800, S.ipv4(17, key, key, shaped)),
        S.join(S.hexed("450000140001 020000000002 0800"), S.hexed("450000140001 00")),
        eth(0x0806, S.join(S.hexed("0001 0800 0704 0001"), S.zeros(20))),
        eth(0x8100, S.join(S.hexed("0001 0800"), S.ipv4(17, key, key, datagram))),
        S.hexed("0000 0001 0006"),
    )
    rows = dealt(spark, sf_dir, "events", "event_id").select("event_id", frame.alias("b"))
    x = rows.select("event_id", layers.parse_layers(c("b")).alias("p"), layers.LAYERS["datalink"].process(c("b")).alias("link"))
    return x.select(
        key.alias("key"), c("p.format").alias("format"), c("p.network_offset").cast("long").alias("network_offset"), c("p.network_ipv4.source").alias("ipv4_source"), c("p.transport.kind").alias("transport"),
        names.port_of(c("p.transport"), "destination").cast("long").alias("port"), c("p.application.kind").alias("application"), c("p.error").alias("error"), F.coalesce(c("link.error"), F.lit("ok")).alias("link_layer"),
    )


# ---------------------------------------------------------------- captures


def _ordered(little: bool, value: Column | int, size: int) -> Column:
    """Bytes of a number in either order."""
    big = S.num(value, size)
    return F.concat(*[F.substring(big, F.lit(i), F.lit(1)) for i in range(size, 0, -1)]) if little else big


@query("""
SELECT 'file' || n_nationkey AS path, CAST(CASE WHEN k = 5 THEN 0 WHEN k = 4 THEN 0 ELSE n_nationkey + 100 END AS BIGINT) AS ts_sec, CAST(CASE WHEN k IN (4, 5) THEN 0 ELSE n_nationkey END AS BIGINT) AS ts_subsec,
  CASE k WHEN 4 THEN 'ab' WHEN 5 THEN 'abc' ELSE 'frame' END AS data, k < 4 AS as_pcap, k >= 4 AS as_pcapng
FROM (SELECT n_nationkey, n_nationkey % 6 AS k FROM nation)""")
def capture_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kinds of pcap, and simple packets of pcapng in both orders; each file also read
    as one format only."""
    key = c("n_nationkey")
    k = key % 6

    def pcap(magic: str, little: bool) -> Column:
        n = lambda v, size=4: _ordered(little, v, size)
        head = S.join(S.hexed(magic), n(2, 2), n(4, 2), S.zeros(8), n(65535), n(1))
        return S.join(head, n(key + 100), n(key), n(5), n(9), F.encode(F.lit("frame"), "UTF-8"))

    def pcapng(little: bool, said: int, text: str) -> Column:
        n = lambda v, size=4: _ordered(little, v, size)
        section = S.join(S.hexed("0a0d0d0a"), n(28), n(0x1A2B3C4D), n(1, 2), n(0, 2), S.hexed("ff" * 8), n(28))
        return S.join(section, n(99), n(12), n(12), n(3), n(20), n(said), F.encode(F.lit(text), "UTF-8"), n(20))

    content = _case(k, pcap("d4c3b2a1", True), pcap("a1b2c3d4", False), pcap("4d3cb2a1", True), pcap("a1b23c4d", False), pcapng(True, 2, "ab--"), pcapng(False, 3, "abc-"))
    files = _read(spark, sf_dir, "nation").select(F.concat(F.lit("file"), key.cast("string")).alias("path"), content.alias("content"))
    found = capture.explode_captures(files).select("path", "ts_sec", "ts_subsec", F.decode("data", "UTF-8").alias("data"))
    for kind in ("pcap", "pcapng"):
        only = capture.explode_captures(files, kind).groupBy("path").agg(F.max(F.col("error").isNull()).alias(f"as_{kind}"))
        found = found.join(only, "path")
    return found.select("path", "ts_sec", "ts_subsec", "data", "as_pcap", "as_pcapng")


@query("""
SELECT 'file' || n_nationkey AS path, CASE n_nationkey % 4 WHEN 1 THEN 'InvalidLength' WHEN 2 THEN 'MalformedPacket' END AS error, CAST(CASE n_nationkey % 4 WHEN 0 THEN 3 WHEN 3 THEN 0 END AS BIGINT) AS frames, CASE n_nationkey % 4 WHEN 0 THEN 'a,bb,ccc' WHEN 3 THEN '' END AS data,
  CAST(CASE n_nationkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE 0 END AS BIGINT) AS lenient
FROM nation""")
def whole_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read as a whole: sound, cut in the last frame, of no format, and empty of frames;
    beside them how many frames the lenient reading keeps."""
    key = c("n_nationkey")
    head = S.hexed("a1b2c3d4 0002 0004 00000000 00000000 0000ffff 00000001")
    frame = lambda text, size=None: S.join(S.num(7, 4), S.num(8, 4), S.num(size or len(text), 4), S.num(len(text), 4), F.encode(F.lit(text), "UTF-8"))
    three = S.join(head, frame("a"), frame("bb"), frame("ccc"))
    content = _case(key % 4, three, S.join(three, frame("dddd", 5)), S.hexed("00010203"), head)
    files = _read(spark, sf_dir, "nation").select(F.concat(F.lit("file"), key.cast("string")).alias("path"), content.alias("content"))
    lenient = capture.explode_captures(files).groupBy("path").agg(F.count("data").alias("lenient"))
    whole = capture.whole_captures(files).join(lenient, "path", "left")
    data = F.array_join(F.transform("frames", lambda f: F.decode(f["data"], "UTF-8")), ",")
    return whole.select("path", "error", F.when(c("frames").isNotNull(), F.size("frames")).cast("long").alias("frames"), data.alias("data"), F.coalesce("lenient", F.lit(0)).cast("long").alias("lenient"))


@query("""
SELECT CAST(r_regionkey AS BIGINT) AS key, 'aa:bb:cc:dd:ee:ff' AS mac, '10.0.0.1' AS source, '10.0.0.2' AS destination, CAST(54321 AS BIGINT) AS source_port, CAST(80 AS BIGINT) AS destination_port, true AS syn, false AS ack,
  CAST(65552 AS BIGINT) AS dumped, '10000   ' || rpad('', 47, '00 ') || '   ................' || chr(10) AS last_line, ' ' AS none
FROM region""")
def demo_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The demo's frame, and the last line of a dump of 65,552 zero bytes."""
    from packetloom.__main__ import SYN
    from packetloom.functions.bytes import mac_text

    rows = decode(_read(spark, sf_dir, "region").withColumn("data", F.lit(bytearray(SYN))), config=ParseConfig(mode="strict")).withColumn("zeros", S.zeros(c("r_regionkey") * 0 + 65552))
    t = c("transport.tcp")
    last = F.element_at(F.split(validated.hexdump(c("zeros")), "\n"), -2)
    return rows.select(
        c("r_regionkey").cast("long").alias("key"), mac_text(c("ethernet.source")).alias("mac"), c("ipv4.source").alias("source"), c("ipv4.destination").alias("destination"), t["source_port"].cast("long").alias("source_port"),
        t["destination_port"].cast("long").alias("destination_port"), t["flags"]["syn"].alias("syn"), t["flags"]["ack"].alias("ack"), F.length("zeros").cast("long").alias("dumped"), F.concat(last, F.lit("\n")).alias("last_line"), F.lit(" ").alias("none"),
    )
