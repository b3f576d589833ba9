"""Frames byte by byte, with the results that their formats and limits ask for."""

import struct

import pytest

from packetloom import ParseConfig, decode

ETH = bytes.fromhex("020000000001") + bytes.fromhex("020000000002")
SYN_OPTIONS = bytes.fromhex("020405b4 0402 080a 00000064 00000000 01 030307")
QUERY = bytes.fromhex("123401000001000000000000") + b"\x03www\x07example\x03com\x00\x00\x01\x00\x01"


def eth(kind, payload, tags=b""):
    return ETH + tags + struct.pack("!H", kind) + payload


def ip4(proto, l4, total=None, fragment=0):
    return struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(l4) if total is None else total, 1, fragment, 64, proto, 0, bytes([192, 168, 1, 1]), bytes([8, 8, 8, 8])) + l4


def ip6(nxt, payload, length=None):
    one = bytes(15) + b"\1"
    return struct.pack("!IHBB", 6 << 28 | 3 << 20 | 5, len(payload) if length is None else length, nxt, 64) + one + b"\x20\x01\x0d\xb8" + bytes(10) + b"\0\2" + payload


def tcp(options=b"", flags=0x10):
    return struct.pack("!HHIIBBHHH", 80, 443, 0xDEADBEEF, 2, (5 + len(options) // 4) << 4, flags, 100, 0, 0) + options


def udp(s, d, p):
    return struct.pack("!HHHH", s, d, 8 + len(p), 0) + p


def ext(nxt, n=1):
    return b"".join(bytes([60 if i < n - 1 else nxt, 0]) + bytes(6) for i in range(n))


def u4(s, d, p):
    return eth(0x0800, ip4(17, udp(s, d, p)))


FRAMES = {
    "tcp": eth(0x0800, ip4(6, tcp())),
    "syn": eth(0x0800, ip4(6, tcp(SYN_OPTIONS, 2))),
    "vlan_dns": eth(0x0800, ip4(17, udp(12345, 53, QUERY)), bytes.fromhex("81000064")),
    "qinq": eth(0x0800, ip4(6, tcp()), bytes.fromhex("88a80001 81000002")),
    "dhcp": u4(68, 67, b"\1" + bytes(235) + bytes.fromhex("63825363")),
    "ntp": u4(123, 123, b"\x23" + bytes(47)),
    "mdns": u4(5353, 5353, QUERY),
    "mdns_underscore": u4(5353, 5353, bytes.fromhex("000001000001000000000000") + b"\x05_http\x05local\x00\x00\x01\x00\x01"),
    "dns_loop": u4(1, 53, bytes.fromhex("000001000001000000000000") + b"\xc0\x0c\x00\x01\x00\x01"),
    "dns_pointer": u4(1, 53, bytes.fromhex("000001000002000000000000") + b"\x01a\x01b\x00\x00\x01\x00\x01\xc0\x0e\x00\x02\x00\x01"),
    "dns_line_end": u4(1, 53, bytes.fromhex("000001000001000000000000") + b"\x04abc\n\x00\x00\x01\x00\x01"),
    "dns_next_line": u4(1, 53, bytes.fromhex("000001000001000000000000") + b"\x04abc\x85\x00\x00\x01\x00\x01"),
    "dns_label_50": u4(1, 53, bytes.fromhex("000001000001000000000000") + b"\x32" + b"2" * 50 + b"\x01b\x00\x00\x01\x00\x01"),
    "dns_root": u4(1, 53, bytes.fromhex("000001000001000000000000") + b"\x00\x00\x02\x00\x01"),
    "dns_cut": u4(1, 53, bytes.fromhex("000001000001000000000000") + b"\x03www\x00\x00\x02\x00"),
    "dns_none": u4(1, 53, bytes.fromhex("000081800000000100000000") + b"\x00" * 12),
    "dns_long_label": u4(1, 53, bytes.fromhex("000001000001000000000000") + b"\x40" + b"a" * 64 + b"\x00\x00\x01\x00\x01"),
    "gre": eth(0x0800, ip4(47, bytes.fromhex("00000800"))),
    "vxlan": u4(1, 4789, bytes.fromhex("0800000000006400")),
    "geneve": u4(1, 6081, bytes.fromhex("0000655800006500")),
    "wireguard": u4(51820, 51821, b"\2" + bytes(91)),
    "wireguard_short": u4(51820, 1, b"\1" + bytes(39)),
    "ah": eth(0x0800, ip4(51, bytes.fromhex("3a040000 11223344 00000009"))),
    "esp": eth(0x0800, ip4(50, bytes.fromhex("aabbccdd 00000002"))),
    "ethernet_over_sll": bytes.fromhex("000000010006 0607 08090a0b") + b"\x08\x00" + ip4(6, tcp()),
    "sll": bytes.fromhex("00000001000600000000000100000800") + ip4(17, udp(1, 2, b"x")),
    "sll2": bytes.fromhex("0800000000000001000100060200000000010000") + ip4(17, udp(1, 2, b"x")),
    "sll2_taken_for_ethernet": bytes.fromhex("080000000000000100010006 0800 0000 0001 0000") + ip4(17, udp(1, 2, b"x")),
    "lldp_taken_for_sll2": bytes.fromhex("080027000001020000000002 88cc") + bytes(40),
    "lldp": eth(0x88CC, b"\2\7"),
    "pppoe": eth(0x8863, bytes.fromhex("1109 0000 0004") + b"abcd"),
    "mpls": eth(0x8847, struct.pack("!I", 16 << 12 | 1 << 8 | 64) + b"zz"),
    "icmp": eth(0x0800, ip4(1, bytes.fromhex("0800000000010002"))),
    "icmpv6": eth(0x86DD, ip6(58, bytes.fromhex("8000000000010002"))),
    "igmp": eth(0x0800, ip4(2, bytes.fromhex("11000000e0000001"))),
    "fragment": eth(0x0800, ip4(17, udp(1, 2, b"x" * 8), fragment=0x2001)),
    "truncated": eth(0x0800, ip4(6, tcp(), total=100)),
    "truncated_udp": eth(0x0800, ip4(17, struct.pack("!HHHH", 1, 2, 50, 0), total=100)),
    "total_0": eth(0x0800, ip4(6, tcp(), total=0)),
    "padded": eth(0x0800, ip4(17, udp(1, 2, b"x")) + bytes(17)),
    "v6_fragment": eth(0x86DD, ip6(44, bytes([17, 0, 0, 8, 0, 0, 0, 1]) + bytes(8))),
    "v6_8": eth(0x86DD, ip6(60, ext(6, 8) + tcp())),
    "v6_7": eth(0x86DD, ip6(60, ext(6, 7) + tcp())),
    "v6_ah": eth(0x86DD, ip6(51, bytes([6, 1]) + bytes(10) + tcp())),
    "v6_long": eth(0x86DD, ip6(6, tcp(), length=500)),
    "v6_ext_cut": eth(0x86DD, ip6(60, b"\6")),
    "arp": eth(0x0806, bytes.fromhex("0001 0800 06 04 0001 020000000002 c0a80164 000000000000 c0a80101")),
    "arp_bad": eth(0x0806, bytes.fromhex("0001 0800 08 04 0001") + bytes(20)),
    "no_payload": ETH + b"\x08\x00",
    "tag_cut": ETH + b"\x81\x00\x00",
    "tcp_cut": eth(0x0800, ip4(6, tcp()[:10])),
    "tcp_bad": eth(0x0800, ip4(6, tcp()[:12] + b"\x40" + tcp()[13:])),
    "udp_bad": eth(0x0800, ip4(17, struct.pack("!HHHH", 1, 2, 7, 0))),
    "version": eth(0x0800, b"\x65" + ip4(6, tcp())[1:]),
    "empty": b"",
    "null": None,
}


def rows(spark, names, config=ParseConfig()):
    df = spark.createDataFrame([(n, None if FRAMES[n] is None else bytearray(FRAMES[n])) for n in names], "name string, data binary")
    return {r["name"]: r.asDict(True) for r in decode(df, config=config).collect()}


@pytest.fixture(scope="module")
def got(spark):
    return rows(spark, FRAMES)


ERRORS = {
    **dict.fromkeys(("truncated_udp", "total_0", "v6_long", "v6_ext_cut", "no_payload", "tag_cut", "tcp_cut", "empty"), "InvalidLength"),
    **dict.fromkeys(("arp_bad", "tcp_bad", "udp_bad", "version", "lldp_taken_for_sll2"), "InvalidHeader"),
    "sll2_taken_for_ethernet": "InvalidHeader",
}


def test_errors_blank_the_row(got):
    for name, r in got.items():
        if name == "null":
            continue
        assert (r["error"] or {}).get("kind") == ERRORS.get(name), name
        if r["error"]:
            assert not any(v for k, v in r.items() if k not in ("name", "data", "error")), name
    assert not any(v for k, v in got["null"].items() if k != "name")


WARNINGS = {
    "gre": ["gre-inner"], "vxlan": ["vxlan-inner"], "geneve": ["geneve-inner"], "ah": ["ah-inner"], "esp": ["esp-inner"], "lldp": ["unsupported-ethertype"], "pppoe": ["pppoe-no-payload"],
    "mpls": ["mpls-inner"], "fragment": ["ipv4-fragmented"], "truncated": ["ipv4-truncated"], "v6_fragment": ["ipv6-non-initial-fragment"], "v6_8": ["ipv6-ext-depth-limit"],
}


def test_warnings(got):
    for name, r in got.items():
        assert [w["subcode"] for w in r["warnings"]] == WARNINGS.get(name, []), name
    w = got["lldp"]["warnings"][0]
    assert (w["protocol"], w["offset"], w["ethertype"]) == ("link", 12, 0x88CC)
    assert got["v6_fragment"]["warnings"][0]["offset"] == 14 + 48
    assert got["gre"]["warnings"][0]["offset"] == 34


def test_transport(got):
    t = got["syn"]["transport"]["tcp"]
    assert t["sequence_number"] == 0xDEADBEEF and t["flags"]["syn"] and not t["flags"]["ack"] and t["options"] == bytearray(SYN_OPTIONS)
    assert got["syn"]["tcp_options"] == {"mss": 1460, "window_scale": 7, "sack_permitted": True, "ts_val": 100, "ts_ecr": 0}
    assert got["tcp"]["tcp_options"] == {"mss": None, "window_scale": None, "sack_permitted": False, "ts_val": None, "ts_ecr": None}
    assert got["tcp"]["ipv4"]["options"] is None and got["tcp"]["ipv4"]["source"] == "192.168.1.1"
    for name in ("v6_7", "v6_ah", "truncated", "qinq", "ethernet_over_sll"):
        assert got[name]["transport"]["kind"] == "tcp", name
    for name in ("v6_8", "v6_fragment"):
        assert got[name]["transport"] is None
    assert got["v6_ah"]["ah"] is None and got["ah"]["ah"]["spi"] == 0x11223344
    assert got["padded"]["transport"]["udp"]["length"] == 9


def test_tcp_options(spark):
    """Against a walk over the bytes: the last of a kind counts, a broken option or an end stops."""
    import random

    from packetloom.operators.transport import tcp_options
    from pyspark.sql import functions as F

    def walked(o):
        out, at = {"mss": None, "window_scale": None, "sack_permitted": False, "ts_val": None, "ts_ecr": None}, 0
        while o is not None and at < len(o) and o[at]:
            if o[at] == 1:
                at += 1
                continue
            if at + 2 > len(o) or o[at + 1] < 2 or at + o[at + 1] > len(o):
                break
            n, data = o[at + 1], o[at + 2 :]
            if o[at] == 2 and n >= 4:
                out["mss"] = int.from_bytes(data[:2])
            elif o[at] == 3 and n >= 3:
                out["window_scale"] = data[0]
            elif o[at] == 4:
                out["sack_permitted"] = True
            elif o[at] == 8 and n >= 10:
                out["ts_val"], out["ts_ecr"] = int.from_bytes(data[:4]), int.from_bytes(data[4:8])
            at += n
        return out

    r = random.Random(7)
    cases = [None, b"", SYN_OPTIONS, b"\x02", b"\x02\x03\x00", b"\x01\x00\x04\x02"]
    for _ in range(1500):
        o = b"".join(r.choice([b"\1", b"\2\4\x05\xb4", b"\3\3\7", b"\4\2", b"\x08\x0a" + r.randbytes(8), b"\5\x0a" + r.randbytes(8), b"\2\6" + r.randbytes(4), r.randbytes(2), b"\xfe\3\0"]) for _ in range(r.randint(1, 9)))
        cases.append(o[: r.choice([len(o), len(o), r.randint(0, 40)])][:40])
    df = spark.createDataFrame([(None if o is None else bytearray(o),) for o in cases], "o binary")
    for row in df.select("o", tcp_options(F.col("o")).alias("x")).collect():
        assert row["x"].asDict() == walked(None if row["o"] is None else bytes(row["o"])), row["o"]


def test_link(got):
    assert got["qinq"]["ethernet"]["vlan_tags"] == [1, 2] and got["qinq"]["ethernet"]["payload_offset"] == 22
    assert got["ethernet_over_sll"]["ethernet"]["payload_offset"] == 14
    assert (got["sll"]["ethernet"]["payload_offset"], got["sll2"]["ethernet"]["payload_offset"]) == (16, 20)
    assert got["sll"]["ethernet"]["source"] == bytearray(6)
    assert got["arp"]["arp"]["operation"] == "Request" and got["arp"]["arp"]["target_protocol_addr"] == "192.168.1.1"
    assert got["mpls"]["mpls"]["labels"] == [{"label": 16, "exp": 0, "bottom_of_stack": True, "ttl": 64}]


def test_ipv6_text(got):
    assert (got["icmpv6"]["ipv6"]["source"], got["icmpv6"]["ipv6"]["destination"]) == ("::1", "2001:db8::2")
    assert got["icmpv6"]["ipv6"]["traffic_class"] == 3 and got["icmpv6"]["ipv6"]["flow_label"] == 5


def test_applications(got):
    name = lambda n: [q["qname"] for q in (got[n]["dns"] or {"questions": []})["questions"]]
    assert got["vlan_dns"]["udp_hints"] == ["dns"] and name("vlan_dns") == ["www.example.com"]
    assert got["mdns"]["udp_hints"] == ["mdns"] and name("mdns") == ["www.example.com"]
    assert got["mdns_underscore"]["udp_hints"] == ["mdns"] and got["mdns_underscore"]["dns"] is None
    assert got["dns_loop"]["udp_hints"] == ["dns"] and got["dns_loop"]["dns"] is None and got["dns_long_label"]["dns"] is None
    assert name("dns_pointer") == ["a.b", "b"]
    assert got["dns_line_end"]["dns"] is None and got["dns_next_line"]["dns"] is None and got["dns_cut"]["dns"] is None
    assert name("dns_label_50") == ["2" * 50 + ".b"] and got["dns_root"]["dns"]["questions"] == [{"qname": "", "qtype": 2, "qclass": 1}]
    assert got["dns_none"]["dns"]["header"] == {"transaction_id": 0, "flags": 0x8180, "questions": 0, "answers": 1, "authorities": 0, "additionals": 0} and name("dns_none") == []
    assert got["dhcp"]["udp_hints"] == ["dhcp"] and got["ntp"]["udp_hints"] == ["ntp"]
    assert got["wireguard"]["wireguard"]["message_type"] == "handshake-response" and got["wireguard"]["udp_hints"] == ["wireguard"]
    assert got["wireguard_short"]["wireguard"] is None and got["wireguard_short"]["udp_hints"] == []
    assert got["vxlan"]["vxlan"]["vni"] == 100 and got["geneve"]["geneve"]["vni"] == 101


def test_strict_and_limits(spark):
    strict = rows(spark, ["lldp", "truncated", "tcp"], ParseConfig(mode="strict"))
    assert strict["lldp"]["error"] == {"kind": "ValidationError", "proto_id": None, "detail": "unsupported ethertype: 0x88cc"}
    assert strict["truncated"]["error"]["kind"] == "InvalidLength" and strict["tcp"]["error"] is None
    none = rows(spark, ["v6_7"], ParseConfig(max_ipv6_extension_headers=0))["v6_7"]
    assert [w["subcode"] for w in none["warnings"]] == ["ipv6-ext-depth-limit"] and none["warnings"][0]["offset"] == 54


def test_plan_is_narrow_and_native(spark):
    df = decode(spark.createDataFrame([(bytearray(b"x"),)], "data binary"))
    plan = df.groupBy("ipv4.source").count()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "sll" not in df.select("data")._jdf.queryExecution().optimizedPlan().toString()
