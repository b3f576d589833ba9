"""Header views: scalar access to one header at the start of a BINARY value.

A view is a SQL expression over a parameter ``b`` that gives a struct of accessors, or NULL
where its guard fails (the guards are the views' own and partly differ from the decoders').
``view("ipv4", "data")`` is the Column; ``register(spark)`` makes temporary SQL functions
``view_ipv4(b)`` and so on, which the optimizer inlines.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _n(at: int | str, size: int, kind: str = "int") -> str:
    return f"cast(conv(hex(substring(b, {at} + 1, {size})), 16, 10) as {kind})"


def _u8(at) -> str:
    return _n(at, 1)


def _u16(at) -> str:
    return _n(at, 2)


def _high(at) -> str:
    """The high half of a byte."""
    return f"shiftright({_u8(at)}, 4)"


def _raw(at, size) -> str:
    return f"substring(b, {at} + 1, {size})"


def _tail(at) -> str:
    return f"substring(b, {at} + 1, length(b))"


def _v4(at: int) -> str:
    return "concat_ws('.', " + ", ".join(f"cast({_u8(at + i)} as string)" for i in range(4)) + ")"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _view(guard: str, **fields: str) -> str:
    return f"CASE WHEN {guard} THEN {_struct(**fields)} END"


_LEN = "length(b)"
_IHL = f"({_u8(0)} & 15) * 4"
_WALK = (  # (ethertype, offset, tags, short) behind VLAN tags
    f"aggregate(sequence(0, greatest(0, cast(({_LEN} - 14) div 4 as int))), named_struct('t', {_u16(12)}, 'o', 14, 'g', cast(array() as array<int>), 's', false), "
    "(a, i) -> CASE WHEN a.s OR a.t NOT IN (33024, 34984) THEN a "
    f"WHEN {_LEN} < a.o + 4 THEN named_struct('t', a.t, 'o', a.o, 'g', a.g, 's', true) "
    f"ELSE named_struct('t', {_u16('(a.o + 2)')}, 'o', a.o + 4, 'g', concat(a.g, array({_u16('a.o')})), 's', false) END)"
)
_ICMP = {"icmp_type": _u8(0), "icmp_code": _u8(1), "checksum": _u16(2), "payload": _tail(4)}

VIEWS: dict[str, str] = {
    "ethernet": f"transform(array(CASE WHEN {_LEN} >= 14 THEN {_WALK} END), w -> CASE WHEN NOT w.s THEN "
    + _struct(destination=_raw(0, 6), source=_raw(6, 6), ethertype="w.t", has_vlan="size(w.g) > 0", vlan_depth="least(size(w.g), 255)", outer_vlan_tag="get(w.g, 0)", inner_vlan_tag="get(w.g, 1)", payload=_tail("w.o"))
    + " END)[0]",
    "ipv4": _view(
        f"{_LEN} >= 20 AND {_high(0)} = 4 AND {_u8(0)} & 15 >= 5 AND {_LEN} >= {_IHL} AND {_u16(2)} >= {_IHL} AND {_u16(2)} <= {_LEN}",
        protocol=_u8(9), source=_v4(12), destination=_v4(16), payload=_raw(f"({_IHL})", f"{_u16(2)} - {_IHL}"),
    ),
    "ipv6": _view(f"{_LEN} >= 40 AND {_high(0)} = 6 AND 40 + {_u16(4)} <= {_LEN}", next_header=_u8(6), source=_raw(8, 16), destination=_raw(24, 16), payload=_raw(40, _u16(4))),
    "udp": _view(f"{_LEN} >= 8 AND {_u16(4)} BETWEEN 8 AND {_LEN}", source_port=_u16(0), destination_port=_u16(2), payload=_raw(8, f"{_u16(4)} - 8")),
    "dhcp": _view(
        f"{_LEN} >= 240 AND hex({_raw(236, 4)}) = '63825363'",
        op=_u8(0), htype=_u8(1), hlen=_u8(2), hops=_u8(3), xid=_n(4, 4, "bigint"), secs=_u16(8), flags=_u16(10),
        ciaddr=_v4(12), yiaddr=_v4(16), siaddr=_v4(20), giaddr=_v4(24), chaddr=_raw(28, 6), options=_tail(240),
    ),
    "gre": _view(f"{_LEN} >= 4", flags_version=_u16(0), protocol_type=_u16(2), payload=_tail(4)),
    "vxlan": _view(f"{_LEN} >= 8", flags=_u8(0), has_vni_flag=f"{_u8(0)} & 8 != 0", vni=_n(4, 3, "bigint"), payload=_tail(8)),
    "arp": _view(
        f"{_LEN} >= 28 AND {_u8(4)} = 6 AND {_u8(5)} = 4",
        operation=_u16(6), sender_hardware_addr=_raw(8, 6), sender_protocol_addr=_v4(14), target_hardware_addr=_raw(18, 6), target_protocol_addr=_v4(24),
    ),
    "dns": _view(
        f"{_LEN} >= 12",
        transaction_id=_u16(0), flags=_u16(2), is_response=f"{_u16(2)} & 32768 != 0", question_count=_u16(4), answer_count=_u16(6), authority_count=_u16(8), additional_count=_u16(10),
    ),
    "tcp": _view(f"{_LEN} >= 20 AND {_high(12)} >= 5 AND {_LEN} >= {_high(12)} * 4", source_port=_u16(0), destination_port=_u16(2), payload=_tail(f"({_high(12)} * 4)")),
    "icmp": _view(f"{_LEN} >= 4", **_ICMP),
    "icmpv6": _view(f"{_LEN} >= 4", **_ICMP),
    "sll": _view(f"{_LEN} >= 16", packet_type=_u16(0), arphrd_type=_u16(2), address_length=_u16(4), protocol=_u16(14), payload=_tail(16)),
    "sll2": _view(f"{_LEN} >= 20", protocol=_u16(0), if_index=_n(4, 4, "bigint"), arphrd_type=_u16(8), packet_type=_u8(10), address_length=_u8(11), payload=_tail(20)),
}


def view(name: str, column: str) -> Column:
    """The view of a column, by name."""
    return F.expr(f"transform(array(`{column}`), b -> {VIEWS[name]})[0]")


def vlan_tag(tci: Column) -> Column:
    """(tci, pcp, dei, vlan_id)"""
    return F.struct(tci.alias("tci"), F.shiftright(tci, 13).bitwiseAND(7).alias("pcp"), (F.shiftright(tci, 12).bitwiseAND(1) == 1).alias("dei"), tci.bitwiseAND(0xFFF).alias("vlan_id"))


def register(spark: SparkSession, prefix: str = "view_") -> list[str]:
    """Temporary SQL functions of all views; their names."""
    for name, sql in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(b BINARY) RETURN {sql}")
    return [prefix + n for n in VIEWS]
