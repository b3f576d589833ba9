import struct

import pytest
from pyspark.sql import functions as F

from packetloom.operators import registry, validated
from packetloom.sources import capture, formats
from packetloom.streaming.packets import decoded_stream, talkers


def test_pcap_errors_end_the_walk():
    cut = formats.write_pcap([(1, 2, b"abc")]) + struct.pack("<IIII", 1, 0, 64, 64) + b"0123456789"
    found = list(formats.frames(cut))
    assert [getattr(f, "data", None) or f.kind for f in found] == [b"abc", "InvalidLength"]
    with pytest.raises(formats.CaptureError):
        formats.collect(cut)


@pytest.mark.parametrize("raw, kind", [(b"", "InvalidLength"), (b"abcd", "MalformedPacket"), (b"\xd4\xc3\xb2\xa1", "InvalidLength"), (b"\x0a\x0d\x0d\x0a" + bytes(8), "InvalidLength")])
def test_bad_files(raw, kind):
    (error,) = formats.frames(raw)
    assert error.kind == kind


@pytest.mark.parametrize("order", "<>")
def test_byte_orders_agree(order):
    rows = [(7, 8, b"one"), (9, 10, b"three")]
    assert [f.data for f in formats.collect(formats.write_pcap(rows, order))] == [b"one", b"three"]
    ng = formats.collect(formats.write_pcapng([(7_000_008, b"one")], order), "pcapng")
    assert [(f.ts_sec, f.ts_subsec, f.data) for f in ng] == [(7, 8, b"one")]
    with pytest.raises(formats.CaptureError):
        formats.collect(formats.write_pcap(rows, order), "pcapng")


@pytest.mark.parametrize("byte, ticks", [(9, 10**9), (0x80 | 10, 1024), (20, 10**6), (None, 10**6)])
def test_resolutions(byte, ticks):
    (f,) = formats.collect(formats.write_pcapng([(3 * ticks + 5, b"x")], "<", byte))
    assert (f.ts_sec, f.ts_subsec, f.ticks) == (3, 5, ticks)


def test_a_bad_packet_block_is_passed_over():
    raw = formats.write_pcapng([])
    raw += formats.pcapng_block(6, struct.pack("<IIIII", 0, 0, 0, 99, 99)) + formats.pcapng_block(99, b"?") + formats.pcapng_block(3, struct.pack("<I", 100) + b"abcde")
    found = list(formats.frames(raw))
    assert found[0].kind == "InvalidLength" and found[1].data == b"abcde\0\0\0"
    assert [f.kind for f in formats.frames(formats.pcapng_block(6, bytes(20)))] == ["MalformedPacket"]


def test_read_and_stream(spark, tmp_path):
    frame = bytes(12) + b"\x08\x00" + struct.pack("!BBHHHBBH4s4s", 0x45, 0, 28, 1, 0, 64, 1, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + bytes(8)
    (tmp_path / "a.pcap").write_bytes(formats.write_pcap([(3600, 1, frame), (7300, 2, frame)]))
    (tmp_path / "b.pcapng").write_bytes(formats.write_pcapng([(3600 * 10**6 + 500, frame)]) + b"zz")
    rows = capture.with_time(capture.read_captures(spark, str(tmp_path)))
    assert rows.filter("error is null").count() == 3 and rows.filter("error = 'InvalidLength'").count() == 1
    assert rows.filter("ts = timestamp_micros(3600000500)").count() == 1
    capture.register(spark)
    assert spark.read.format("capture").load(str(tmp_path)).count() == 4
    stream = talkers(decoded_stream(spark, str(tmp_path))).writeStream.format("memory").queryName("talkers_test").outputMode("complete").start()
    stream.processAllAvailable()
    stream.stop()
    assert {(r["source"], r["packets"]) for r in spark.table("talkers_test").collect() if r["source"]} == {("10.0.0.1", 2), ("10.0.0.1", 1)}


def test_validated_layers(spark):
    b = F.col("b")
    rows = [bytes.fromhex(x) for x in ("1600089fe0000160", "2200fff5000000010400000100000000ffffffff", "0800f7fd00010001", "11", "1100eeff0000000000000000", "99ff000000000000")]
    df = spark.createDataFrame([(bytearray(r),) for r in rows], "b binary")
    got = df.select(validated.parse_igmp(b).alias("x"), validated.is_valid_igmp(b).alias("v"), validated.can_parse_icmp(b).alias("c"), validated.hexdump(b).alias("h")).collect()
    kinds = [(r["x"]["error"] or {"kind": None})["kind"] for r in got]
    assert kinds[0] is None and got[0]["x"]["value"]["kind"] == "report-v2" and got[0]["v"]
    assert kinds[3] == "InvalidLength" and kinds[4] == "InvalidLength" and kinds[5] == "UnsupportedProtocol" and got[5]["x"]["error"]["proto_id"] == 0x99
    assert got[3]["h"] == "0000   11" + " " * 46 + "  .\n" and got[2]["c"]
    assert df.select(validated.is_valid_icmp(b).alias("v")).collect()[2]["v"]


def test_registry_limits(spark):
    from packetloom.plans.config import DecodeConfig

    r = registry.Registry()
    df = spark.createDataFrame([(bytearray(b"abcd"),)], "b binary")
    got = df.select(r.decode(F.col("b")).alias("a"), r.decode(F.col("b"), DecodeConfig(max_packet_bytes=3)).alias("c")).first()
    assert got["a"]["matched"] is None and got["a"]["error"] is None
    assert (got["c"]["error"]["needed"], got["c"]["error"]["available"]) == (4, 3)


def test_large_files_are_split(spark, tmp_path):
    """Frames, numbers and the error at the end are those of one task."""
    frames = [(i, i, bytes([i % 256]) * (i % 97)) for i in range(500)]
    (tmp_path / "a.pcap").write_bytes(formats.write_pcap(frames, ">") + b"cut")
    (tmp_path / "b.pcapng").write_bytes(formats.write_pcapng([(i, b"x" * 40) for i in range(100)]))
    capture.register(spark)
    read = lambda every: spark.read.format("capture").option("splitBytes", every).load(str(tmp_path))
    assert read(4000).rdd.getNumPartitions() > 5 > read(1 << 20).rdd.getNumPartitions()
    rows = lambda df: sorted((r["path"], r["frame_no"], r["ts_sec"], r["data"], r["error"] or "") for r in df.collect() if r["data"] is not None or r["error"])
    assert rows(read(4000)) == rows(read(1 << 20)) and len(rows(read(4000))) == 601


def test_stream_finds_names_in_any_order(tmp_path):
    reader = capture._Stream({"path": str(tmp_path)})
    (tmp_path / "m.pcap").write_bytes(formats.write_pcap([(1, 2, b"late")]))
    found, at = reader.read(reader.initialOffset())
    assert [r[5] for r in found] == [b"late"]
    (tmp_path / "a.pcap").write_bytes(formats.write_pcap([(1, 2, b"earlier name")]))
    found, after = reader.read(at)
    assert [r[5] for r in found] == [b"earlier name"] and [r[5] for r in reader.readBetweenOffsets(at, after)] == [b"earlier name"]
    assert list(reader.read(after)[0]) == []


def test_whole_captures_and_dump_offsets(spark):
    df = spark.createDataFrame([("a", bytearray(formats.write_pcap([(1, 2, b"x")]))), ("b", bytearray(b"\xd4\xc3\xb2\xa1")), ("c", None)], "path string, content binary")
    got = {r["path"]: (r["frames"] and len(r["frames"]), r["error"]) for r in capture.whole_captures(df).collect()}
    assert got == {"a": (1, None), "b": (None, "InvalidLength"), "c": (None, "InvalidLength")}
    dump = spark.range(1).select(validated.hexdump(F.unhex(F.repeat(F.lit("00"), 65_560))).alias("h")).first()["h"].split("\n")
    assert dump[4095].startswith("fff0   00") and dump[4096].startswith("10000   00")
