"""Captures as DataFrames.

``read_captures`` lists and reads files with Spark's own ``binaryFile`` reader, so any store
that Spark reaches will do and files can be pruned by path or time; the walk over a file's
bytes runs in Arrow batches on the executors. ``stream_captures`` is the same over new files
of a folder. ``CaptureDataSource`` is a Python data source (batch and stream) for local or
mounted paths: ``spark.read.format("capture").load(path)``.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from packetloom.sources.formats import CaptureError, collect, frames, pcap_cuts

SCHEMA = "path string, frame_no long, ts_sec long, ts_subsec long, ts_ticks_per_sec decimal(20,0), data binary, error string"
_ARROW = pa.schema([("path", pa.string()), ("frame_no", pa.int64()), ("ts_sec", pa.int64()), ("ts_subsec", pa.int64()), ("ts_ticks_per_sec", pa.decimal128(20, 0)), ("data", pa.binary()), ("error", pa.string())])
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20


def rows_of(path: str, raw: bytes, kind: str | None = None, fail_fast: bool = False, first: int = 0) -> Iterator[tuple]:
    """A row for each frame and for each error, in file order, numbered from ``first``."""
    from decimal import Decimal

    for n, f in enumerate(frames(raw, kind), first):
        if isinstance(f, CaptureError):
            if fail_fast:
                raise ValueError(f"{path}: {f.kind} at frame {n}")
            yield path, n, None, None, None, None, f.kind
        else:
            yield path, n, f.ts_sec, f.ts_subsec, None if f.ticks is None else Decimal(f.ticks), f.data, None


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[5] or b"")
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


def explode_captures(files: DataFrame, kind: str | None = None, fail_fast: bool = False) -> DataFrame:
    """Rows of SCHEMA from (path, content)."""

    def walk(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path"), batch.column("content")):
                yield from _batches(rows_of(path.as_py(), raw.as_py() or b"", kind, fail_fast))

    return files.select("path", "content").mapInArrow(walk, SCHEMA)


def whole_captures(files: DataFrame, kind: str | None = None) -> DataFrame:
    """(path, frames, error) from (path, content): a row for each file. The first error fails the
    file and not the job: its frames are NULL."""
    fields = [pa.field("ts_sec", pa.int64()), pa.field("ts_subsec", pa.int64()), pa.field("data", pa.binary())]

    def read(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path"), batch.column("content")):
                try:
                    found, error = [{"ts_sec": f.ts_sec, "ts_subsec": f.ts_subsec, "data": f.data} for f in collect(raw.as_py() or b"", kind)], None
                except CaptureError as e:
                    found, error = None, e.kind
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([found], pa.list_(pa.struct(fields))), pa.array([error], pa.string())], ["path", "frames", "error"])

    return files.select("path", "content").mapInArrow(read, "path string, frames array<struct<ts_sec: long, ts_subsec: long, data: binary>>, error string")


def read_captures(spark: SparkSession, path: str | list[str], kind: str | None = None, fail_fast: bool = False, **options: str) -> DataFrame:
    """Frames of all captures under path. kind: pcap or pcapng only. fail_fast: the first
    error fails the job; else errors are rows, and frames before them stay."""
    return explode_captures(spark.read.format("binaryFile").options(**options).load(path), kind, fail_fast)


def stream_captures(spark: SparkSession, path: str, kind: str | None = None, **options: str) -> DataFrame:
    """The same over files as they come."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").options(**options).load(path)
    return explode_captures(files, kind)


def with_time(rows: DataFrame) -> DataFrame:
    """With ts: microseconds where the ticks of a second are known (pcapng), else the second
    (pcap does not say whether its parts are micro- or nanoseconds)."""
    part = F.coalesce(F.floor(F.col("ts_subsec") * F.lit(1_000_000).cast("decimal(20,0)") / F.col("ts_ticks_per_sec")).cast("long"), F.lit(0).cast("long"))
    return rows.withColumn("ts", F.timestamp_micros(F.col("ts_sec") * 1_000_000 + part))


#: A larger pcap file is read by several tasks.
SPLIT_BYTES = 64 << 20


class _Range(InputPartition):
    """Bytes of a file from start to end, with so many frames before them."""

    def __init__(self, path: str, start: int, end: int, first: int):
        self.path, self.start, self.end, self.first = path, start, end, first


def _ranges(path: str, every: int) -> Iterator[_Range]:
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        cuts = pcap_cuts(f, size, every) if size > every else [(0, 0)]
    for (start, first), end in zip(cuts, [*(c[0] for c in cuts[1:]), size]):
        yield _Range(path, start, end, first)


def _listed(path: str) -> list[str]:
    path = path.removeprefix("file://")
    found = sorted(glob.glob(path)) if glob.has_magic(path) else [path]
    return [f for p in found for f in (sorted(os.path.join(d, n) for d, _, names in os.walk(p) for n in names if n[0] not in "._") if os.path.isdir(p) else [p])]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = _listed(options["path"])
        self.kind, self.fail_fast = options.get("kind"), options.get("mode", "").upper() == "FAILFAST"
        self.every = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        return [r for p in self.paths for r in _ranges(p, self.every)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            head = f.read(24) if partition.start else b""  # the file's own header tells the byte order
            f.seek(partition.start)
            raw = head + f.read(partition.end - partition.start)
        yield from _batches(rows_of(partition.path, raw, self.kind, self.fail_fast, partition.first))


class _Stream(SimpleDataSourceStreamReader):
    """Files whose names are new since the last offset, in whatever order they come."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self):
        return {"seen": []}

    def _rows(self, paths: list[str]):
        for p in paths:
            with open(p, "rb") as f:
                yield from rows_of(p, f.read(), self.options.get("kind"))

    def read(self, start):
        seen = set(start["seen"])
        paths = [p for p in _listed(self.options["path"]) if p not in seen]
        return self._rows(paths), {"seen": sorted(seen.union(paths))}

    def readBetweenOffsets(self, start, end):
        return self._rows(sorted(set(end["seen"]) - set(start["seen"])))


class CaptureDataSource(DataSource):
    """Options: path; kind (pcap, pcapng); mode (FAILFAST fails at the first error); splitBytes (a
    larger pcap file is read by several tasks)."""

    @classmethod
    def name(cls):
        return "capture"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CaptureDataSource)
