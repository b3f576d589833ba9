"""What the operators of this package share.

* ``read``/``stored``/``removed``: tables in, intermediate tables out to the shared folder
  and away when nothing reads them any more.
* ``text_bytes``, ``words``, ``word_hash`` ...: whole texts as NumPy arrays, without a
  Python object per word.
* ``deal``/``ask``: documents are dealt to chunks of bounded bytes once; a chunk asks the
  whole corpus about hashes in packed messages (sorted, delta coded) and gets packed
  answers. One hash costs a few shuffled bytes, a chunk sends each hash once however often
  it holds it, so a hot hash is pre-aggregated before the shuffle.
"""

from __future__ import annotations

import atexit
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that NumPy works on at once, so that its arrays stay in the processor's cache;
#: a longer document is worked on alone.
SLICE_BYTES = 1 << 18
#: Bytes of a batch that ``portions`` hands out at once, whatever the batch's size.
PORTION_BYTES = 4 << 20
#: Bytes of text that make a chunk (and a range of keys), so that neither grows with the corpus.
CHUNK_BYTES = 48 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


@lru_cache(None)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="loom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, an own one, in local mode only:
    on a cluster each executor would write to its own disk and reads would miss the rest."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master or ""
    if not found and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or f"file://{_own_folder()}").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/loom-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_made, spark)
    _made.add(path)
    return path


#: Paths in the shared folder that this process has made and not yet removed.
_made: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _made.discard(path)


def _remove_made(spark: SparkSession) -> None:
    """What lazy results still needed goes with the session."""
    try:
        for path in list(_made):
            _delete(spark, path)
    except Exception:  # noqa: BLE001  the JVM may be gone already
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts the lineage durably."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def removed(df: DataFrame) -> None:
    """Takes a stored table away, once no later read needs it."""
    _delete(df.sparkSession, df._stored_at)


#: Bits of the map by which ``parted`` tells rows apart: 8 MB, whatever the input.
MAP_BITS = 1 << 26


def parted(rows: DataFrame, keys: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those that may have one of the keys (all that do are among them, and
    few others while keys are far fewer than MAP_BITS), and those that have none. A join of
    the first part need not move the second."""
    bit = F.pmod(F.xxhash64(*names), F.lit(MAP_BITS))
    piece = keys.select(bit.alias("_p")).groupBy(F.shiftright("_p", 15).alias("_b")).agg(F.bitmap_construct_agg(F.col("_p") % 32768).alias("_m"))
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for b, m in piece.collect():  # 2048 pieces of 4 KB at most
        bits[b * 4096 : (b + 1) * 4096] = np.frombuffer(m, np.uint8)
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def split(wanted: bool) -> DataFrame:
        def scan(batches):
            for batch in batches:
                at = batch.column("_p").to_numpy()
                yield batch.filter(pa.array((held.value[at >> 3] >> (at & 7) & 1 == 1) == wanted))

        marked = rows.withColumn("_p", bit)
        return marked.mapInArrow(scan, marked.schema).drop("_p")

    return split(True), split(False)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- texts as arrays


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and n + 1 offsets. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids(column) -> np.ndarray:
    """Document ids for comparisons; null counts as the smallest."""
    return pc.fill_null(column.cast(pa.int64()), -(2**63)).to_numpy(zero_copy_only=False)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; every row is in one."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def portions(batches) -> Iterator[pa.RecordBatch]:
    """All rows of the batches in order, about PORTION_BYTES at a time, so that what a scan makes of
    them does not grow with a batch. Rows are not copied."""
    for batch in batches:
        step = max(1, len(batch) * PORTION_BYTES // max(1, batch.nbytes))
        for first in range(0, len(batch), step):
            yield batch.slice(first, step)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


mixed = _mixed
_BASE = 0x9E3779B97F4A7C15
_BYTE = _mixed(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base, np.ones(1, U64))
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
        _POWERS[base] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which ``span_hash`` has the hash of any span."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span; equal bytes, equal hash, wherever they are."""
    back = _powers(pow(_BASE, -1, 1 << 64), len(sums))
    return _mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64) * U64(0xC2B2AE3D27D4EB4F))


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], U64)
_LONG_WORD = 64


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, for words and lines of any make: eight bytes at a
    time are mixed in, so no structure of a long text cancels out as it may in a running sum."""
    out = np.zeros(len(starts), U64)
    if not len(starts):
        return out
    if not data.flags.c_contiguous:
        data = np.ascontiguousarray(data)
    eight = np.frombuffer(np.concatenate([data, np.zeros(8, np.uint8)]).data, np.uint8)
    eight = np.lib.stride_tricks.as_strided(eight[:8].view(U64), (len(data) + 1,), (1,))
    size = ends - starts
    short = size <= _LONG_WORD
    live = np.arange(len(starts)) if short.all() else np.flatnonzero(short)
    h = size[live].astype(U64) * U64(0xC2B2AE3D27D4EB4F)
    at, left = starts[live], size[live]
    while True:
        lane = eight[at] & _MASKS[np.minimum(left, 8)]
        h = _mixed((h ^ lane) * U64(0x9E3779B97F4A7C15) + U64(0xD1342543DE82EF95))
        done = left <= 8
        if done.all():
            out[live] = h
            break
        out[live[done]] = h[done]
        go = ~done
        live, h, at, left = live[go], h[go], at[go] + 8, left[go] - 8
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def gram_hash(sums: np.ndarray, size: int) -> np.ndarray:
    """``span_hash`` of the bytes from every place on, of one size."""
    back = _powers(pow(_BASE, -1, 1 << 64), len(sums))[: len(sums) - size]
    h = sums[size:] - sums[:-size]
    h *= back
    h += U64(size * 0xC2B2AE3D27D4EB4F & (2**64 - 1))
    return _mixed(h)


def separators(pattern: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern)] = True
    return table


#: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
WHITE = separators(b" \t\n\x0b\x0c\r")
NOT_ALNUM = separators(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and n + 1 offsets into them by text. No word crosses texts."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first = np.flatnonzero(starts)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` hashes (those past the end are missing)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    out = hashes[:n].copy()
    for i in range(1, size):
        out *= U64(0xA0761D6478BD642F)
        out += hashes[i : i + n]
    return _mixed(out)


def whole(offsets: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` that start at each item lie in one text; as long as ``windows``."""
    n = int(offsets[-1])
    last = np.repeat(offsets[1:], np.diff(offsets))
    return (np.arange(n) + size <= last)[: max(0, n - size + 1)]


def owner(offsets: np.ndarray) -> np.ndarray:
    """The text of each item."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n items lie in one of the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0


def member(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is among the keys, and where."""
    if not len(sorted_keys):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return sorted_keys[at] == values, at


# ---------------------------------------------------------------- packed messages


@lru_cache(None)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(columns: dict[str, np.ndarray]) -> bytes:
    """Columns of one length. "key" is sorted and becomes differences; bytes of a kind go together."""
    n, body, kinds = len(next(iter(columns.values()))), [], []
    for name, a in columns.items():
        a = np.ascontiguousarray(a)
        if name == "key":
            a = np.diff(a, prepend=a.dtype.type(0))
        kinds.append(f"{name}:{a.dtype.str}")
        # records of bytes (texts) stay as they are
        body.append(a.tobytes() if a.dtype.kind == "V" or not n else a.view(np.uint8).reshape(n, a.dtype.itemsize).T.tobytes())
    head = ";".join(kinds).encode()
    return struct.pack("<IQ", len(head), n) + head + _zstd()[0].compress(b"".join(body))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    size, n = struct.unpack_from("<IQ", blob)
    body, at, out = np.frombuffer(_zstd()[1].decompress(blob[12 + size :]), np.uint8), 0, {}
    for kind in bytes(blob[12 : 12 + size]).decode().split(";"):
        name, dtype = kind.split(":")
        width = np.dtype(dtype).itemsize
        a = body[at : at + n * width]
        a = a.view(dtype) if np.dtype(dtype).kind == "V" else np.ascontiguousarray(a.reshape(width, n).T).view(dtype).reshape(n)
        out[name] = np.cumsum(a, dtype=a.dtype) if name == "key" else a
        at += n * width
    return out


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of int values, by which a shuffle deals them (Murmur3 of four bytes)."""
    turned = lambda v, n: (v << np.uint32(n)) | (v >> np.uint32(32 - n))
    k = turned(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = (turned(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def labels(n: int, tasks: int) -> np.ndarray:
    """n numbers that a shuffle by them deals evenly to so many tasks, n / tasks to each."""
    many = 8 * n + 64
    while True:
        part = _spark_hash(np.arange(many)).astype(np.int64) % tasks
        order = np.argsort(part, kind="stable")
        nth = np.arange(many) - np.searchsorted(part[order], part[order])
        if np.bincount(part, minlength=tasks).min() * tasks >= n + tasks or many > 1 << 26:
            # the first of each task, then the second of each ...
            return order[np.lexsort((part[order], nth))][:n].astype(np.int32)
        many *= 2


@dataclass(frozen=True)
class Dealt:
    """Rows with the chunk of each, and the numbers that name chunks (and ranges of keys)."""

    rows: DataFrame
    labels: np.ndarray

    def with_rows(self, rows: DataFrame) -> Dealt:
        return Dealt(rows, self.labels)


def text_size(df: DataFrame) -> int:
    """Bytes of df's texts: the files' size where the plan knows it, else counted."""
    said = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return said if said < 1 << 56 else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def chunks_of(df: DataFrame) -> int:
    """Into how many chunks df's texts go: each task has one at least."""
    return max(partitions(df.sparkSession), -(-text_size(df) // CHUNK_BYTES))


def named(names: np.ndarray, number: Column) -> Column:
    """The name of a numbered chunk."""
    known = F.split(F.lit(",".join(map(str, names.tolist()))), ",").cast("array<int>")  # folded once
    return F.get(known, number.cast("int"))


def deal(df: DataFrame, key: str = "doc_id") -> Dealt:
    """df with the chunk of each row. Chunks hold about CHUNK_BYTES at most (and are as many as
    partitions at least), evenly filled whatever the ids; all rows of an id share a chunk."""
    names = labels(chunks_of(df), partitions(df.sparkSession))
    return Dealt(df.withColumn("chunk", named(names, F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(len(names))))), names)


MESSAGE, REPLY = "bucket int, chunk int, blob binary", "chunk int, blob binary"


def _bounds(n: int) -> np.ndarray:
    return np.array([(i << 64) // n for i in range(1, n)], U64)


def ask(chunks: Dealt, others: DataFrame | None, emit: Callable, answer: Callable) -> DataFrame:
    """Replies by chunk to what each chunk asks.

    ``emit(chunk's table, replies so far)`` gives columns of one length, "key" sorted.
    They are dealt by ranges of the key. ``answer(columns)`` gets all columns that fell
    in a range, sorted by key, with "chunk" beside them, and gives the columns that go
    back to their chunks.
    """
    names = chunks.labels
    n = len(names)

    def messages(chunk: int, columns: dict[str, np.ndarray]) -> pa.Table:
        cut = [0, *np.searchsorted(columns["key"], _bounds(n)).tolist(), len(columns["key"])]
        full = [b for b in range(n) if cut[b] < cut[b + 1]]
        return pa.table({
            "bucket": pa.array(names[full], pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int32()),
            "blob": pa.array([pack({k: v[cut[b] : cut[b + 1]] for k, v in columns.items()}) for b in full], pa.binary()),
        })

    def asked(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return messages(key[0].as_py(), emit(table, None))

    def asked_again(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        return messages(key[0].as_py(), emit(table, replied(replies)))

    def answered(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [unpack(x) for x in table.column("blob").to_pylist()]
        columns = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        columns["chunk"] = np.repeat(table.column("chunk").to_numpy(), [len(p["key"]) for p in parts])
        parts.clear()
        order = np.argsort(columns["key"], kind="stable")
        out = answer({k: v[order] for k, v in columns.items()})
        to = out.pop("chunk")
        order = np.argsort(to, kind="stable")
        chunks_, first = np.unique(to[order], return_index=True)
        out = {k: v[order] for k, v in out.items()}
        cut = [*first.tolist(), len(order)]
        return pa.table({
            "chunk": pa.array(chunks_, pa.int32()),
            "blob": pa.array([pack({k: v[a:b] for k, v in out.items()}) for a, b in zip(cut, cut[1:])], pa.binary()),
        })

    if others is None:
        sent = chunks.rows.groupBy("chunk").applyInArrow(asked, MESSAGE)
    else:
        sent = chunks.rows.groupBy("chunk").cogroup(others.groupBy("chunk")).applyInArrow(asked_again, MESSAGE)
    return sent.groupBy("bucket").applyInArrow(answered, REPLY)


def replied(replies: pa.Table, having: str = "key") -> dict[str, np.ndarray]:
    """All replies to a chunk that have a column, sorted by key; none: no columns."""
    parts = [p for p in map(unpack, replies.column("blob").to_pylist()) if having in p]
    if not parts:
        return {}
    out = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    order = np.argsort(out["key"], kind="stable")
    return {k: v[order] for k, v in out.items()}


def with_replies(chunks: Dealt, replies: DataFrame, finish: Callable, schema: str, kinds: tuple[str, ...] = ("key",)) -> DataFrame:
    """``finish(chunk's table, its replies)`` for every chunk, replies or none; one argument of
    replies for each of the columns that tell their kinds apart."""

    def both(key: tuple[pa.Scalar, ...], table: pa.Table, said: pa.Table) -> pa.Table:
        return finish(table, *(replied(said, k) for k in kinds))

    return chunks.rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(both, schema)


def grouped(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def run_of(first: np.ndarray, n: int) -> np.ndarray:
    """The run of each of n items."""
    return np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
