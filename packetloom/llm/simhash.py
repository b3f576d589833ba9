"""SimHash near-dedup with pivot distance tables.

Fingerprints are the bitwise majority of the hashes of all word shingles. Equal
fingerprints become one before any are compared. Those within ``bits`` of each other agree
on two of four 16-bit blocks at least, and on one third of the other 32 bits, so each is
dealt to its 18 pairs of blocks with a third. Within a bucket a table of Hamming distances
to many reference fingerprints (pivots) discards a pair as soon as two coordinates differ by
more than ``bits``; the rest are verified, but for pairs that earlier links have joined. A
bucket passes on a forest of its links, and holds no more than that, never all pairs.

Rows: one for each input row. Null and empty texts have fingerprint zero and are linked
like any other; ties and repeated rows share a fingerprint and so a component; very long
texts are hashed whole. A null doc_id gets a component but never names one (null if nothing
else is in it). No documents: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm import _engine as E
from packetloom.llm._graph import components
from packetloom.llm._xxh64 import xxh64

PIVOTS = E.mixed(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


#: Each bit of a byte in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _ones(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each of 64 bits; runs end where the next begins."""
    size = np.diff(np.append(begins, len(h)))
    parts = -(-size // 255)  # so many hashes fit a sum of bytes
    at = np.cumsum(parts) - parts
    sub = np.repeat(begins, parts) + (np.arange(parts.sum()) - np.repeat(at, parts)) * 255
    octets, out = h.view(np.uint8).reshape(-1, 8), np.empty((len(begins), 64), np.int64)
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[octets[:, k]], sub)
        out[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), at, axis=0, dtype=np.int64)
    return out


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, size: int = 3) -> np.ndarray:
    """The fingerprint of each text (bytes end to end)."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    for a, b in E.slices(offsets):
        part, cut = E.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        starts, ends, at = E.words(part, cut, E.WHITE)
        if not len(starts):
            continue
        length = ends - starts
        # words with one space behind each; shingles are spans of that
        keep = ~E.WHITE[part]
        gap = np.cumsum(length + 1) - 1
        joined = np.full(gap[-1] + 1, 32, np.uint8)
        inside = np.ones(len(joined), bool)
        inside[gap] = False
        joined[inside] = part[keep]
        begin = gap - length
        count = np.diff(at)
        shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
        text = np.repeat(np.arange(b - a), shingles)
        first = at[text] + np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
        last = np.minimum(first + size, at[text + 1]) - 1
        h = xxh64(joined, begin[first], gap[last], 42)
        some = np.flatnonzero(shingles)
        major = _ones(h, (np.cumsum(shingles) - shingles)[some]) * 2 > shingles[some][:, None]
        out[a + some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprints(documents: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp (the 64 bits as a long)."""

    def scan(batches):
        for batch in batches:
            fp = fingerprints_of(*E.text_bytes(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, fp long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n items over pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of links among fingerprints with equal keys (sorted)."""
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    run = E.run_of(E.grouped(key), len(key))
    order = np.lexsort((table[:, 0], run))
    fp, table, run = fp[order], table[order], run[order]
    tree = np.arange(len(fp))  # the least index that links so far reach
    step, alive = 1, np.arange(len(fp))
    while len(alive):
        alive = alive[alive + step < len(fp)]
        other = alive + step
        # sorted by the first coordinate: once it is too far, all later ones are
        near = (run[alive] == run[other]) & (table[other, 0] - table[alive, 0] <= bits)
        alive = alive[near]
        keep, far = alive, other[near]
        apart = tree[keep] != tree[far]
        keep, far = keep[apart], far[apart]
        for k in range(1, table.shape[1]):
            if not len(keep):
                break
            ok = np.abs(table[keep, k] - table[far, k]) <= bits
            keep, far = keep[ok], far[ok]
        ok = np.bitwise_count(fp[keep] ^ fp[far]) <= bits
        if ok.any():
            below = np.flatnonzero(tree != np.arange(len(tree)))
            tree = _forest(len(fp), np.concatenate([below, keep[ok]]), np.concatenate([tree[below], far[ok]]))
        step += 1
    below = np.flatnonzero(tree != np.arange(len(tree)))
    return fp[below], fp[tree[below]]


def _links(bits: int):
    def scan(batches):
        rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

        def found(key, fp):
            size = np.diff(np.append(E.grouped(key), len(key)))
            many = np.repeat(size, size) > 1
            u, v = linked(key[many], fp[many], bits)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], schema=schema)

        for batch in batches:
            key = np.concatenate([rest_key, batch.column("key").to_numpy()])
            fp = np.concatenate([rest_fp, batch.column("fp").to_numpy().view(np.uint64)])
            cut = E.grouped(key)[-1] if len(key) else 0  # the last key may go on
            rest_key, rest_fp = key[cut:], fp[cut:]
            if cut:
                yield found(key[:cut], fp[:cut])
        if len(rest_key):
            yield found(rest_key, rest_fp)

    return scan


def links(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """(u, v): a forest of the links among distinct fingerprints (column fp); spans the same
    components as all links."""
    if bits > 2:
        raise ValueError("blocks are chosen for at most two differing bits")
    block = [F.shiftright("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    keys = []
    for n, (i, j) in enumerate((i, j) for i in range(4) for j in range(i + 1, 4)):
        a, b = (k for k in range(4) if k not in (i, j))
        rest = F.shiftleft(block[a], 16).bitwiseOR(block[b])
        for t, third in enumerate((rest.bitwiseAND(0x7FF), F.shiftright(rest, 11).bitwiseAND(0x7FF), F.shiftright(rest, 22).bitwiseAND(0x3FF))):
            both = F.shiftleft(block[i], 16).bitwiseOR(block[j])
            keys.append(F.shiftleft(F.lit(3 * n + t).cast("long"), 43).bitwiseOR(F.shiftleft(both, 11)).bitwiseOR(third))
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    n = E.partitions(distinct.sparkSession)
    return dealt.repartition(n, "key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_links(bits), "u long, v long")


def near(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs of fingerprints are within ``bits``: those whose distances to any pivot
    differ by more are discarded, the rest are verified."""
    keep = np.arange(len(x))
    for pivot in PIVOTS:
        keep = keep[np.abs(np.bitwise_count(x[keep] ^ pivot).astype(np.int8) - np.bitwise_count(y[keep] ^ pivot).astype(np.int8)) <= bits]
    out = np.zeros(len(x), bool)
    out[keep] = np.bitwise_count(x[keep] ^ y[keep]) <= bits
    return out


def of_sets(keys: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each set of hashes (sets end to end); of none: zero."""
    n = np.diff(offsets)
    out, some = np.zeros(len(n), np.uint64), np.flatnonzero(n)
    if len(some):
        major = _ones(keys, offsets[some]) * 2 > n[some][:, None]
        out[some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def near_duplicates(documents: DataFrame, size: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (smallest doc_id reachable over links)."""
    found = E.stored(fingerprints(documents, size), "simhash")
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), bits))
    member = distinct.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = E.stored(member, "members")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = member.join(named, "root").select("fp", "component_id")
    return found.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, size: int = 3, bits: int = 2) -> DataFrame:
    """documents, all columns: of each component the row with the smallest doc_id (null last,
    ties by a hash of the text; of equal rows any one)."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_d"), F.xxhash64("text").alias("_t")]

    def scan(batches):
        for batch in batches:
            fp = fingerprints_of(*E.text_bytes(batch.column("text")), size)
            yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_t"), pa.array(fp.view(np.int64))], ["_d", "_t", "fp"])

    found = E.stored(documents.select(*key, "text").mapInArrow(scan, "_d long, _t long, fp long"), "simhash")
    distinct = found.groupBy("fp").agg(F.min(F.struct("_d", "_t")).alias("first"))
    roots = components(links(distinct.select("fp"), bits)).withColumnRenamed("vertex", "fp")
    kept = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select("first._d", "first._t")
    once = Window.partitionBy("_d", "_t").orderBy(F.lit(1))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), *key)
    rows = rows.join(kept, ["_d", "_t"]).withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return rows.select("_row.*")
