"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of all benchmark items: ``window`` consecutive words, or the
whole of an item with fewer. Patterns of one length form a search: a shift table over
blocks of two words says how far a cursor may jump, a bucket of the pattern's last block
selects patterns where it may not, and the words themselves are compared. Many cursors
walk a batch of documents at once. Documents are not shuffled.

The benchmark goes to the executors in blocks of at most ``block_bytes`` of text, as files
of their own. A worker gathers documents of some bytes, then loads one block after the other
and searches what it has gathered, so no row or item is left out and no worker holds more
than one block's tables.

Rows: one for each input row, whatever its doc_id (repeated or null). Null texts have no
words; very long ones are searched like any other, in time linear in their words and hits;
empty items have no window. Items that share an item_id count once; a null item_id is the
empty string. No documents: no rows; no items: nothing is hit. Extra columns stay out of the
way.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import _engine as E

WINDOW = 10
BLOCK_BYTES = 8 << 20
LANE = 256
#: Bytes of documents that a worker gathers for each walk through several blocks.
GATHERED_BYTES = 16 << 20


class WordSearch:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, patterns: list[tuple[bytes, ...]], items: list[list[str]]):
        self.patterns, self.items, self.length = patterns, items, len(patterns[0])
        self.block = min(2, self.length)
        self.hashes = np.array([_hashes(p) for p in patterns], np.uint64)
        self.mask = np.uint64((1 << max(12, (4 * len(patterns) * self.length).bit_length())) - 1)
        self.shift = np.full(int(self.mask) + 1, self.length - self.block + 1, np.int64)
        for end in range(self.block - 1, self.length):
            slot = (self.blocks(self.hashes, end) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, slot, self.length - 1 - end)
        last = self.blocks(self.hashes, self.length - 1)
        self.order = np.argsort(last, kind="stable")
        self.last = last[self.order]

    def blocks(self, hashes: np.ndarray, end) -> np.ndarray:
        """Hash of the block that ends at a word."""
        out = hashes[..., end]
        if self.block == 2:
            out = E.mixed(hashes[..., end - 1] * np.uint64(0xA0761D6478BD642F) + out)
        return out

    def occurrences(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern of each place where all words' hashes agree."""
        starts, found = [], []
        at = np.arange(self.length - 1, len(hashes), LANE)
        stop = np.minimum(at + LANE, len(hashes))
        while len(at):
            block = self.blocks(hashes, at)
            jump = self.shift[(block & self.mask).astype(np.int64)]
            here = np.flatnonzero(jump == 0)
            if len(here):
                low, high = (np.searchsorted(self.last, block[here], side) for side in ("left", "right"))
                many = high - low
                end = np.repeat(at[here], many)
                which = self.order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
                same = np.ones(len(end), bool)
                for i in range(self.length):
                    same[same] = hashes[end[same] - i] == self.hashes[which[same], self.length - 1 - i]
                starts.append(end[same] - self.length + 1)
                found.append(which[same])
            at = at + np.maximum(jump, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        none = np.empty(0, np.int64)
        return np.concatenate(starts or [none]), np.concatenate(found or [none])


def _hashes(pattern: tuple[bytes, ...]) -> np.ndarray:
    data = np.frombuffer(b"".join(pattern), np.uint8)
    ends = np.cumsum([len(w) for w in pattern])
    return E.word_hash(data, ends - [len(w) for w in pattern], ends)


def words_of(text: str | None) -> list[bytes]:
    data = E.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = E.words(data, np.array([0, len(data)]), E.NOT_ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def searches(items: list[tuple[str, str]], window: int = WINDOW) -> list[WordSearch]:
    """Searches for the windows of (item_id, text) pairs, one for each length of window."""
    by: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            by[tuple(w[i : i + window])].add(item)
    lengths: dict[int, list] = defaultdict(list)
    for pattern, names in by.items():
        lengths[len(pattern)].append((pattern, sorted(names)))
    return [WordSearch([p for p, _ in x], [n for _, n in x]) for _, x in sorted(lengths.items())]


def _found(table: WordSearch, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and pattern of the occurrences within one text, words compared byte by byte."""
    first, which = table.occurrences(hashes)
    if len(first):
        text = E.owner(at)
        inside = text[first] == text[first + table.length - 1]
        first, which = first[inside], which[inside]
    if not len(first):
        return first, which
    raw = part.tobytes()
    sure = [all(raw[starts[i + j] : ends[i + j]] == w for j, w in enumerate(table.patterns[p])) for i, p in zip(first.tolist(), which.tolist())]
    return first[sure], which[sure]


class _Hits:
    """What was found in some texts: words hit as disjoint spans, and items."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(offsets) - 1
        self.count = np.zeros(n, np.int64)
        self.spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (text, from, to)
        self.items: list[set[str]] = [set() for _ in range(n)]

    def search(self, tables: list[WordSearch]) -> None:
        for a, b in E.slices(self.offsets):
            part = E.LOWER[self.data[self.offsets[a] : self.offsets[b]]]
            starts, ends, at = E.words(part, self.offsets[a : b + 1] - self.offsets[a], E.NOT_ALNUM)
            hashes, text = E.word_hash(part, starts, ends), E.owner(at)
            self.count[a:b] = np.diff(at)
            for table in tables:
                first, which = _found(table, part, starts, ends, at, hashes)
                if not len(first):
                    continue
                own = text[first]
                self.spans.append((own + a, first - at[own], first - at[own] + table.length))
                for row, p in set(zip(own.tolist(), which.tolist())):
                    self.items[a + row].update(table.items[p])

    def merged(self) -> pa.ListArray:
        """Disjoint spans in order, by text: from, to, from, to ..."""
        none = np.empty(0, np.int64)
        text, a, b = (np.concatenate(x) for x in zip(*self.spans, (none, none, none)))
        order = np.lexsort((a, text))
        text, a, b = text[order], a[order], b[order]
        if len(text):
            # within a text, where a start lies beyond all ends before it; texts lie far apart
            far = text * (int(b.max()) + 1)
            reach = np.maximum.accumulate(far + b)
            new = np.concatenate([[True], (far + a)[1:] > reach[:-1]])
            last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
            a, b, text = a[new], (reach - far)[last], text[new]
        many = 2 * np.bincount(text, minlength=len(self.items))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(np.stack([a, b], axis=1).reshape(-1)))


def _once(held):
    """A broadcast's value, of which this process keeps nothing."""
    value = held.value
    held.__dict__.pop("_value", None)
    return value


def _searched(batches, blocks: list, text: str | int = "text"):
    """(batch, its _Hits) of all batches, one block's tables at a time; text: its column."""
    alone = blocks[0].value if len(blocks) == 1 else None
    gathered: list[tuple[pa.RecordBatch, _Hits]] = []

    def walked():
        for held in blocks:
            tables = _once(held) if alone is None else alone
            for _, hits in gathered:
                hits.search(tables)
            del tables
        yield from gathered

    size = 0
    for batch in batches:
        data, offsets = E.text_bytes(batch.column(text))
        gathered.append((batch, _Hits(data, offsets)))
        size += len(data)
        if alone is not None or size >= GATHERED_BYTES:
            yield from walked()
            gathered, size = [], 0
    yield from walked()


def _blocks(documents: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """Broadcast tables of each block of the benchmark."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    out = []
    for i in range(n):
        block = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        out.append(documents.sparkSession.sparkContext.broadcast(searches([tuple(r) for r in block.collect()], window)))
    return out


FOUND = "doc_id long, n_words long, hit_spans array<long>, hit_items array<string>"


def find_benchmark(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, hit_spans (disjoint, in order: word from, to, from, to ...) and
    hit_items (sorted) of each document."""
    blocks = _blocks(documents, benchmark, window, block_bytes)

    def scan(batches):
        for batch, hits in _searched(batches, blocks):
            names = pa.array([sorted(x) for x in hits.items], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hits.count), hits.merged(), names], ["doc_id", "n_words", "hit_spans", "hit_items"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, FOUND)


def _digest(found: DataFrame) -> DataFrame:
    """n_hit and the items' digest of what find_benchmark gives."""

    def scan(batches):
        for batch in batches:
            spans = batch.column("hit_spans")
            flat, cut = spans.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum([len(x) for x in spans])]) // 2
            sums = np.concatenate([[0], np.cumsum(flat[1::2] - flat[::2])])
            hit = sums[cut[1:]] - sums[cut[:-1]]
            names = batch.column("hit_items").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()), pa.array(hit > 0),
            ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return found.mapInArrow(scan, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    return _digest(find_benchmark(documents, benchmark, window, block_bytes))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """documents, all columns, without rows that hold a window of the benchmark."""
    blocks = _blocks(documents, benchmark, window, block_bytes)
    # each text goes to Python and back once; "text" itself before a name of other case
    at = min((c != "text", i) for i, c in enumerate(documents.columns) if c.lower() == "text")[1]

    def keep(batches):
        for batch, hits in _searched(E.portions(batches), blocks, at):
            yield batch.filter(pa.array([not x for x in hits.items], pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
