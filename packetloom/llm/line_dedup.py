"""Line dedup by pairwise patience alignment.

A document's lines are hashed, and each run of lines just long enough to be rare
(``least_words`` words) is a seed: whatever block of that length two documents share, they
share its first run. A seed's first document (by id) is a candidate for every later one
that holds the seed, so a seed of n documents makes n - 1 pairs and not n squared, and no
frequency is too high to be found. Each pair's line hashes are aligned by patience diff;
aligned common blocks of ``least_words`` words are deleted from the later document, and what
is left is aligned again until nothing more is found, so moved blocks are found too. Lines
that the alignment leaves go with any run of so many words that the earlier document has,
so each copy of a passage that either document repeats is found. Only hashes travel to the
pairs, dealt by both documents so that one with thousands of copies is spread over all
tasks; texts are joined once, with the numbers of their deleted lines.

Lines are split at line feeds and compared without outer white space. Deletion is judged
on the input: the earlier document counts whole, whatever is deleted from it.

Rows: one for each input row, all columns kept. Null text stays null, empty text empty; a
document all of whose lines go has the empty text. Documents are ordered by doc_id, null
first, ties by a hash of the text; rows with equal doc_id and text count as one document
and are treated alike. Very long texts are aligned like any other, in time about linear in
their lines. No documents: no rows. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import _engine as E

LEAST_WORDS = 30
#: So many seeds at most are held by documents so numerous that one task should not join them.
MOST_HOT = 10_000
#: The query's: rare single lines are seeds, and only blocks of one or two words stay.
FLOOR_WORDS = 3


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned equal places of two lists, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i >= i2 or j >= j2:
            continue
        in_a, in_b = Counter(a[i:i2]), Counter(b[j:j2])
        at_b = {x: k for k, x in enumerate(b[j:j2], j) if in_b[x] == 1}
        unique = [(k, at_b[x]) for k, x in enumerate(a[i:i2], i) if in_a[x] == 1 and x in at_b]
        # the longest rising chain: piles hold the least last place of chains of each length
        piles: list[int] = []
        top: list[int] = []
        back = [-1] * len(unique)
        for n, (_, y) in enumerate(unique):
            p = bisect_left(piles, y)
            if p == len(piles):
                piles.append(y)
                top.append(n)
            else:
                piles[p], top[p] = y, n
            back[n] = top[p - 1] if p else -1
        n, chain = (top[-1] if top else -1), []
        while n >= 0:
            chain.append(unique[n])
            n = back[n]
        x, y = i, j
        for p, q in chain[::-1]:
            todo.append((x, p, y, q))
            out.append((p, q))
            x, y = p + 1, q + 1
        if chain:
            todo.append((x, i2, y, j2))
    return sorted(out)


def repeated(a: list[int], b: list[int], words: list[int], least_words: int) -> list[int]:
    """Places of b in runs of ``least_words`` words or more that a has anywhere, however often
    either has them: matching statistics over a suffix automaton of a."""
    have = set(a)
    if sum(w for x, w in zip(b, words) if x in have) < least_words:
        return []
    to: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for x in a:
        new = len(to)
        to.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and x not in to[p]:
            to[p][x] = new
            p = link[p]
        if p >= 0:
            q = to[p][x]
            if size[q] > size[p] + 1:
                copy = len(to)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and to[p].get(x) == q:
                    to[p][x] = copy
                    p = link[p]
                link[q] = q = copy
            link[new] = q
        last = new
    total = [0]
    for w in words:
        total.append(total[-1] + w)
    out, state, run, done = [], 0, 0, 0
    for k, x in enumerate(b):
        while state and x not in to[state]:
            state = link[state]
            run = size[state]
        if x in to[state]:
            state, run = to[state][x], run + 1
        if run and total[k + 1] - total[k + 1 - run] >= least_words:
            out += range(max(done, k + 1 - run), k + 1)
            done = k + 1
    return out


def deleted(earlier: list[int], later: list[int], words: list[int], least_words: int) -> list[int]:
    """Numbers of the later document's lines that lie in aligned common blocks."""
    live, gone = list(range(len(later))), []
    while live:
        blocks: list[list[tuple[int, int]]] = []
        for p, q in patience(earlier, [later[k] for k in live]):
            if blocks and blocks[-1][-1] == (p - 1, q - 1):
                blocks[-1].append((p, q))
            else:
                blocks.append([(p, q)])
        found = [live[q] for block in blocks if sum(words[live[q]] for _, q in block) >= least_words for _, q in block]
        # what repeats in either document has no unique line to align it
        left, have = set(found), set(earlier)
        if any(k not in left and later[k] in have for k in live):
            left |= {live[q] for q in repeated(earlier, [later[k] for k in live], [words[k] for k in live], least_words)}
        if not left:
            break
        gone += sorted(left)
        live = [k for k in live if k not in left]
    return gone


def lines_of(data: np.ndarray, offsets: np.ndarray, least_words: int) -> list[tuple[list[int], list[int], list[int]]]:
    """Line hashes, words of each line, and seeds of each text."""
    feeds = np.flatnonzero(data == 10)
    full = offsets[1:] > offsets[:-1]
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    text = np.sort(np.concatenate([np.arange(len(full)), np.searchsorted(offsets, feeds, "right") - 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], feeds]))
    first, last, _ = E.words(data, offsets, E.WHITE)
    a, b = np.searchsorted(first, starts), np.searchsorted(first, ends)
    count = b - a
    some = count > 0
    key = np.zeros(len(starts), np.uint64)
    key[some] = E.word_hash(data, first[a[some]], last[b[some] - 1])
    out: list[tuple[list[int], list[int], list[int]]] = []
    cut = np.searchsorted(text, np.arange(len(full) + 1))
    for i in range(len(full)):
        h, n = key[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]
        total = np.concatenate([[0], np.cumsum(n)])
        # the shortest run from each line with words on; none where the rest is too short
        to = np.searchsorted(total, total[:-1] + least_words)
        begin = np.flatnonzero((to < len(total)) & (n > 0))
        seeds = []
        for k in begin.tolist():
            seed = 0
            for x in h[k : to[k]].tolist():
                seed = ((seed ^ x) * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)
            seeds.append(seed)
        out.append((h.view(np.int64).tolist(), n.tolist(), list(set(seeds))))
    return out


def _identity(df: DataFrame) -> DataFrame:
    """With _d and _t, which order and tell apart documents."""
    return df.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("_t", F.xxhash64("text"))


def deletions(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(_d, _t, lines): the numbers of the lines to delete, for documents that lose any."""

    def scan(batches):
        for batch in batches:
            data, offsets = E.text_bytes(batch.column("text"))
            out: list = []
            for a, b in E.slices(offsets):
                out += lines_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least_words)
            arrays = [pa.array([r[0] for r in out], pa.list_(pa.int64())), pa.array([r[1] for r in out], pa.list_(pa.int32())), pa.array([np.array(r[2], np.uint64).view(np.int64) for r in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_t"), *arrays], ["_d", "_t", "keys", "words", "seeds"])

    found = _identity(documents.select("doc_id", "text")).select("_d", "_t", "text")
    found = E.stored(found.mapInArrow(scan, "_d long, _t long, keys array<long>, words array<int>, seeds array<long>"), "lines")
    held = found.select(F.struct("_d", "_t").alias("doc"), F.explode("seeds").alias("seed"))
    first = held.groupBy("seed").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).filter("first < last").select("seed", "first", "n")
    first = E.stored(first, "seeds")
    # the seeds that very many documents hold are few: at most MOST_HOT, whatever the input
    total = first.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(first.filter(F.col("n") > max(1000, total // MOST_HOT)).select("seed", "first"))
    rare = first.filter(F.col("n") <= max(1000, total // MOST_HOT)).select("seed", "first")
    pairs = held.join(hot, "seed").unionByName(held.join(rare, "seed")).filter("first < doc").select("doc", "first").distinct()
    # a first document of very many others is sent to as many places as there are partitions
    salt = F.pmod(F.xxhash64("doc"), F.lit(E.partitions(documents.sparkSession))).cast("int")
    pairs = E.stored(pairs.withColumn("salt", salt), "pairs")
    one = found.select(F.struct("_d", "_t").alias("doc"), "keys", "words").dropDuplicates(["doc"])
    earlier = pairs.select("first", "salt").distinct().join(one.select(F.col("doc").alias("first"), F.col("keys").alias("earlier")), "first")
    both = pairs.join(one, "doc").join(earlier, ["first", "salt"])

    def align(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("earlier", "keys", "words")))
            lines = [deleted(e, k, w, least_words) for e, k, w in rows]
            yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_t"), pa.array(lines, pa.list_(pa.int32()))], ["_d", "_t", "lines"])

    cut = both.select("doc._d", "doc._t", "earlier", "keys", "words").mapInArrow(align, "_d long, _t long, lines array<int>")
    # by line first, so that a document of many partners needs no more room than its lines
    cut = cut.select("_d", "_t", F.explode("lines").alias("line")).distinct()
    return cut.groupBy("_d", "_t").agg(F.collect_list("line").alias("lines"))


def line_dedup(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """documents, all columns, with text cut (and n_chars counted anew where it is there)."""
    rows = _cut(documents, least_words)
    of = lambda c: F.col("_row")[c]
    kept = [F.col("_kept").alias("text") if c == "text" else F.when(F.col("_lines").isNull(), of(c)).otherwise(F.length("_kept").cast(t)).alias(c) if c == "n_chars" else of(c).alias(c) for c, t in documents.dtypes]
    return rows.select(kept)


def _cut(documents: DataFrame, least_words: int) -> DataFrame:
    """(_row, doc_id, text, _lines, _kept): whole rows apart, so no name of theirs can clash."""
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    rows = _identity(rows).join(deletions(documents, least_words).withColumnRenamed("lines", "_lines"), ["_d", "_t"], "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_lines", i)), "\n")
    return rows.withColumn("_kept", F.when(F.col("_lines").isNull(), F.col("text")).otherwise(kept))


def report(documents: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, kept_sha256 for every document."""
    text = F.coalesce("text", F.lit(""))
    kept = F.coalesce("_kept", F.lit(""))
    return _cut(documents.select("doc_id", "text"), least_words).select(
        "doc_id", F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )
