"""Substring dedup by fixed-block anchors.

Every document's words are cut into non-overlapping reference blocks of half a window;
any window that repeats holds one of the earlier document's blocks whole. The corpus is
asked about blocks (an index entry each) and about every rolling window of block size (a
probe each, hashes only). Where a probe meets a block, both sides extend the hit to all
windows around it, whose words are compared by 96 bits of hash (64 deal them out, 32 of
another hash check them), so that a hit shared by very many documents is spread over all
tasks; windows that an earlier document holds merge into maximal exact repeats.

Rows: one for each input row. Null text: no words. Empty and short texts have no windows
and stay whole; very long ones are worked on alone. Rows that share a doc_id do not remove
each other's words (neither is smaller); a null doc_id counts as the smallest. No documents:
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import _engine as E

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _same(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Where each run of equal (key, check) begins; sorted by both."""
    if not len(key):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])]))


def _min_max(key: np.ndarray, check: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different (key, check), sorted, with the least and greatest value of each."""
    order = np.lexsort((check, key))
    key, check = key[order], check[order]
    first = _same(key, check)
    if not len(first):
        return key, check, low, high
    return key[first], check[first], np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)


def _check(hashes: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """32 bits of another hash of the windows that start at some places."""
    out = np.zeros(len(at), np.uint64)
    for i in range(size):
        out = (out ^ E.mixed(hashes[at + i] + np.uint64(i))) * np.uint64(0x9FB21C651E98DF25)
    return (E.mixed(out) >> np.uint64(32)).astype(np.uint32)


def _parsed(table: pa.Table, window: int):
    """By slice: ids, words' starts and ends, offsets, hashes, bytes."""
    data, offsets = E.text_bytes(table.column("text"))
    doc = E.ids(table.column("doc_id"))
    for a, b in E.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, at = E.words(part, offsets[a : b + 1] - offsets[a], E.WHITE)
        yield doc[a:b], part, starts, ends, at, E.word_hash(part, starts, ends)


def substring_dedup(documents: DataFrame, window: int = 13, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by a space), and with
    ``texts`` the kept text itself. See the module for nulls, ties and empty texts."""
    block = (window + 1) // 2
    chunks = E.deal(documents.select("doc_id", "text"))

    def blocks(table, _):
        keys, lows, highs, kinds = [], [], [], []
        for doc, _, _, _, at, hashes in _parsed(table, window):
            ok = E.whole(at, block)
            key = E.windows(hashes, block)[ok]
            mine = E.owner(at)[: len(ok)][ok]
            place = np.flatnonzero(ok) - at[mine]
            aligned = place % block == 0
            keys.append(key)
            lows.append(np.where(aligned, doc[mine], 2**63 - 1))
            highs.append(np.where(aligned, doc[mine], -(2**63)))
            kinds.append(np.where(aligned, 0, 1))
        if not keys:
            keys, lows, highs, kinds = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key, first = key[order], None
        first = E.grouped(key)
        if not len(first):
            return {"key": key, "low": np.empty(0, np.int64), "high": np.empty(0, np.int64), "probe": np.empty(0, np.uint8)}
        low, high = (f.reduceat(np.concatenate(x)[order], first) for f, x in ((np.minimum, lows), (np.maximum, highs)))
        probe = np.maximum.reduceat(np.concatenate(kinds)[order], first)
        none = low > high  # a probe only: no id travels
        return {"key": key[first], "low": np.where(none, 0, low), "high": np.where(none, 0, high - low), "probe": probe.astype(np.uint8) | np.where(none, 2, 0).astype(np.uint8)}

    def met(c):
        first = E.grouped(c["key"])
        run = E.run_of(first, len(c["key"]))
        block_here = c["probe"] < 2
        low = np.where(block_here, c["low"], 2**63 - 1)
        high = np.where(block_here, c["low"] + c["high"], -(2**63))
        least, most = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        probed = np.maximum.reduceat((c["probe"] & 1).astype(np.int64), first)
        # a block that only its own document holds, and nothing probes, meets nobody
        hit = (least <= most) & ((probed > 0) | (least < most))
        keep = hit[run]
        return {"chunk": c["chunk"][keep], "key": c["key"][keep], "least": least[run][keep]}

    def around(table, said):
        keys, checks, docs = [], [], []
        if said:
            for doc, _, _, _, at, hashes in _parsed(table, window):
                ok = E.whole(at, block)
                key = E.windows(hashes, block)
                found, where = E.member(said["key"], key)
                mine = E.owner(at)[: len(ok)]
                found &= ok & ((said["least"][where] < doc[mine]) | ((np.arange(len(ok)) - at[mine]) % block == 0))
                hits = np.flatnonzero(found)
                full = E.whole(at, window)
                near = E.covered(np.maximum(hits - (window - block), 0), hits + 1, len(full) + window)[: len(full)] & full
                keys.append(E.windows(hashes, window)[near])
                checks.append(_check(hashes, window, np.flatnonzero(near)))
                docs.append(doc[E.owner(at)[: len(full)][near]])
        key, check, doc = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, np.uint64), (checks, np.uint32), (docs, np.int64)))
        key, check, low, high = _min_max(key, check, doc, doc)
        return {"key": key, "check": check, "low": low, "more": high - low}

    def earlier(c):
        order = np.lexsort((c["check"], c["key"]))
        c = {k: v[order] for k, v in c.items()}
        first = _same(c["key"], c["check"])
        run = E.run_of(first, len(c["key"]))
        least = np.minimum.reduceat(c["low"], first)[run]
        keep = least < c["low"] + c["more"]
        return {k: c[k][keep] for k in ("chunk", "key", "check")} | {"least": least[keep]}

    def cut(table, said):
        out = {"doc_id": table.column("doc_id"), "n_words": [], "n_removed": [], "kept_sha256": [], "text": []}
        for doc, part, starts, ends, at, hashes in _parsed(table, window):
            full = E.whole(at, window)
            if said and len(full):
                key = E.windows(hashes, window)
                at_ = np.flatnonzero(full)
                at_ = at_[E.member(said["key"], key[at_])[0]]
                check = _check(hashes, window, at_)
                # equal keys with other checks lie side by side; mostly there is one
                where = np.searchsorted(said["key"], key[at_])
                hits, mine = [], doc[E.owner(at)[at_]]
                while len(at_):
                    hits.append(at_[(said["check"][where] == check) & (said["least"][where] < mine)])
                    where = where + 1
                    more = np.flatnonzero(said["key"][np.minimum(where, len(said["key"]) - 1)] == key[at_])
                    more = more[where[more] < len(said["key"])]
                    at_, where, check, mine = at_[more], where[more], check[more], mine[more]
                hits = np.concatenate(hits) if hits else np.empty(0, np.int64)
            else:
                hits = np.empty(0, np.int64)
            gone = E.covered(hits, hits + window, len(starts))
            count = np.concatenate([[0], np.cumsum(gone)])
            raw = part.tobytes()
            begin, end, stays = starts.tolist(), ends.tolist(), (~gone).tolist()
            for i in range(len(doc)):
                a, b = int(at[i]), int(at[i + 1])
                lost = int(count[b] - count[a])
                kept = b" ".join([raw[begin[j] : end[j]] for j in range(a, b) if stays[j]])
                out["n_words"].append(b - a)
                out["n_removed"].append(lost)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if texts:
                    out["text"].append(kept.decode())
        types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "text": pa.string()}
        return pa.table({k: v if k == "doc_id" else pa.array(v, types[k]) for k, v in out.items() if texts or k != "text"})

    hits = E.ask(chunks, None, blocks, met)
    repeats = E.ask(chunks, hits, around, earlier)
    chunks = chunks.with_rows(chunks.rows.withColumn("doc_id", F.col("doc_id").cast("long")))
    return E.with_replies(chunks, repeats, cut, SCHEMA + ", text string" * texts)
