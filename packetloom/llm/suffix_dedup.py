"""Suffix-array dedup of repeated byte strings, by induced sorting over shards.

Every window of ``length`` bytes contains an anchor: a place whose 32 bytes hash lowest
among the window's. Equal windows have equal anchors, so the corpus is asked about anchors
only, some 3 for each 100 bytes. The bytes around an anchor that its windows can reach are
its segment. Of equal segments (64 bits of hash of at most 168 bytes, beside the anchor's
64) all but the first are repeated throughout, so they go before any sorting; only the first
ones of different segments that share an anchor can still have windows in common. Their
bytes are dealt to shards by anchor. A shard's suffix array is induced, permuted common
prefixes tell runs of suffixes that share a whole window, and of each run all but the first
place are repeats.

Segments are dealt by their own hash, and each chunk tells of an anchor only how many it has,
so no task holds what a common anchor has. An anchor with more than ``HOT`` would fill a shard
by itself: the corpus is asked about each window of its different segments instead, a hash
once for each chunk.

Texts are UTF-8 bytes, matches never cross documents, and strings are judged on the input.
Rows: one for each input row. Null text: empty; texts shorter than a window stay whole, very
long ones are worked on alone. Rows that share a doc_id are ordered by text, so of repeated
rows one stays. A null doc_id counts as the smallest. No documents: no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import _engine as E
from packetloom.llm._suffixes import common_prefixes, suffix_array

GRAM, SHARD_BYTES, HOT = 32, 1 << 20, 4096
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
COMPARE, LATER, MANY = 0, 1, 2  # replies: of an anchor, of a segment, of an anchor
_ROW = 1 << 40  # rows of one doc_id lie this far apart in positions


def _extreme(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``width`` values in a row, by doubling widths."""
    if len(values) < width:
        return np.empty(0, np.uint64)
    f, step = np.minimum if least else np.maximum, 1
    while 2 * step <= width:
        values = f(values[:-step], values[step:])
        step *= 2
    rest = width - step
    return f(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts end to end: each anchor's hash and text, its segment's hash, start and end."""
    gram = min(GRAM, length)
    reach = length - gram  # how far before an anchor its windows start
    n = len(data)
    if n < length:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none.view(np.uint64), none, none
    sums = E.prefix_hash(data)
    g = E.gram_hash(sums, gram) | np.uint64(1)
    low = _extreme(g, reach + 1, True)  # by window's start
    # of each text's last places, from which no whole window fits
    size = np.diff(offsets)
    short = np.minimum(size, length - 1)
    last = np.repeat(offsets[1:] - short - (np.cumsum(short) - short), short) + np.arange(short.sum())
    low[last[last < len(low)]] = 0
    # the greatest least value over the windows that hold a place is its own: an anchor
    most = _extreme(np.concatenate([np.zeros(reach, np.uint64), low, np.zeros(reach, np.uint64)]), reach + 1, False)
    at = np.flatnonzero(most[: len(g)] == g)
    own = np.searchsorted(offsets, at, "right") - 1
    lo, hi = np.maximum(at - reach, offsets[own]), np.minimum(at + length, offsets[own + 1])
    # anchors' hashes are small ones; mixed again they spread over all ranges of keys
    return E.mixed(g[at]), own, E.mixed(E.span_hash(sums, lo, hi) + (at - lo).astype(np.uint64)), lo, hi


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets, ids, and the place of each row among those of its id (by text)."""
    data, offsets = E.text_bytes(table.column("text"))
    doc = E.ids(table.column("doc_id"))
    nth = np.zeros(len(doc), np.int64)
    if len(np.unique(doc)) < len(doc):
        texts = table.column("text").to_pylist()
        order = sorted(range(len(doc)), key=lambda i: (doc[i], texts[i] or ""))
        for before, row in zip(order, order[1:]):
            nth[row] = nth[before] + 1 if doc[before] == doc[row] else 0
    return data, offsets, doc, nth


def _first_of(s: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Indexes of the first (doc, place) of each value of s, by s."""
    order = np.lexsort((place, doc, s))
    return order[E.grouped(s[order])]


def _chunk_anchors(table: pa.Table, length: int):
    data, offsets, doc, nth = _rows(table)
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for a, b in E.slices(offsets):
        base = offsets[a]
        g, own, s, lo, hi = anchors(data[base : offsets[b]], offsets[a : b + 1] - base, length)
        for to, x in zip(out, (g, own + a, s, lo + base, hi + base)):
            to.append(x)
    g, own, s, lo, hi = (np.concatenate(x) if x else np.empty(0, t) for x, t in zip(out, (np.uint64, np.int64, np.uint64, np.int64, np.int64)))
    place = nth[own] * _ROW + lo - offsets[own]
    return data, offsets, doc, nth, g, own, s, lo, hi, place


def repeats(segments: np.ndarray, size: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Which windows (segment, start) of a shard also start earlier. segments: rows of bytes
    filled up with 255, which UTF-8 has not; size: bytes of each."""
    n, width = segments.shape
    text = np.full((n, width + 1), 255, np.uint8)
    text[:, :width] = segments
    text = text.reshape(-1)
    order = suffix_array(text)
    row, start = np.divmod(order, width + 1)
    # nothing that is no whole window can lie between two equal windows
    whole = start + length <= size[row]
    order, row, start = order[whole], row[whole], start[whole]
    run = np.cumsum(common_prefixes(text, order, length)[order] < length)
    order = np.lexsort((place[row] + start, doc[row], run))
    run, row, start = run[order], row[order], start[order]
    first = E.grouped(run)
    head = first[E.run_of(first, len(run))]
    # segments overlap: the first place itself can be there more than once
    at = place[row] + start
    again = (doc[row] != doc[row[head]]) | (at != at[head])
    out = np.zeros((n, width), bool)
    out[row[again], start[again]] = True
    return out


def _windows(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Hash, document and place of every window of some segments."""
    many = np.maximum(hi - lo - length + 1, 0)
    of = np.repeat(np.arange(len(lo)), many)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    key = np.empty(len(of), np.uint64)
    for a in range(0, len(lo), 4096):  # segments, joined without the text between them
        b = min(a + 4096, len(lo))
        size = hi[a:b] - lo[a:b]
        base = np.cumsum(size) - size
        joined = data[np.repeat(lo[a:b] - base, size) + np.arange(size.sum())]
        rows = slice(*np.searchsorted(of, [a, b]))
        start = base[of[rows] - a] + inside[rows]
        key[rows] = E.span_hash(E.prefix_hash(joined), start, start + length)
    return key, doc[of], place[of] + inside


def suffix_dedup(documents: DataFrame, length: int = 100, texts: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with
    ``texts`` the kept bytes. See the module for nulls, ties and empty texts."""
    chunks = E.deal(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    width = 2 * length - min(GRAM, length)

    def held(table, _):
        _, _, doc, _, g, own, s, _, _, place = _chunk_anchors(table, length)
        one = _first_of(s, doc[own], place)
        segment = {"key": s[one], "anchor": np.zeros(len(one), np.uint8), "a": doc[own[one]], "b": place[one]}
        # of an anchor: how many different segments are here, and the least and greatest of them
        one = one[np.lexsort((s[one], g[one]))]
        first = E.grouped(g[one])
        last = np.append(first[1:], len(one)) - 1 if len(first) else first
        low = s[one[first]]
        anchor = {"key": g[one[first]], "anchor": np.full(len(first), 1, np.uint8), "a": low.view(np.int64), "b": (s[one[last]] - low).view(np.int64), "n": (last - first + 1).astype(np.uint32)}
        out = {k: np.concatenate([segment.get(k, np.zeros(len(segment["key"]), np.uint32)), anchor[k]]) for k in anchor}
        order = np.argsort(out["key"], kind="stable")
        return {k: v[order] for k, v in out.items()}

    def settled(c):
        of = c["anchor"] == 1
        a, c = {k: v[of] for k, v in c.items()}, {k: v[~of] for k, v in c.items()}
        order = np.lexsort((c["b"], c["a"], c["key"]))
        c = {k: v[order] for k, v in c.items()}
        first = E.grouped(c["key"])
        run = E.run_of(first, len(order))
        later = (c["a"] != c["a"][first][run]) | (c["b"] != c["b"][first][run])
        first = E.grouped(a["key"])
        run, low = E.run_of(first, len(a["key"])), a["a"].view(np.uint64)
        if len(first):
            one = np.minimum.reduceat(low, first) == np.maximum.reduceat(low + a["b"].view(np.uint64), first)
            many = np.add.reduceat(a["n"].astype(np.int64), first) > hot
            keep, said = ~one[run], np.where(many, MANY, COMPARE)[run]
        else:
            keep = said = np.empty(0, bool)
        return {
            "chunk": np.concatenate([c["chunk"][later], a["chunk"][keep]]), "key": np.concatenate([c["key"][later], a["key"][keep]]),
            "later": np.concatenate([np.full(later.sum(), LATER, np.uint8), said[keep].astype(np.uint8)]),
        }

    def are(said, keys, kind):
        """Which keys have that reply."""
        return E.member(said["key"][said["later"] == kind], keys)[0] if said else np.zeros(len(keys), bool)

    def chosen(g, s, doc, place, said, kind):
        """Segments of this chunk that are the corpus's first of theirs and whose anchor has that reply."""
        pick = np.flatnonzero(are(said, g, kind))
        pick = pick[_first_of(s[pick], doc[pick], place[pick])]
        return pick[~are(said, s[pick], LATER)]

    def open_segments(table, said):
        data, _, doc, _, g, own, s, lo, hi, place = _chunk_anchors(table, length)
        doc = doc[own]
        pick = chosen(g, s, doc, place, said, COMPARE)
        size = hi[pick] - lo[pick]
        at = np.arange(width)
        body = np.concatenate([data, np.full(width, 255, np.uint8)])[lo[pick][:, None] + at] if len(pick) else np.empty((0, width), np.uint8)
        body = np.where(at < size[:, None], body, 255).astype(np.uint8)
        many = chosen(g, s, doc, place, said, MANY)
        key, of, start = _windows(data, lo[many], hi[many], doc[many], place[many], length)
        one = _first_of(key, of, start)
        # a window has size 0 and no bytes
        columns = {
            "key": np.concatenate([g[pick], key[one]]), "doc": np.concatenate([doc[pick], of[one]]), "place": np.concatenate([place[pick], start[one]]),
            "size": np.concatenate([size, np.zeros(len(one), np.int64)]).astype(np.uint16), "body": np.concatenate([body, np.full((len(one), width), 255, np.uint8)]),
        }
        order = np.argsort(columns["key"], kind="stable")
        columns = {k: v[order] for k, v in columns.items()}
        return columns | {"body": np.ascontiguousarray(columns["body"]).view(f"V{width}").reshape(-1)}

    def answers(c):
        whole = c["size"] == 0
        spans = compared({k: v[~whole] for k, v in c.items()})
        w = {k: v[whole] for k, v in c.items()}
        order = np.lexsort((w["place"], w["doc"], w["key"]))
        w = {k: v[order] for k, v in w.items()}
        first = E.grouped(w["key"])
        head = first[E.run_of(first, len(order))] if len(order) else first
        other = np.flatnonzero(np.diff(np.append(first, len(order)))[E.run_of(first, len(order))] > 1) if len(order) else first
        # of a window: the first document and place, with no length
        return {
            "chunk": np.concatenate([spans["chunk"], w["chunk"][other]]), "key": np.concatenate([spans["key"], w["key"][other]]), "start": np.concatenate([spans["start"], w["place"][head][other]]),
            "many": np.concatenate([spans["many"], np.zeros(len(other), np.int32)]), "doc": np.concatenate([spans["key"].view(np.int64), w["doc"][head][other]]),
        }

    def compared(c):
        n = len(c["key"])
        body = c["body"].view(np.uint8).reshape(n, width)
        size = c["size"].astype(np.int64)
        out: list[tuple] = [(c["chunk"][:0], c["doc"][:0], c["place"][:0], c["place"][:0])]
        cut = [*E.grouped(c["key"]).tolist(), n]
        a = 0
        for i, b in enumerate(cut[1:]):
            # whole anchors to a shard, as many as fit
            if b == n or (cut[i + 2] - a) * width > SHARD_BYTES:
                again = repeats(body[a:b], size[a:b], c["doc"][a:b], c["place"][a:b], length)
                edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                row, start = np.nonzero(edge == 1)
                _, stop = np.nonzero(edge == -1)
                row = row + a
                out.append((c["chunk"][row], c["doc"][row], c["place"][row] + start, stop - start + length - 1))
                a = b
        chunk, doc, start, many = (np.concatenate(x) for x in zip(*out))
        return {"chunk": chunk, "key": doc.view(np.uint64), "start": start, "many": many.astype(np.int32)}

    def cut_out(table, settled_, spans):
        data, offsets, doc, nth, g, own, s, lo, hi, place = _chunk_anchors(table, length)
        one = np.zeros(len(s), bool)
        one[_first_of(s, doc[own], place)] = True
        gone = ~one | are(settled_, s, LATER)
        starts, ends = lo[gone], hi[gone]
        many = chosen(g, s, doc[own], place, settled_, MANY)
        if len(many):
            key, of, at = _windows(data, lo[many], hi[many], doc[own[many]], place[many], length)
            first = _first_of(key, of, at)  # in this chunk; the corpus may have an earlier one
            keys, of0, at0 = key[first], of[first], at[first]
            if spans:
                told = {k: v[spans["many"] == 0] for k, v in spans.items()}
                found, where = E.member(told["key"], keys)
                of0, at0 = np.where(found, told["doc"][where] if len(told["key"]) else of0, of0), np.where(found, told["start"][where] if len(told["key"]) else at0, at0)
            _, where = E.member(keys, key)
            again = (of != of0[where]) | (at != at0[where])
            begin = (np.repeat(lo[many], np.maximum(hi[many] - lo[many] - length + 1, 0)) + at - np.repeat(place[many], np.maximum(hi[many] - lo[many] - length + 1, 0)))[again]
            starts, ends = np.append(starts, begin), np.append(ends, begin + length)
        if spans:
            spans = {k: v[spans["many"] > 0] for k, v in spans.items()}
        if spans and len(spans["key"]):
            order = np.lexsort((nth, doc))
            # rows by (id, place among its rows); ids fit beside small places
            rows = {(d, k): i for d, k, i in zip(doc[order].tolist(), nth[order].tolist(), order.tolist())}
            which, inside = np.divmod(spans["start"], _ROW)
            base = np.array([offsets[rows[x]] for x in zip(spans["key"].view(np.int64).tolist(), which.tolist())], np.int64)
            starts, ends = np.append(starts, base + inside), np.append(ends, base + inside + spans["many"])
        removed = E.covered(starts, ends, len(data))
        before = np.zeros(len(data), bool)
        before[1:] = removed[:-1]
        before[offsets[:-1][np.diff(offsets) > 0]] = False
        count = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        kept = [data[a:b][~removed[a:b]].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        out = {
            "doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(count(removed), pa.int64()), "n_spans": pa.array(count(removed & ~before), pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
        return pa.table(out | ({"kept": pa.array(kept, pa.binary())} if texts else {}))

    first = E.ask(chunks, None, held, settled)
    second = E.ask(chunks, first, open_segments, answers)
    return E.with_replies(chunks, first.union(second), cut_out, SCHEMA + ", kept binary" * texts, ("later", "many"))
