"""Best-fit packing by bin completion.

Documents become token ids (then an end id) and pieces of at most ``capacity``. Only the
counts of pieces by length, at most ``capacity`` numbers, come to the driver. There a
best-fit-decreasing solution is the incumbent; bin completion then takes the largest
remaining length, enumerates undominated fillings of what is left of its bin, and branches
over the least wasteful; a branch is cut when the waste so far rules out fewer bins than
the incumbent. A filling is used as often as the counts allow, so a solution is a short
list of (filling, times) however many documents there are. Pieces then find their place by
length and rank among the pieces of that length; ranks come from counts by task, without
bringing a length together.

The search is bounded: it stops at the floor (all tokens / capacity), and else after so many
branches (``complete``) over so many fillings of a bin (``fillings``); the best packing found
until then stands, which is never worse than best fit's. Pieces are never left out.

Rows: one for each piece. Null and empty texts are one piece that holds the end id only.
Very long texts are cut into pieces of the capacity. Repeated rows and doc_ids are packed
each by itself. No documents: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right
from collections import ChainMap, Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm import _engine as E

CAPACITY, END_ID = 4096, 1
#: Words of up to so many bytes are remembered, so many at a time.
WORD_BYTES, WORDS = 32, 400_000

Filling = tuple[tuple[int, int], ...]  # (length, times), longest first


# ---------------------------------------------------------------- tokens


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_MARKS = E.separators(b".,!?;:#%&*$|")
_SMALL = E.separators(b"abcdefghijklmnopqrstuvwxyz")


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, list[int]]:
    """Texts in lower case (A-Z) with a space between an ASCII letter and the marks that end
    its word; offsets move along. The vocabulary lower-cases by itself, drops white space and
    parts letters from such marks, so ids stay the same while far fewer words differ."""
    data = E.LOWER[data]
    if len(data) < 2:
        return data.tobytes(), offsets.tolist()
    mark = _MARKS[data]
    starts = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1
    ends = np.flatnonzero(mark & ~np.append(mark[1:], False)) + 1
    ends = ends[len(ends) - len(starts) :] if mark[0] else ends
    closed = np.append(E.WHITE[data], True)
    closed[offsets] = True
    at = starts[_SMALL[data[starts - 1]] & closed[ends]]
    return np.insert(data, at, 32).tobytes(), (offsets + np.searchsorted(at, offsets)).tolist()


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the rest counted on from 256."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder:
    """Token ids of texts as little-endian uint32 bytes.

    The vocabulary's tokens never cross white space, so words are encoded once and
    remembered; a text is the joined ids of its words. A word of Latin letters is a single
    piece for the vocabulary's merges and goes to them directly; all others take the whole
    way with normaliser and splitting.
    """

    _LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens that depend on what is around them")
        self.added = {t.content.encode(): np.array([i], "<u4").tobytes() for i, t in added.items()}
        self.cut = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or b"(?!)")
        # texts are cut at added tokens first; what lower case makes look like one is none
        self.tokenizer.encode_special_tokens = True
        self.merges = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}

    def words(self, new: list[bytes]) -> dict[bytes, bytes]:
        out, others = {}, []
        for w in new:
            text = w.decode("utf-8", "replace").lower() if not w.isascii() else w.decode()
            if self._LATIN.fullmatch(text):
                piece = text if w.isascii() else "".join(map(self.letters.__getitem__, text.encode()))
                ids = [t.id for t in self.merges.tokenize(piece)]
                out[w] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append(w)
        for w, e in zip(others, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in others], add_special_tokens=False)):
            out[w] = np.array(e.ids, "<u4").tobytes()
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Of texts end to end."""
        raw = data.tobytes()
        if not self.cut.search(raw):
            return self._plain(data, offsets)
        # the pieces between added tokens are texts of their own
        owner, starts, ends, tokens = [], [], [], []
        for row, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
            at = a
            for m in self.cut.finditer(raw, a, b):
                owner.append(row), starts.append(at), ends.append(m.start()), tokens.append(self.added[m[0]])
                at = m.end()
            owner.append(row), starts.append(at), ends.append(b), tokens.append(b"")
        kept = np.concatenate([data[a:b] for a, b in zip(starts, ends)])
        found = self._plain(kept, np.concatenate([[0], np.cumsum(np.array(ends) - np.array(starts))]))
        out: list[list[bytes]] = [[] for _ in range(len(offsets) - 1)]
        for row, ids, token in zip(owner, found, tokens):
            out[row] += [ids, token]
        return [b"".join(x) for x in out]

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        raw, at = spaced(data, offsets)
        split = [raw[i:j].split() for i, j in zip(at, at[1:])]
        known = self.known
        found = self.words(list(set().union(*split).difference(known)))
        long = {w: ids for w, ids in found.items() if len(w) > WORD_BYTES}
        for w in long:
            del found[w]
        known.update(found)
        of = ChainMap(known, long) if long else known
        out = [b"".join(map(of.__getitem__, t)) for t in split]
        if len(known) > WORDS:
            known.clear()
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, for ranks, part (the task) and nth (among
    the task's pieces of that length); with ``ids`` the ids themselves as uint32 bytes."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode, part, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            data, offsets = E.text_bytes(batch.column("text"))
            for a, b in E.slices(offsets):
                rows: list[list] = [[] for _ in range(7 + ids)]
                for row, tokens in enumerate(encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])):
                    tokens += end
                    for n, start in enumerate(range(0, len(tokens), 4 * capacity)):
                        own = tokens[start : start + 4 * capacity]
                        size = len(own) // 4
                        for to, x in zip(rows, (a + row, n, start // 4, size, zlib.crc32(own), seen[size], own)):
                            to.append(x)
                        seen[size] += 1
                index, n, start, size, crc, nth = (np.array(x, np.int64) for x in rows[:6])
                columns = [batch.column("doc_id").take(pa.array(index)), pa.array(n.astype(np.int32)), *map(pa.array, (start, size, crc)), pa.array(np.full(len(n), part, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(rows[6], pa.binary())] if ids else []), [*NAMES, *["ids"] * ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * ids
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]


# ---------------------------------------------------------------- bins


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on counts: equal bins are kept as one with its number."""
    open_: dict[int, list[list]] = defaultdict(list)  # by what is left: [filling, bins]
    lefts: list[int] = []

    def put(filling, left, bins):
        if bins:
            if not open_[left]:
                lefts.insert(bisect_right(lefts, left), left)
            open_[left].append([filling, bins])

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_right(lefts, length - 1)
            if at < len(lefts):
                left = lefts[at]
                filling, bins = open_[left].pop()
                if not open_[left]:
                    lefts.pop(at)
            else:
                left, filling, bins = capacity, (), todo
            each = left // length
            full = min(bins, todo // each)
            put((*filling, (length, each)), left - each * length, full)
            todo -= full * each
            rest = bins - full
            if rest and 0 < todo < each:
                put((*filling, (length, todo)), left - todo * length, 1)
                todo, rest = 0, rest - 1
            if filling:
                put(filling, left, rest)
    return [(f, n) for bins in open_.values() for f, n in bins]


def fillings(left: int, lengths: list[int], counts: dict[int, int], most: int = 6, nodes: int = 400) -> list[tuple[int, Filling]]:
    """(waste, filling) of a bin's remaining room, least wasteful first. lengths ascend and
    have counts over 0. A filling that stays valid with a longer piece in place of one of
    its own is dominated and left out."""
    found: list[tuple[int, Filling]] = []
    budget, best = [nodes], [left + 1]

    def longer(size, waste, used):
        at = bisect_right(lengths, size)
        return at < len(lengths) and lengths[at] <= size + waste and used.get(lengths[at], 0) < counts[lengths[at]]

    def go(room, top, chosen):
        at = bisect_right(lengths, min(room, top)) - 1
        fits = False
        while at >= 0 and budget[0] > 0:
            size = lengths[at]
            times = min(room // size, counts[size])
            if times:
                fits = True
                for k in range(times, 0, -1):
                    budget[0] -= 1
                    go(room - k * size, size - 1, (*chosen, (size, k)))
                    if best[0] == 0 or budget[0] <= 0:
                        return
            at -= 1
        if not fits or budget[0] <= 0:
            used = dict(chosen)
            if len(found) < 4 * most and not any(longer(s, room, used) for s in used):
                found.append((room, chosen))
                best[0] = min(best[0], room)

    go(left, left, ())
    return sorted(set(found), key=lambda x: (x[0], [-s for s, _ in x[1]]))[:most]


def complete(counts: dict[int, int], capacity: int, branches: int = 3, budget: int | None = None) -> list[tuple[Filling, int]]:
    """The fewest bins found: (filling, times). budget: fillings to branch on; by default it
    follows the number of lengths, so the search takes seconds, however many pieces."""
    budget = 1000 + 2 * len(counts) if budget is None else budget
    total = sum(k * n for k, n in counts.items())
    floor = -(-total // capacity)
    best = best_fit(counts, capacity)
    fewest = sum(n for _, n in best)
    spent = 0
    # a depth-first search over choices of filling: [counts, bins, waste, solution, options]
    stack = [[dict(counts), 0, 0, (), None]]
    while stack and fewest > floor and spent < budget:
        frame = stack[-1]
        have, bins, waste, done, options = frame
        if not have:
            if bins < fewest:
                fewest, best = bins, _listed(done)
            stack.pop()
            continue
        if options is None:
            lengths = sorted(have)
            top = lengths[-1]
            have[top] -= 1
            if not have[top]:
                lengths.pop()
            ways = fillings(capacity - top, lengths, have) or [(capacity - top, ())]
            have[top] += 1
            options = frame[4] = [(w, f) for w, f in ways[:branches]][::-1]
            spent += 1
        if not options:
            stack.pop()
            continue
        lost, filling = options.pop()
        top = max(have)
        use = Counter(dict(filling))
        use[top] += 1
        times = min(have[s] // k for s, k in use.items())
        # fewer bins than the incumbent leave so much room for waste in all
        if waste + lost * times > (fewest - 1) * capacity - total:
            times = max(0, ((fewest - 1) * capacity - total - waste) // lost)
            if not times:
                options.clear()  # the others waste more
                continue
        after = dict(have)
        for s, k in use.items():
            after[s] -= k * times
            if not after[s]:
                del after[s]
        stack.append([after, bins + times, waste + lost * times, (done, (tuple(sorted(use.items(), reverse=True)), times)), None])
    return best


def _listed(done) -> list[tuple[Filling, int]]:
    out = []
    while done:
        done, last = done
        out.append(last)
    return out[::-1]


def places(bins: list[tuple[Filling, int]]) -> dict[str, np.ndarray]:
    """By length and rank: from which rank on, in which first sequence, how many of the
    length to a sequence, at which offset the first."""
    rows, rank, sequence = [], Counter(), 0
    for filling, times in bins:
        offset = 0
        for length, each in filling:
            rows.append((length, rank[length], sequence, each, offset))
            rank[length] += each * times
            offset += each * length
        sequence += times
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "each", "offset"), np.array(rows, np.int64).reshape(-1, 5).T.copy()))


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece, and with
    ``ids`` the ids themselves."""
    cut = E.stored(pieces(documents, path or vocabulary(), capacity, end_id, ids), "pieces")
    by_task = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    # a length has at most a row for each task here
    before = by_task.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "part", F.coalesce("base", F.lit(0)).alias("base"))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    held = cut.sparkSession.sparkContext.broadcast(places(complete(counts, capacity)))

    def put(batches):
        where = held.value
        # both parts are below 2**31 x capacity, so pairs sort as one number
        first = where["length"] * (1 << 48) + where["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(first, length * (1 << 48) + rank, "right") - 1
            nth = rank - where["rank"][at]
            sequence = where["sequence"][at] + nth // where["each"][at]
            offset = where["offset"][at] + nth % where["each"][at] * length
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    ranked = cut.join(before, ["length", "part"]).select(*columns, (F.col("base") + F.col("nth")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(put, schema)

