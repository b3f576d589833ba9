"""SimHash near-dedup on shingle sets: one document of each group that is similar by 0.8.

Two documents are linked if their sets of word shingles have a Jaccard similarity of 0.8 or
more. Their SimHash fingerprints then differ in 10 of 64 bits on average and, but for a
chance of some 3 in 10 million, in ``RADIUS`` at most; blocks of so few equal bits select
nothing, so candidates meet by shingles. Shingles (``size`` lower-case words, 64-bit hashes)
have one fixed order, frequent ones last; two sets that are similar enough share one of the
first n - ceil(0.8 n) + 1 of each, so a document is dealt to those only. Within a bucket,
sizes and places bound what two sets can share and discard a pair; then the pivot distance
table does; the survivors are verified on whole sets. A bucket of more than ``hot`` sets
compares each with one hub at first, then each that this leaves apart with the nearest set
of another component, and at last all pairs of different components, so a group of thousands
of near copies makes no pair for each two of them and still none is skipped. Nearness, and
what cannot be similar any more, is told there by parity marks: each of their bits says
whether an odd number of a set's shingles fall there, so no two marks differ in more bits
than their sets in shingles.

Rows: of each component the row with the smallest doc_id (null last, ties by a hash of the
text; of equal rows any one), all columns. A text of fewer words than a shingle is one
shingle; texts without words, and null, are alike. Very long texts are compared whole. No
documents: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm import _engine as E
from packetloom.llm import simhash
from packetloom.llm._graph import components

SIZE, RADIUS = 5, 24
#: A bucket of more sets is compared with hubs first.
HOT_BUCKET = 8
#: Bits of a parity mark, and rounds of nearest sets at most.
MARK, ROUNDS = 512, 3
#: Shingles that are put last in the order, at most; any choice gives the same links.
FREQUENT = 100_000
PAIRS = "u long, v long, key long, n int, at int"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, in the fixed order, and n + 1 offsets into them."""
    part = E.LOWER[data]
    starts, ends, at = E.words(part, offsets, E.WHITE)
    h = E.word_hash(part, starts, ends)
    inside = E.whole(at, size)
    text, key = E.owner(at)[: len(inside)][inside], E.windows(h, size)[inside]
    short = [(i, _joined(h[at[i] : at[i + 1]])) for i in np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < size)).tolist()]
    text = np.concatenate([text, np.array([i for i, _ in short], np.int64)])
    key = np.concatenate([key, np.array([x for _, x in short], np.uint64)])
    order = np.lexsort((key, E.member(frequent, key)[0], text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return key[new], np.searchsorted(text[new], np.arange(len(offsets)))


def _joined(h: np.ndarray) -> int:
    out = len(h)
    for x in h.tolist():
        out = ((out ^ x) * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1)
    return out


def _sets(batch, size: int, frequent: np.ndarray):
    """(sets as an array column, their names, their sizes, hashes, offsets) of a batch's texts."""
    data, offsets = E.text_bytes(batch.column("text"))
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for a, b in E.slices(offsets):
        k, o = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size, frequent)
        keys.append(k)
        counts.append(np.diff(o))
    key, n = np.concatenate(keys), np.concatenate(counts)
    cut = np.concatenate([[0], np.cumsum(n)])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(E.mixed(key), dtype=np.uint64)])
    return key, n, cut, E.mixed(sums[cut[1:]] - sums[cut[:-1]] + n.astype(np.uint64))


def _array(key: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(key.view(np.int64)))


def _marks(key: np.ndarray, n: np.ndarray) -> pa.Array:
    """The parity mark of each set, as bytes."""
    at = np.repeat(np.arange(len(n)), n) * MARK + (key % np.uint64(MARK)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=len(n) * MARK) & 1).astype(np.uint8)).tobytes()
    return pa.array([odd[i * MARK // 8 : (i + 1) * MARK // 8] for i in range(len(n))], pa.binary())


def _close(n: np.ndarray, at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets x and y, which share the item at these places, can share 4/9 of both sizes."""
    most = np.minimum(at[x], at[y]) + 1 + np.minimum(n[x] - at[x], n[y] - at[y]) - 1
    return 9 * most >= 4 * (n[x] + n[y])


def _within(run: np.ndarray, n: np.ndarray, at: np.ndarray, part: np.ndarray):
    """Index pairs of a run of different parts that can be similar; sizes rise within a run."""
    alive, step = np.arange(len(run)), 1
    while len(alive):
        alive = alive[alive + step < len(run)]
        far = alive + step
        near = (run[alive] == run[far]) & (5 * n[alive] >= 4 * n[far])
        alive, far = alive[near], far[near]
        ok = _close(n, at, alive, far) & (part[alive] != part[far])
        if ok.any():
            yield alive[ok], far[ok]
        step += 1


def _hubs(run: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hub of each item: the first of its run whose size is near enough."""
    hub = np.arange(len(run))
    for i in range(1, len(run)):
        if run[i] == run[i - 1] and 5 * n[hub[i - 1]] >= 4 * n[i]:
            hub[i] = hub[i - 1]
    return hub


def _apart(run: np.ndarray, n: np.ndarray, at: np.ndarray, part: np.ndarray, fp: np.ndarray, mark: np.ndarray, nearest: bool):
    """Index pairs of a run of different parts that can be similar: for each item outside the
    run's commonest part all of them, or the nearest one. So the work is their number times
    the run's and not its square."""
    first = E.grouped(run)
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(run)]):
        _, of, many = np.unique(part[a:b], return_inverse=True, return_counts=True)
        few = np.flatnonzero(of != np.argmax(many))
        is_few = np.zeros(b - a, bool)
        is_few[few] = True
        left, right = [], []
        for i in few.tolist():
            # sizes rise within a run
            lo, hi = np.searchsorted(5 * n[a:b], 4 * n[a + i]), np.searchsorted(4 * n[a:b], 5 * n[a + i], "right")
            other = np.arange(lo, hi)
            other = other[(of[lo:hi] != of[i]) & (nearest | ~is_few[lo:hi] | (other > i))] + a
            mine = np.full(len(other), a + i)
            other = other[_close(n, at, mine, other)]
            far = np.bitwise_count(mark[other] ^ mark[a + i]).sum(axis=1, dtype=np.int64)
            ok = 9 * far <= n[other] + n[a + i]
            other, far = other[ok], far[ok]
            if nearest and len(other):
                other = other[np.argmin(far)][None]
            left.append(np.full(len(other), a + i))
            right.append(other)
        x, y = np.concatenate(left), np.concatenate(right)
        ok = simhash.near(fp[x], fp[y], RADIUS)
        if ok.any():
            yield x[ok], y[ok]


def _compared(nearest: bool):
    """(u, v) and how far apart their marks are, of each bucket's pairs of different parts."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("far", pa.int32())])

    def found(key, sid, place, part, fp, mark):
        first = E.grouped(key)
        mixed = np.maximum.reduceat(part, first) != np.minimum.reduceat(part, first)
        some = np.repeat(mixed, np.diff(np.append(first, len(key))))
        run, sid, place, part, fp, mark = (x[some] for x in (E.run_of(first, len(key)), sid, place, part, fp, mark))
        for x, y in _apart(run, place >> 32, place & 0xFFFFFFFF, part, fp.view(np.uint64), mark, nearest):
            far = np.bitwise_count(mark[x] ^ mark[y]).sum(axis=1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(sid[x]), pa.array(sid[y]), pa.array(far)], schema=schema)

    def scan(batches):
        rest = None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("key", "sid", "place", "part", "fp")]
            columns.append(np.frombuffer(b"".join(batch.column("mark").to_pylist()), np.uint64).reshape(-1, MARK // 64))
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            cut = E.grouped(columns[0])[-1] if len(columns[0]) else 0  # the last key may go on
            rest = [c[cut:] for c in columns]
            if cut:
                yield from found(*(c[:cut] for c in columns))
        if rest is not None and len(rest[0]):
            yield from found(*rest)

    return scan


def _scan(hot: int):
    """Pairs of each bucket; of those of more than ``hot`` sets the pairs with hubs (n is 1 there)
    and the members (with a key)."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("at", pa.int32())])

    def out(u, v, key=None, n=None, at=None):
        rest = [pa.nulls(len(u), t) if x is None else pa.array(x).cast(t) for x, t in ((key, pa.int64()), (n, pa.int32()), (at, pa.int32()))]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *rest], schema=schema)

    def found(key, sid, place):
        n, at = place >> 32, place & 0xFFFFFFFF
        first = E.grouped(key)
        size = np.diff(np.append(first, len(key)))
        many = np.repeat(size, size)
        small = (many > 1) & (many <= hot)
        run, ids = E.run_of(first, len(key))[small], sid[small]
        for x, y in _within(run, n[small], at[small], ids):
            yield out(ids[x], ids[y])
        if (many > hot).any():
            large = many > hot
            run, ids, k, n, at = E.run_of(first, len(key))[large], sid[large], key[large], n[large], at[large]
            hub = _hubs(run, n)
            some = np.flatnonzero(hub != np.arange(len(hub)))
            some = some[_close(n, at, hub[some], some)]
            yield out(ids[hub[some]], ids[some], None, np.ones(len(some)))
            yield out(ids, ids, k, n, at)

    def scan(batches):
        rest = None
        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in batch.schema.names]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            cut = E.grouped(columns[0])[-1] if len(columns[0]) else 0  # the last key may go on
            rest = [c[cut:] for c in columns]
            if cut:
                yield from found(*(c[:cut] for c in columns))
        if rest is not None and len(rest[0]):
            yield from found(*rest)

    return scan


def _bucketed(rows: DataFrame, *more: str) -> DataFrame:
    """rows: key, sid and, as one number, n and at; whole buckets, by key and size."""
    rows = rows.select("key", "sid", "place", *more).repartition(E.partitions(rows.sparkSession), "key")
    return rows.sortWithinPartitions("key", "place", "sid")


def one_of_each(documents: DataFrame, size: int = SIZE, hot: int = HOT_BUCKET) -> DataFrame:
    """documents, all columns, without near copies of kept ones (see above)."""
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("_d"), F.xxhash64("text").alias("_t")]
    texts = documents.select(*key, "text")

    def sample(batches):
        for batch in E.portions(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_sets(batch, size, np.empty(0, np.uint64))[0].view(np.int64))], ["key"])

    often = texts.filter("pmod(xxhash64(_t, 5), 16) = 0").dropDuplicates(["_t"]).mapInArrow(sample, "key long").groupBy("key").count()
    often = often.filter("count > 3").orderBy(F.desc("count"), "key").limit(FREQUENT).select("key").collect()  # at most FREQUENT
    spread = documents.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64)))

    def scan(batches):
        for batch in E.portions(batches):
            keys, n, cut, sid = _sets(batch, size, spread.value)
            head = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
            place = np.arange(len(keys)) - np.repeat(cut[:-1], n)
            first, fp = keys[place < np.repeat(head, n)], simhash.of_sets(keys, cut)
            yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_t"), pa.array(sid.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(fp.view(np.int64)), _marks(keys, n), _array(first, head)], ["_d", "_t", "sid", "n", "fp", "mark", "head"])

    found = E.stored(texts.mapInArrow(scan, "_d long, _t long, sid long, n int, fp long, mark binary, head array<long>"), "shingles")
    # equal sets are one from here on
    distinct = E.stored(found.groupBy("sid").agg(F.min(F.struct("_d", "_t")).alias("first"), F.min("n").alias("n"), F.first("fp").alias("fp"), F.first("mark").alias("mark"), F.first("head").alias("head")), "sets")
    place = F.shiftleft(F.col("n").cast("long"), 32)
    dealt = distinct.select("sid", "n", F.posexplode("head").alias("at", "key")).select("key", "sid", place.bitwiseOR(F.col("at").cast("long")).alias("place"))
    passed = E.stored(_bucketed(dealt).mapInArrow(_scan(hot), PAIRS), "pairs")
    sets = distinct.select("sid", "fp", "first")
    # of the hubs that a set meets, the one it shares most buckets with; later pairs cover the rest
    hubs = passed.filter("key IS NULL AND n IS NOT NULL").groupBy("u", "v").agg(F.count("*").alias("n")).groupBy("v").agg(F.max(F.struct("n", "u")).alias("h")).select("h.u", "v")
    links = _verified(texts, sets, passed.filter("key IS NULL AND n IS NULL").select("u", "v").union(hubs).distinct(), size)
    roots = components(links)
    members = passed.filter("key IS NOT NULL").select("key", F.col("u").alias("sid"), place.bitwiseOR(F.col("at").cast("long")).alias("place"))
    if not members.isEmpty():
        members = E.stored(members.join(distinct.select("sid", "fp", "mark"), "sid"), "members")
        turn, joined = 0, True
        while turn <= ROUNDS:
            nearest = joined and turn < ROUNDS  # at last, or where no set has a near one: all pairs
            turn = turn + 1 if nearest else ROUNDS + 1
            parts = members.join(roots.withColumnRenamed("vertex", "sid"), "sid", "left").withColumn("part", F.coalesce("root", "sid"))
            more = _bucketed(parts, "part", "fp", "mark").mapInArrow(_compared(nearest), "u long, v long, far int")
            if nearest:
                more = more.groupBy("u").agg(F.min(F.struct("far", "v")).alias("near")).select("u", "near.v")
            new = _verified(texts, sets, more.distinct(), size)
            joined = not new.isEmpty()
            if joined:
                links = links.union(new)
                roots = components(links)
        E.removed(members)
    E.removed(passed)
    # rows that another row stands for: of its component, of its set, or its equal
    first = sets.join(roots.withColumnRenamed("vertex", "sid"), "sid", "left").groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("first").alias("kept"))
    named = roots.withColumnRenamed("vertex", "sid").join(first, "root").select("sid", "kept")
    of = found.select("sid", F.struct("_d", "_t").alias("me"))
    rest = of.join(sets.select("sid", "first"), "sid").join(named, "sid", "left").filter(F.coalesce("kept", "first") != F.col("me")).select("me")
    many = of.groupBy("me").agg(F.count("*").alias("n")).filter("n > 1").select("me")
    doubt = E.stored(rest.withColumn("gone", F.lit(True)).union(many.withColumn("gone", F.lit(False))).groupBy("me").agg(F.max("gone").alias("gone")).select("me._d", "me._t", "gone"), "doubt")
    E.removed(found)
    E.removed(distinct)
    once = Window.partitionBy("_d", "_t").orderBy(F.lit(1))
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"), *key)
    some, others = E.parted(rows, doubt, "_d", "_t")
    some = some.join(doubt, ["_d", "_t"], "left").filter(~F.coalesce("gone", F.lit(False))).withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    return some.select("_row.*").union(others.select("_row.*"))


def _verified(texts: DataFrame, sets: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs (u, v) of sets that are similar; only texts of pairs that the pivots leave are
    read again."""

    def prune(batches):
        for batch in batches:
            x, y = (batch.column(c).to_numpy().view(np.uint64) for c in ("u_fp", "v_fp"))
            yield batch.filter(pa.array(simhash.near(x, y, RADIUS))).select(["u", "v"])

    def scan(batches):
        for batch in E.portions(batches):
            keys, n, _, sid = _sets(batch, size, np.empty(0, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(sid.view(np.int64)), _array(keys, n)], ["sid", "keys"])

    u, v = (sets.select(F.col("sid").alias(x), F.col("fp").alias(f"{x}_fp")) for x in "uv")
    pairs = pairs.join(u, "u").join(v, "v").select("u", "v", "u_fp", "v_fp").mapInArrow(prune, "u long, v long")
    # a set of very many pairs is sent to as many places as there are partitions
    pairs = E.stored(pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(E.partitions(texts.sparkSession))).cast("int")), "near")
    if pairs.isEmpty():
        return pairs.select("u", "v")
    some = pairs.select(F.explode(F.array("u", "v")).alias("sid")).distinct().join(sets, "sid").select("first._d", "first._t")
    compared = E.parted(texts, some, "_d", "_t")[0].join(some, ["_d", "_t"], "left_semi").dropDuplicates(["_d", "_t"])
    compared = E.stored(compared.select("text").mapInArrow(scan, "sid long, keys array<long>"), "compared")
    a = pairs.select("u", "salt").distinct().join(compared.select(F.col("sid").alias("u"), F.col("keys").alias("a")), "u")
    both = pairs.join(compared.select(F.col("sid").alias("v"), F.col("keys").alias("b")), "v").join(a, ["u", "salt"])
    links = E.stored(both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v"), "links")
    E.removed(pairs)
    E.removed(compared)
    return links
