"""Quality classifier: random Fourier features, partition-summed ridge, isotonic calibration.

Document statistics (shares of kinds of bytes, lengths, repetition) are standardised and
mapped to random Fourier features, which approximate a Gaussian kernel. Each partition of
labelled rows sums its part of the normal equations; the sums fit ridge scores on the
driver. Labelled rows kept from the fit give the isotonic calibration, fitted to counts in
``BINS`` bins of the raw score.

The fit uses at most about ``MAX_TRAIN`` labelled rows, chosen by a hash of doc_id; only their
texts are read for it. The scores cover every document. labels, lang, source and doc_id are
no inputs of a score.

Rows: one for each input row. Null and empty texts have all statistics zero and are scored
like any other, very long ones whole. No documents: no rows. Labels that are null or whose doc_id is null or absent from the documents
do not count; repeated labels each count. Without any labelled rows the score is 0.5.
Extra columns stay out of the way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import _engine as E

THRESHOLD, MAX_TRAIN, FEATURES, RIDGE, WIDTH, BINS, PARTS = 0.7, 200_000, 256, 1e-3, 3.0, 4096, 16

_KINDS = np.zeros(256, np.int64)  # kinds of bytes, 0: all others
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#$%&*", b"'\"()-:;/@_=+~^`", b"<>[]{}\\", bytes(range(9)) + b"\x0b\x0c" + bytes(range(14, 32)), bytes(range(128, 256))), 1):
    _KINDS[list(_bytes)] = _kind
_N_KINDS = int(_KINDS.max()) + 1
STATISTICS = _N_KINDS + 11


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS numbers for each text (bytes end to end)."""
    rows = len(offsets) - 1
    out = np.zeros((rows, STATISTICS))
    for a, b in E.slices(offsets):
        part, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n = b - a
        size = np.diff(cut)
        text = np.repeat(np.arange(n), size)
        kinds = np.bincount(text * _N_KINDS + _KINDS[part], minlength=n * _N_KINDS).reshape(n, _N_KINDS)
        starts, ends, at = E.words(part, cut, E.WHITE)
        count, length = np.diff(at), ends - starts
        own = E.owner(at)
        hashes = E.word_hash(part, starts, ends)
        order = np.lexsort((hashes, own))
        first = np.ones(len(order), bool)
        first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (own[order][1:] != own[order][:-1])
        distinct = np.bincount(own[order][first], minlength=n)
        run = np.diff(np.append(np.flatnonzero(first), len(order)))
        most = np.zeros(n, np.int64)
        np.maximum.at(most, own[order][first], run)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
        tail = part[ends - 1] if len(ends) else part[:0]
        per = lambda mask: np.bincount(own[mask], minlength=n)
        words = np.maximum(count, 1)
        out[a:b, :_N_KINDS] = np.sqrt(kinds / np.maximum(size, 1)[:, None])
        upper = (_KINDS[part[starts]] == 2) if len(starts) else np.zeros(0, bool)
        out[a:b, _N_KINDS:] = np.stack([
            np.log1p(count), np.log1p(size), np.bincount(own, length, n) / words / 8, np.sqrt(np.bincount(own, length.astype(float) ** 2, n) / words) / 8,
            distinct / words, np.sqrt(most / words), np.sqrt(per(same) / words), per(upper) / words, per(np.isin(tail, np.frombuffer(b"!#$%&*", np.uint8))) / words, per(length == 1) / words, per(length > 20) / words,
        ], axis=1) * (count > 0)[:, None]
    return out


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and x, the statistics as doubles' bytes."""

    def scan(batches):
        for batch in batches:
            x = statistics_of(*E.text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, x binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, STATISTICS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    beta: np.ndarray | None = None
    edges: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(x), 1)), z, np.sqrt(2 / FEATURES) * np.cos(z @ self.weights + self.bias)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None or self.levels is None:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        # the raw score orders what the calibration has level
        return np.clip(np.interp(raw, self.edges, self.levels) * (1 - 1e-6) + 1e-6 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def isotonic(at: np.ndarray, good: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and never falling levels, of bins with good of count."""
    blocks: list[list[float]] = []
    for x, g, n in zip(at.tolist(), good.tolist(), count.tolist()):
        blocks.append([x * n, g, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    b = np.array(blocks).reshape(-1, 3)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def _summed(rows: DataFrame, of, shape: int) -> np.ndarray:
    """Sum over rows of what ``of(x, y)`` gives for a batch; one vector from each partition."""

    def scan(batches):
        total = np.zeros(shape)
        for batch in batches:
            if len(batch):
                total += of(_matrix(batch.column("x")), batch.column("y").to_numpy().astype(float)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    # PARTS vectors, whatever the input
    return sum((np.frombuffer(r[0]) for r in rows.mapInArrow(scan, "s binary").collect()), np.zeros(shape))


def fit(labelled: DataFrame, seed: int = 7) -> Model:
    """A model from rows (doc_id, x, y)."""
    rows = labelled.select("doc_id", "x", "y")
    unit = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    rows = E.stored(rows.withColumn("fold", (unit < 250_000).cast("int")).repartition(PARTS, "doc_id", "x"), "labelled")
    train, held = (rows.filter(F.col("fold") == k).coalesce(PARTS) for k in (0, 1))
    d = STATISTICS
    sums = _summed(train, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    rng = np.random.default_rng(seed)
    weights, bias = rng.normal(size=(d, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    if sums[0] < 1:
        return Model(np.zeros(d), np.ones(d), weights, bias)
    mean = sums[1 : 1 + d] / sums[0]
    scale = np.sqrt(np.maximum(sums[1 + d :] / sums[0] - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1), weights, bias)
    k = 1 + d + FEATURES

    def normal(x, y):
        f = model.features(x)
        return np.concatenate([f.T @ f, (f.T @ y)[:, None]], axis=1)

    total = _summed(train, normal, k * (k + 1)).reshape(k, k + 1)
    penalty = RIDGE * sums[0] * np.eye(k)
    penalty[0, 0] = 0
    model.beta = np.linalg.solve(total[:, :k] + penalty + 1e-9 * np.eye(k), total[:, k])

    def binned(x, y):
        at = np.clip((model.raw(x) + 1) / 3 * BINS, 0, BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, None, BINS)])

    counts = _summed(held, binned, 2 * BINS)
    if not counts[BINS:].sum():
        counts = _summed(train, binned, 2 * BINS)
    some = counts[BINS:] > 0
    model.edges, model.levels = isotonic((np.flatnonzero(some) + 0.5) / BINS * 3 - 1, counts[:BINS][some], counts[BINS:][some])
    return model


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, x, y): statistics of the documents that are fitted. The labels are sampled
    first, to about MAX_TRAIN rows, so they can be broadcast whatever the corpus."""
    known = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    known = known.filter(~held_out())
    n = known.count()
    if n > MAX_TRAIN:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1_000_000)) < int(1e6 * MAX_TRAIN / n))
    known = known.groupBy("doc_id").agg(F.collect_list("y").alias("ys"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    return statistics(texts).join(F.broadcast(known), "doc_id").select("doc_id", "x", F.explode("ys").alias("y"))


def _scoring(documents: DataFrame, labels: DataFrame):
    """batch -> scores, by a model that is fitted now."""
    held = documents.sparkSession.sparkContext.broadcast(fit(labelled_rows(documents, labels)))
    return lambda batch: held.value.score(statistics_of(*E.text_bytes(batch.column("text"))))


def quality(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; fitted to the labelled rows that are not held out."""
    score = _scoring(documents, labels)

    def scan(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch))], ["doc_id", "score"])

    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents, all columns, without those that score below the threshold."""
    score = _scoring(documents, labels)

    def keep(batches):
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(score(batch) >= threshold))

    return documents.mapInArrow(keep, documents.schema)
