"""Document fingerprints: a threshold-scaled sketch, DataFrame functions only.

A sketch keeps every hash of a word shingle below a fixed fraction of the hash space, so
its size follows the document's, sketches merge by union, and containment can be estimated
between very unequal documents. A text of at most ``WHOLE`` different shingles keeps all its
hashes; two such sketches are compared whole, others over the fraction that both keep. A
text of fewer words than a shingle is one
shingle, a text without words has an empty sketch.

Rows: one for each input row; null text counts as empty. Rows that share a doc_id are
ordered by text. A null doc_id counts as the smallest. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm import _engine as E

SHINGLE, FRACTION = 5, 1 / 8
#: Texts of so many different shingles keep all hashes.
WHOLE = 1024
_LARGEST = 2**63 - 1


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _low(s: Column, fraction: float) -> Column:
    return F.filter(s, lambda x: x < int(2**63 * fraction))


def _is_whole(s: Column, fraction: float) -> Column:
    """Whether all hashes are kept: some lies above the fraction, or they are so few that
    no text of more than WHOLE shingles keeps as few below it."""
    return (F.size(s) <= 8) | (F.array_max(s) >= int(2**63 * fraction))


def sketch(text: Column, size: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """Sorted hashes (63 bits) of the text's word shingles: all of a short text, else those
    below ``fraction`` of the space."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def shingles(h: Column) -> Column:
        full = F.transform(
            F.slice(h, F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)]).bitwiseAND(_LARGEST),
        )
        return F.when(F.size(h) >= size, full).when(F.size(h) > 0, F.array(F.xxhash64(h).bitwiseAND(_LARGEST))).otherwise(F.array().cast("array<bigint>"))

    def kept(s: Column) -> Column:
        return _let(F.array_distinct(s), lambda y: F.sort_array(F.when(F.size(y) <= WHOLE, y).otherwise(_low(y, fraction))))

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), shingles), kept)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of both texts' shingles together, from their sketches."""
    whole = _is_whole(a, fraction) & _is_whole(b, fraction)
    return _let(F.array_union(a, b), lambda u: F.sort_array(F.when(whole & (F.size(u) <= WHOLE), u).otherwise(_low(u, fraction))))


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Share of the smaller text's hashes that the other holds, 0 to 1, over the range that
    both keep; two empty texts: 1; nothing of one in that range: 0."""
    whole = _is_whole(a, fraction) & _is_whole(b, fraction)

    def share(p: Column) -> Column:
        x, y = p["a"], p["b"]
        smaller = F.least(F.size(x), F.size(y))
        return F.when(smaller == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / smaller)

    both = F.when(whole, F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(_low(a, fraction).alias("a"), _low(b, fraction).alias("b")))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_let(both, share))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(documents: DataFrame, *carried: Column) -> DataFrame:
    """Each document beside the next one in descending doc_id, the last beside the first:
    doc_id, text, carried, next (text and carried as a struct). One shuffle of the texts.

    Ranges of ids end at ids that exist and hold bounded bytes of text; the row that ends a
    range is copied to the range above, whose last row it follows.
    """
    n = E.chunks_of(documents.select("text"))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / n for i in range(1, n)] or [0.5]
    found = docs.agg(F.percentile_approx("_id", shares, F.lit(max(10_000, 20 * n))), F.max("_id")).first()
    last = found[1] if found[1] is not None else 0
    ends = sorted({*(found[0] or []), last})
    array = F.lit(ends).cast("array<bigint>")
    steps = [1 << k for k in range(len(ends).bit_length(), -1, -1)]
    below = F.aggregate(  # how many ends are below the id, by halving
        F.lit(steps).cast("array<int>"), F.lit(0), lambda p, s: F.when((p + s <= len(ends)) & (F.get(array, p + s - 1) < F.col("_id")), p + s).otherwise(p)
    )
    docs = docs.withColumn("_range", below)
    ending = F.get(array, F.col("_range")) == F.col("_id")
    above = F.when(ending, F.array(F.when(F.col("_id") == last, F.lit(0)).otherwise(F.col("_range") + 1)))
    docs = docs.select("*", *carried).withColumn("_copy", F.explode(F.concat(F.array(F.lit(None).cast("int")), F.coalesce(above, F.array().cast("array<int>")))))
    names = E.labels(len(ends), E.partitions(documents.sparkSession))
    docs = docs.withColumn("_in", E.named(names, F.coalesce("_copy", "_range"))).withColumn("_guard", F.col("_copy").isNotNull())
    names = [c for c in docs.columns if not c.startswith("_") and c != "doc_id"]
    order = Window.partitionBy("_in").orderBy("_guard", F.desc("_id"), F.desc("text"))
    return docs.withColumn("next", F.lead(F.struct(*names)).over(order)).filter(~F.col("_guard")).select("doc_id", *names, "next")


def edited_fingerprints(documents: DataFrame, size: int = SHINGLE, fraction: float = FRACTION) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next:
    each text's sketch against that of the text whose last half the next document's start
    replaces, and against the next document's own."""
    own = F.col("text")
    rows = with_next(documents)  # sketches are as large as short texts: made after the shuffle
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), sketch(own, size, fraction).alias("s"), sketch(F.col("next.text"), size, fraction).alias("t"), edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "s", "t", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited"), size, fraction).alias("e"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("s")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        containment(F.col("s"), F.col("e"), fraction).alias("near_edited"), containment(F.col("s"), F.col("t"), fraction).alias("near_next"),
    )
