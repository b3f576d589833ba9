"""Sketches of short texts against true containment."""

import brute
import pytest

from packetloom.llm import fingerprints


def test_fingerprints_against_brute_force(spark, texts):
    long = " ".join(f"t{i % 3000}x{i % 7}" for i in range(4000))
    docs = [*texts, (700, long), (701, long[: len(long) // 2]), (702, " ".join(long.split()[500:900])), (703, long)]
    got = sorted(tuple(r) for r in fingerprints.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    want = sorted(brute.fingerprints(docs))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=1e-12), g[0]


@pytest.mark.parametrize("words", [8, 12, 60, 400, 2000])
def test_merged_is_the_sketch_of_both(spark, words):
    """Of a text and one that holds it or not: the sketch of the union of their shingles."""
    part = [f"s{i}" for i in range(words)]
    docs = [(" ".join(part), " ".join([*part, *[f"m{i}" for i in range(400)]])), (" ".join(part), " ".join(f"n{i}" for i in range(1500)))]
    s = fingerprints.sketch
    df = spark.createDataFrame(docs, "a string, b string")
    for r in df.select("a", "b", fingerprints.merged(s(df.a), s(df.b)).alias("m"), fingerprints.containment(s(df.a), s(df.b)).alias("c")).collect():
        a, b = brute.shingles(r["a"]), brute.shingles(r["b"])
        assert set(r["m"]) == brute.sketch(a | b) and r["c"] == pytest.approx(brute.likeness(a, b))


def test_short_in_longer(spark):
    cases = []
    for n in (5, 6, 9, 14, 24, 60):
        for k in range(20):
            words = [f"s{n}k{k}w{i}" for i in range(n)]
            cases.append((" ".join(words), " ".join(words + [f"m{k}x{i}" for i in range(300)]), 1.0))
            half = words[: n // 2 + 3]
            truth = max(len(half) - 4, 0) / max(n - 4, 1) if len(half) < n else 1.0
            cases.append((" ".join(words), " ".join([*half, *[f"z{k}y{i}" for i in range(300)]]), truth))
    df = spark.createDataFrame(cases, "a string, b string, truth double")
    s = fingerprints.sketch
    c = fingerprints.containment(s(df.a), s(df.b))
    assert all(abs(r[0] - r[1]) < 1e-9 for r in df.select(c, "truth").collect())


def test_merged_short_and_long(spark):
    short, long = " ".join(f"a{i}" for i in range(5)), " ".join(f"b{i}" for i in range(3000))
    r = spark.createDataFrame([(short, long)], "a string, b string")
    s = fingerprints.sketch
    m, low = r.select(fingerprints.merged(s(r.a), s(r.b)), s(r.b)).first()
    assert set(low) <= set(m) and max(m) < 2**63 / 8
