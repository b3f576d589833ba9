"""Deleted lines against all common runs of two documents, and short lines."""

import random

import brute

from packetloom.llm import line_dedup


def test_passages_that_a_document_repeats():
    def gone(a, b):
        return sorted(line_dedup.deleted(a, b, [35] * len(b), 30))

    assert gone([1, 9], [2, 9, 9, 3]) == [1, 2]
    assert gone([1, 9, 9, 4], [2, 9, 3]) == [1]
    assert gone([1, 9, 9, 4], [2, 9, 9, 3]) == [1, 2]


def test_all_common_runs():
    r = random.Random(1)
    for _ in range(2000):
        a, b = ([r.randrange(1, r.choice([4, 12])) for _ in range(r.randrange(14))] for _ in range(2))
        size = {x: r.choice([0, 3, 8, 20]) for x in range(13)}
        words = [size[x] for x in b]
        want = brute.common(a, b, words, 20)
        assert set(line_dedup.repeated(a, b, words, 20)) == want
        assert set(line_dedup.deleted(a, b, words, 20)) == brute.deleted(a, b, words, 20)


def test_repeated_passage_in_rows(spark):
    passage = " ".join(f"p{i}" for i in range(35))
    docs = [(1, f"one\n{passage}"), (2, f"two\n{passage}\n{passage}\nthree"), (3, f"four\n{passage}")]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 2, 3: 1}


def test_query_finds_short_blocks(spark, tmp_path):
    from packetloom.llm.queries import op2_line_dedup

    base = [f"line {i} has seven words of text" for i in range(12)]
    docs = [(1, "\n".join(base)), (2, "\n".join(x if i % 3 else f"edit {i}" for i, x in enumerate(base))), (3, "a short text"), (4, "a short text")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["n_removed"] for r in op2_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 8, 3: 0, 4: 1}


def test_repeated_blocks_of_several_lines(spark):
    """A block that the earlier document repeats, in later ones between lines of their own; and
    two words that differ in a thousand letters only."""
    block = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(3)]
    own = lambda n: " ".join(f"own{n}w{i}" for i in range(20))
    docs = [(1, "\n".join([*block, own(0), *block])), *((i, "\n".join([own(i), *block, own(10 + i)])) for i in (2, 3, 4))]
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    docs += [(5, f"{'x ' * 40}{bits}"), (6, f"{'x ' * 40}{bits.translate(str.maketrans('ab', 'ba'))}")]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 3, 3: 3, 4: 3, 5: 0, 6: 0}


def test_planted_blocks(spark):
    """Each block that is planted in many documents, once or more often, goes from all but the first."""
    r = random.Random(4)
    blocks = [[" ".join(f"b{b}l{k}w{i}" for i in range(12)) for k in range(4)] for b in range(20)]
    docs, planted = [], 0
    for d in range(150):
        parts = [[f"d{d}p{p} " + " ".join(str(r.random()) for _ in range(8))] for p in range(4)]
        for b in r.choices(range(20), k=3):
            parts.insert(r.randrange(len(parts) + 1), blocks[b])
        docs.append((d, "\n".join(x for p in parts for x in p)))
    seen = set()
    for d, text in docs:
        lines = text.split("\n")
        planted += sum(x in seen for x in lines)
        seen |= set(lines)
    got = line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    removed = sum(r["n_removed"] for r in got.collect())
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute.lines(docs))
    assert removed >= 0.9 * planted
