"""Near copies against every pair's exact similarity."""

import random

import brute

from packetloom.llm import near_copies


def test_edited_copies(spark, documents, texts):
    """Copies edited in a few words, single and in a group larger than a hot bucket."""
    r = random.Random(5)
    docs = list(texts)
    for g, (length, copies) in enumerate([(60, 3), (120, 3), (300, 3), (80, 40), (6, 5), (9, 5), (1, 3)]):
        base = [f"g{g}w{r.randrange(500)}" for _ in range(length)]
        for k in range(copies):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2]) if length > 10 else k % 2):
                w[r.randrange(length)] = f"edit{r.randrange(10**6)}"
            docs.append((1000 + 100 * g + k, " ".join(w)))
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, key string").repartition(3)
    want = brute.near_copies(docs)
    assert len(want) < len(docs) - 60
    for hot in (256, near_copies.HOT_BUCKET):
        out = near_copies.one_of_each(df, hot=hot)
        assert out.columns == df.columns and sorted(x[0] for x in out.collect()) == want
    assert near_copies.one_of_each(documents.limit(0)).count() == 0


def test_stage_drops_edited_copy(spark):
    import corpus_pipeline

    base = [f"w{i}" for i in range(100)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(["new", *base[1:50], "other", *base[51:]]))], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert [x[0] for x in stage(spark, df, "").collect()] == [1]
