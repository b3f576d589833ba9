"""The pipeline's rows against brute-force stages over the small tables."""

from collections import defaultdict
from pathlib import Path

import brute
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    table = lambda name, *columns: [tuple(r.values()) for r in pq.read_table(f"{SF}/{name}.parquet", columns=list(columns)).to_pylist()]
    docs, labels, items = table("documents", "doc_id", "text"), table("labels", "doc_id", "quality"), table("benchmark", "item_id", "text")
    score = brute.quality(docs, labels)
    kept = [(d, t) for d, t in docs if score[d] >= 0.7]
    assert 0 < len(kept) < len(docs)
    cut = {d: "\n".join(x for i, x in enumerate(split) if i not in gone) for d, (split, gone) in brute.cut_lines(kept).items()}
    cut = {d: cut[d] for d in brute.near_copies(list(cut.items()))}
    hit = {r[0] for r in brute.benchmark(list(cut.items()), items) if r[5]}
    cut = {d: t for d, t in cut.items() if d not in hit}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {(d, k): len(ids[k * 4096 : (k + 1) * 4096]) for d, t in cut.items() for ids in [tokenizer.encode(t, add_special_tokens=False).ids + [1]] for k in range(-(-len(ids) // 4096))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): r["length"] for r in got} == want and len(got) == len(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == np.cumsum([0] + [n for _, n in sorted(b)])[:-1].tolist() and sum(n for _, n in b) <= 4096
    assert len(bins) <= -(-sum(want.values()) // 4096) + 1


def test_stages_keep_columns(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from packetloom.llm._engine import read

    docs = read(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
