"""Scans of whole texts work on a portion of a batch at a time, and lose nothing by that."""

import pyarrow as pa
from pyspark.sql import functions as F

from packetloom.llm import _engine as E
from packetloom.llm import decontaminate, near_copies


def test_portions():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (10, 0, E.PORTION_BYTES, 5, 2 * E.PORTION_BYTES, 7)]})
    out = list(E.portions([batch, batch.slice(0, 0), batch.slice(0, 2)]))
    assert len(out) > 3 and pa.Table.from_batches(out).equals(pa.Table.from_batches([batch, batch.slice(0, 2)]))


def test_pipeline_scans(spark, documents, texts, monkeypatch):
    """The near-dedup's and decontamination's scans: bounded, equal rows, each text sent once."""
    seen, kind = [], type(documents)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, *rest: (seen.append((self.columns, f)), real(self, f, *rest))[1])
    copy = spark.createDataFrame([(d + 9000, " ".join(["new", *(t or "").split()])) for d, t in texts], "doc_id long, text string")
    near_copies.one_of_each(documents.select("doc_id", "text").union(copy))
    scans = [f for columns, f in seen if "text" in columns and "_p" not in columns]
    assert len(scans) >= 3  # frequent shingles, sets, sets of pairs
    seen.clear()
    decontaminate.clean(documents, spark.createDataFrame([(1, texts[20][1])], "item_id long, text string"))
    assert [columns for columns, _ in seen] == [documents.columns]
    table = documents.withColumn("_t", F.xxhash64("text")).toArrow().combine_chunks()
    for scan in [*scans, seen[0][1]]:
        monkeypatch.setattr(E, "PORTION_BYTES", 1 << 40, raising=False)
        whole = list(scan(iter(table.to_batches())))
        monkeypatch.setattr(E, "PORTION_BYTES", 2000, raising=False)
        out = list(scan(iter(table.to_batches())))
        assert len(out) > len(whole) and pa.Table.from_batches(out).equals(pa.Table.from_batches(whole))


def test_text_of_other_case(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d"), (3, None)], "doc_id long, Text string")
    out = decontaminate.clean(df, spark.createDataFrame([(1, "b c")], "item_id long, text string"))
    assert out.columns == df.columns and sorted(r[0] for r in out.collect()) == [2, 3]
