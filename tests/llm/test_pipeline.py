"""The pipeline keeps the right documents, stage by stage, and hands the documents' columns on."""

import os

import pytest

import corpus_pipeline
from scanmill.llm.common import stored, table

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


def test_stages_hand_on_documents(spark):
    docs = table(spark, SF_DIR, "documents")
    columns, left = docs.columns, docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF_DIR), f"test-{name}")
        assert docs.columns == columns
        rows = docs.collect()
        assert len({r["doc_id"] for r in rows}) == len(rows) <= left
        assert all(texts[r["doc_id"]] == r["text"] for r in rows)
        left = len(rows)
        if name == "exact_dedup":
            folded = [(r["text"] or "").lower() for r in rows]
            assert len(set(folded)) == len(folded)
    assert left > 100
    name, stage = corpus_pipeline.STAGES[-1]
    pieces = stage(spark, docs, SF_DIR).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in rows}
    assert sum(p["length"] for p in pieces) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).columns[:3] == ["doc_id", "start", "length"]
