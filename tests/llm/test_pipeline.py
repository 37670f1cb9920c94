"""The pipeline's stages and run() against the same decisions made by brute force."""

import pyarrow.parquet as pq

import corpus_pipeline
from gridloom.llm import decontam, secrets
from tests.llm.test_corpus import base
from tests.llm.test_similar import kept

SF = "/root/testdata/sf0.001"


def test_run(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    docs = [r for r in table if any(c.isalpha() for c in r["text"] or "")]
    stays = {i for _, i in kept([(r["doc_id"], r["text"], None) for r in docs])}
    docs = [r for r in docs if r["doc_id"] in stays]
    a = decontam.automaton(decontam.windows_of(bench, 10))
    docs = [r for r in docs if not decontam.hits_of(r["text"].encode(), a)[1]]
    assert 0 < len(docs) < len(table)
    pieces = corpus_pipeline.run(spark, SF).collect()
    tokens = {}
    for r in pieces:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens.keys() == {r["doc_id"] for r in docs}
    assert all(tokens[r.doc_id] == r.doc_tokens for r in pieces)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = out
    rows = docs.collect()
    assert rows and not any(base(r.text) for r in rows)
    assert all(len(r.text) == r.n_chars for r in rows)


def test_stages_on_awkward_rows(spark):
    from tests.llm.test_corpus import SCHEMA, awkward

    wide = spark.createDataFrame(awkward(), SCHEMA).selectExpr("*", "1 AS _keep", "2 AS component_id", "3 AS fp", "4 AS row")
    for docs in (wide, wide.limit(0)):
        before = docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, SF), "awkward")
            assert docs.columns == wide.columns
        kept = docs.count()
        assert kept <= before and (kept > 0) == (before > 0)
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == (kept > 0)
