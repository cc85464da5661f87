"""Registered queries on whole small tables, and the pipeline, against plain statements of what they return."""

from __future__ import annotations

import corpus_pipeline
from eventwarden.llm import quality, queries, secrets
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def _documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def test_document_queries(spark):
    texts = _documents(spark)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = queries.op1_quality_rules(spark, SMALL).collect()
    assert {r.doc_id: tuple(r[c] for c in (*quality.COUNTS, "base_failed")) for r in rows} == {
        i: brute.quality_base(t) for i, t in texts.items()}
    for name, base in (("op2_secret_scan", brute.secret_base), ("op9_personal_data", brute.personal_base)):
        got = {r.doc_id: r for r in queries.QUERIES[name](spark, SMALL).collect()}
        assert got.keys() == texts.keys()
        for i, t in texts.items():
            told = brute.told(base(t))
            assert got[i].base_sha256 == brute.sha(told) and set(filter(None, told.split(","))) <= set(got[i].spans.split(","))
    got = {r.doc_id: tuple(r)[1:] for r in queries.op10_decontamination(spark, SMALL).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
    assert got == dict(zip(texts, brute.contamination(list(texts.values()), items)))


def test_pipeline_stages(spark, tmp_path):
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, kept = source, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
    assert all(d.columns == source.columns for d in kept[:-1])
    ids = [{r.doc_id: r.text for r in d.collect()} for d in kept[:-1]]
    start = _documents(spark)
    verdicts = {r.doc_id: r.kept for r in queries.op1_quality_rules(spark, SMALL).collect()}
    assert ids[0].keys() == {i for i, good in verdicts.items() if good}
    components = brute.components(list(ids[0]), list(ids[0].values()))
    assert ids[1].keys() == {c for _, n, c in components if n} | {i for i, n, _ in components if not n}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    judged = dict(zip(ids[1], brute.contamination(list(ids[1].values()), items)))
    assert ids[2].keys() == {i for i, v in judged.items() if not v[-1]}
    assert ids[3].keys() == ids[2].keys()
    for i, text in ids[3].items():
        assert (text == start[i]) == (not secrets.spans_of(start[i])) and not brute.secret_base(text)
    packed = kept[-1].collect()
    assert {r.doc_id for r in packed} == ids[3].keys()
    assert sum(r.n_tokens for r in packed) == sum(len(brute.SPACED.findall(t)) + 1 for t in ids[3].values())
    assert corpus_pipeline.run(spark, SMALL).count() == len(packed)
