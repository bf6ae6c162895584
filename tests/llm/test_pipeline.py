"""The pipeline against plain Python over the same documents, stage by stage."""

import corpus_pipeline
from tessera.llm import bpe, language_id, toxicity
from tessera.llm.queries import vocabulary_path
from tests.conftest import SF
from tests.llm import odd
from tests.llm.test_simhash import groups, slow_fingerprint


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    left = {r.doc_id: r.text for r in docs.collect()}
    models = {}
    for name, stage in corpus_pipeline.STAGES:
        if name == "toxicity":
            score = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet")).scorer()
            left = {i: t for i, t in left.items() if score(t) < 0.5}
        elif name == "language_id":
            models[name] = language_id.fit(docs)
            left = {i: t for i, t in left.items() if not models[name].predict(t)[2]}
        elif name == "exact_dedup":
            keep = {}
            for i, t in left.items():
                keep[t] = max(i, keep.get(t, i))
            left = {i: t for t, i in keep.items()}
        elif name == "simhash":
            fps = {i: slow_fingerprint(t) for i, t in left.items()}
            pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
            root = groups(pairs, fps)
            left = {i: t for i, t in left.items() if root[i] == i}
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        if name != "packing":
            assert docs.columns == columns
            assert {r.doc_id: r.text for r in docs.collect()} == left, name
    encoder = bpe.Vocabulary(vocabulary_path("json")).encoder
    tokens = {i: len(encoder.encode([t])[0]) for i, t in left.items()}
    assert {r.doc_id: r.n_tokens for r in docs.collect()} == tokens
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(left)


def test_each_stage_survives_odd_rows(spark):
    for name, stage in corpus_pipeline.STAGES:
        for df in (odd.table(spark), odd.empty(spark)):
            out = stage(spark, df, SF)
            assert out.count() <= df.count()
            if name != "packing":
                assert out.schema == df.schema
