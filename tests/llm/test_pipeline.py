"""The corpus pipeline, stage by stage, on the smallest tables and on odd ones."""

import corpus_pipeline
import numpy as np
from kmerloom.llm import base, decontaminate, quality, simhash
from test_operators import ODD, SCHEMA, odd_documents, no_documents  # noqa: F401


def test_stages(spark, data):
    docs = base.table(spark, data, "documents")
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = base.written(stage(spark, docs, data), name)
        assert docs.columns == names
        assert 0 < docs.count() <= before
        before = docs.count()
    leaks = decontaminate.find_leaks(docs, base.table(spark, data, "benchmark"))
    assert leaks.count() == 0
    texts = [r["text"] for r in docs.collect()]
    assert len(set(texts)) == len(texts)
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert ids.count() == before and ids.where("n_tokens <> size(ids)").count() == 0


def test_clean_documents_stay(spark, data):
    docs, labels = base.table(spark, data, "documents"), base.table(spark, data, "labels")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    kept = corpus_pipeline.good_quality(spark, docs, data).join(good.select("doc_id"), "doc_id", "left_semi").count()
    assert kept >= 0.97 * good.count()
    assert corpus_pipeline.known_language(spark, good, data).count() >= 0.97 * good.count()


def test_stage_decisions_equal_the_operators(spark, data):
    docs, labels = base.table(spark, data, "documents"), base.table(spark, data, "labels")
    scored = {r["doc_id"] for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.good_quality(spark, docs, data).collect()} == scored
    leaky = {r["doc_id"] for r in decontaminate.find_leaks(docs, base.table(spark, data, "benchmark")).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.free_of_benchmark(spark, docs, data).collect()} == {r["doc_id"] for r in docs.collect()} - leaky


def test_odd_documents(spark, data):
    for make in (odd_documents, no_documents):
        docs = make(spark)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, data)
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert corpus_pipeline.token_ids(spark, docs, data).count() == docs.count()


def test_wide_fingerprints_follow_similarity():
    r = np.random.default_rng(0)
    for j in (0.8, 0.9, 0.5):
        n, inside = 2000, 0
        for _ in range(30):
            shared = int(n * 2 * j / (1 + j))
            words = [f"w{x}" for x in r.integers(0, 1 << 40, 2 * n - shared + 4)]
            a, b = words[: n + 4], words[: shared + 4] + words[n + 4 :]
            x, y = simhash.wide_fingerprints([simhash.shingle_set(" ".join(t)) for t in (a, b)])
            inside += int(np.bitwise_count(x ^ y).sum() <= simhash.WIDE_REACH)
        assert inside >= 25 if j >= 0.8 else inside == 0
