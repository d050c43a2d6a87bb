"""Registered queries: SQL twins, contract columns, and the pipeline's stages."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataq.llm import decontaminate, jaccard, pii, registry, toxicity
from strataq.llm.common import Store, table

from ..oracle import assert_same, connect
from .test_ops import slow_components

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, key):
    assert_same(registry.queries()[key](spark, FOLDER), connect(FOLDER), registry.oracle_sql()[key])


def test_jaccard_query_equals_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in registry.queries()["op10_jaccard"](spark, FOLDER).collect()) == slow_components(rows)


def test_pipeline_stages(spark):
    """Each stage against a plain judgement of its own input."""
    docs, store = table(spark, FOLDER, "documents"), Store(spark, "test")
    model = toxicity.train(docs, table(spark, FOLDER, "labels"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = store.put(stage(spark, docs, FOLDER))
        after = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            want = {r.doc_id for r in before if model.score(r.text) < toxicity.THRESHOLD}
        elif name == "near copies":
            want = {c for _, _, c in slow_components([(r.doc_id, r.text) for r in before])}
        elif name == "decontamination":
            m = decontaminate.Matcher([(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()])
            want = {r.doc_id for r in before if not decontaminate.verdict(*m.scan(r.text))[3]}
        elif name == "personal data":
            made = pii.Surrogates()
            want = {r.doc_id for r in before}
            assert all(after[r.doc_id].text == pii.replace(r.text, made)[0] for r in before)
        else:
            assert set(after) <= {r.doc_id for r in before}
            assert all(r.mix_taken == r.mix_size * r.mix_copies > 0 for r in after.values())
            continue
        assert set(after) == want and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert jaccard.jaccard_components(docs).count() == len(after)


def test_pipeline_over_odd_documents(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, and empty tables."""
    rng = random.Random(1)
    words = ["ba", "ke", "li", "mo", "nur", "ras", "sel", "tiv", "vog", "zum"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    one = text(60)
    rows = [(1, None), (2, ""), (3, " \n"), (4, text(20_000)), (5, one), (6, one), (6, one), (6, text(50)), (7, one + " ba"), (None, text(30)), (None, None), (8, "write to anna.b@corp.de " + text(30))]
    docs = spark.createDataFrame([(d, t, "en", None if d == 5 else f"s{(d or 0) % 2}", None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("node", F.lit(1)).withColumn("mix_size", F.lit("x")).withColumn("toxic", F.lit(0))
    labels = spark.createDataFrame([(d, 1, int(d == 4)) for d in range(9)] + [(None, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, text(40)), (None, one[:20]), (2, None)], "item_id long, text string")
    for name, table, n in (("whole", docs, None), ("none", docs.limit(0), 0)):
        folder = f"{tmp_path}/{name}"
        table.write.parquet(f"{folder}/documents.parquet")
        (labels if n is None else labels.limit(0)).write.parquet(f"{folder}/labels.parquet")
        (bench if n is None else bench.limit(0)).write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert len(out) == n if n is not None else {r.doc_id for r in out} <= {4, 5, 6, 7, 8, None} and all(r.mix_taken == r.mix_size * r.mix_copies > 0 for r in out)
        assert not any("anna.b@corp.de" in r.text for r in out)
