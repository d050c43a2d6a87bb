"""Text search over whole texts."""

from strataq.operators.text import chunks, tfidf_search


def test_passage_late_in_a_long_text_is_found(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum " * 5_000 + "quasar"), (2, "lorem ipsum"), (3, ""), (4, None)], "doc_id long, text string")
    found = tfidf_search(chunks(docs, "doc_id", "text"), "quasar", "doc_id").collect()
    assert found and all(r.doc_id == 1 and r.offset > 40_000 for r in found)
