"""The mixing stage returns the columns of its documents, also those with the operator's own names."""

import corpus_pipeline

NAMES = ("size", "source_size", "target", "copies", "taken")


def test_columns_with_the_operators_names_pass_through(spark):
    own = [f"{i} + id as {c}" for i, c in enumerate(NAMES)]
    docs = spark.range(40).selectExpr("id as doc_id", "concat('some words of text ', id) as text", "concat('s', id % 3) as source", *own)
    out = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "")
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == i + r["doc_id"] for r in rows for i, c in enumerate(NAMES))
