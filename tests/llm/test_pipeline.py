"""Each stage of the pipeline against what it should do to its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import ngram_join, shared, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = shared.table(spark, SF, "documents")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "mixing", "packing"]
    by = dict(corpus_pipeline.STAGES)
    model = toxicity.fit(docs, shared.table(spark, SF, "labels"), toxicity.third() != 1)
    clean = shared.cut(by["toxicity"](spark, docs, SF), "t")
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect() if model.score(r.text) < toxicity.THRESHOLD}
    single = shared.cut(by["near_copies"](spark, clean, SF), "t")
    classes = ngram_join.similarity_classes(clean).collect()
    assert single.columns == columns and {r.doc_id for r in single.collect()} == {r.class_id for r in classes}
    mixed = shared.cut(by["mixing"](spark, single, SF), "t")
    assert mixed.columns == columns and sorted(mixed.collect()) == sorted(single.collect())
    packed = by["packing"](spark, mixed, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in single.collect()}


def test_packing_keeps_the_order_of_the_mix(spark):
    mixed = shared.cut(spark.range(100).selectExpr("id as doc_id", "'a b' as text").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id"), "t")
    ordered = corpus_pipeline.in_written_order(mixed)
    assert [r.doc_id for r in ordered.orderBy(ordered._first + ordered._index).collect()] == list(range(100))


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_stages_on_odd_rows_and_columns(spark):
    """Nulls, empty and repeated rows, an empty table, names that stages use themselves: every stage's defined result."""
    rows = [(1, "alpha beta gamma delta epsilon", None), (1, "alpha beta gamma delta epsilon", "a"), (2, "alpha beta gamma delta epsilon", "a"), (None, None, "b"), (3, "", "b"), (4, "w " * 20_000, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit("K").alias(c) for c in ("_score", "score", "_k", "_key", "_run", "_file", "row", "lang", "n_chars")])
    docs, empty = shared.cut(odd, "t"), shared.cut(odd.limit(0), "t")
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = shared.cut(stage(spark, docs, SF), "t"), shared.cut(stage(spark, empty, SF), "t")
        assert empty.count() == 0
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == {1, None, 3, 4}
        else:
            assert docs.columns == odd.columns and docs.count() == (len(rows) if name == "toxicity" else len(rows) - 2)
