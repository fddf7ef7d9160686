from pyspark.sql import functions as F

import corpus_pipeline as P
from accordant.llm import jaccard_forest, sentence_spans


def test_stages(spark, sf, documents):
    docs = documents
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == documents.columns, name
        assert 0 < kept.count() <= docs.count()
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    assert jaccard_forest.classes(docs).filter("n_copies > 1").count() == 0
    # Cutting can bring sentences together, but no span that was there before stands in two documents.
    assert sentence_spans.without_repeats(docs).agg({"n_removed": "sum"}).first()[0] <= docs.count()
    packed = P.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, packed.collect()))


def test_empty_table(spark, none):
    docs = none
    for _, stage in P.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0


def test_odd_rows_and_clashing_names(spark, odd, documents, tmp_path):
    clash = {n: F.lit(i) for i, n in enumerate(("kept", "score", "tkey", "root", "n_removed", "piece", "_doc", "cluster"))}
    both = documents.limit(60).unionByName(odd).withColumns(clash)
    both.write.parquet(f"{tmp_path}/documents.parquet")
    docs = both
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == both.columns, name
        rows = kept.collect()
        docs = spark.createDataFrame(rows, kept.schema)
        assert all(r.text for r in rows) and {tuple(r[n] for n in clash) for r in rows} == {tuple(range(len(clash)))}, name
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == {r.doc_id for r in docs.collect()}
