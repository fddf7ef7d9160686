import pytest
from pyspark.sql import functions as F

from accordant.operators import records as R
from accordant.streaming import records as X

TABLES = {"odd": lambda b: b.filter("id % 2 = 1"), "all": lambda b: b.select("id", (F.col("id") * 2).alias("double"))}
SCHEMAS = {"odd": "id long", "all": "id long, double long"}


def source(spark, at):
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def rows(spark, at):
    return {n: sorted(tuple(r) for r in X.read(spark, f"{at}/out", n, s).drop("batch").collect()) for n, s in SCHEMAS.items()}


def test_a_run_that_dies_in_a_batch_loses_and_repeats_nothing(spark, tmp_path):
    spark.range(0, 20, 1, 4).write.parquet(f"{tmp_path}/in")
    deaths = []

    def dying(after):
        """Ends the run in its third batch, after so many tables, or after all of them with the commit."""

        def wrap(write):
            def run(batch, n):
                if n == 2 and after < 2:
                    X.sink(f"{tmp_path}/other", TABLES)(batch, n)  # what was written elsewhere doesn't count
                    batch.limit(after + 1).transform(TABLES["odd"]).write.mode("overwrite").parquet(f"{tmp_path}/out/odd/batch={n}")
                else:
                    write(batch, n)
                if n == 2:
                    deaths.append(n)
                    raise RuntimeError("ended")

            return run

        return wrap

    for after in (0, 1, 2):
        with pytest.raises(Exception, match="ended"):
            X.start(source(spark, tmp_path), f"{tmp_path}/out", TABLES, wrap=dying(after)).awaitTermination()
    X.start(source(spark, tmp_path), f"{tmp_path}/out", TABLES).awaitTermination()
    assert len(deaths) == 3
    assert rows(spark, tmp_path) == {"odd": [(i,) for i in range(1, 20, 2)], "all": [(i, 2 * i) for i in range(20)]}
    assert sorted(r.batch for r in X.committed(spark, f"{tmp_path}/out").collect()) == [0, 1, 2, 3]
    # Later files go on where the stream stands.
    spark.range(20, 22, 1, 1).write.mode("append").parquet(f"{tmp_path}/in")
    X.start(source(spark, tmp_path), f"{tmp_path}/out", TABLES).awaitTermination()
    assert len(rows(spark, tmp_path)["all"]) == 22


def test_uncommitted_batches_are_not_read(spark, tmp_path):
    X.sink(f"{tmp_path}/out", TABLES)(spark.range(4), 0)
    spark.range(9).write.parquet(f"{tmp_path}/out/odd/batch=1")
    X.sink(f"{tmp_path}/out", TABLES)(spark.range(99), 0)  # committed before
    assert rows(spark, tmp_path) == {"odd": [(1,), (3,)], "all": [(i, 2 * i) for i in range(4)]}
    assert X.read(spark, f"{tmp_path}/none", "odd", "id long").count() == 0


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 3, 2), ("a", 2, 1), ("b", None, 0)], "k string, v int, batch long")
    assert sorted(map(tuple, X.latest(df, ["k"]).collect())) == [("a", 3), ("b", None)]


def tables(spark):
    sentences = spark.createDataFrame([("s1", "x"), ("s2", "y")], "sentence_id string, text string")
    proposals = spark.createDataFrame([("s1", "c1", 2, 1, "e1"), ("s1", "c2", 3, 1, "e1"), ("s1", "c3", 1, 2, "e9"), ("s1", "c4", None, 2, "e2"), ("s9", "c5", 1, 2, "e1")], "sentence_id string, candidate_id string, pair_a int, pair_b int, source_event_id string")
    plans = spark.createDataFrame([("s1", "p1", "e1", "not_applied", [(1, 2)]), ("s1", "p2", "e2", "review_only", []), ("s2", "p3", "e1", "applied", [])], "sentence_id string, id string, source_event_id string, application_status string, final_pairs array<struct<a:int,b:int>>")
    return sentences, {"candidate_relations": proposals, "projection_plans": plans}


def test_records(spark):
    sentences, more = tables(spark)
    got = {r.sentence_id: r for r in R.with_decisions(R.build(sentences, more)).collect()}
    assert set(got) == {"s1", "s2"} and got["s2"].candidate_relations == [] and got["s2"].projection_plans[0].id == "p3"
    assert [(c.candidate_id, c.decision) for c in got["s1"].candidate_relations] == [("c1", "applied"), ("c2", "not_applied"), ("c3", "not_selected"), ("c4", "review_only")]


def test_bucketed_tables_are_not_shuffled(spark):
    sentences, more = tables(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = {n: R.bucketed(df, n, 4) for n, df in {"sentences": sentences, **more}.items()}
        records = R.build(dealt["sentences"], {n: dealt[n] for n in more})
        assert plan(records).count("Exchange") == 0
        assert records.count() == 2
        assert plan(R.build(sentences, more)).count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_have_a_file_each(spark):
    """However many parts a table comes in, a bucket is one file."""
    rows = spark.range(1000).selectExpr("concat('s', id) AS sentence_id", "id").repartition(7)
    table = R.bucketed(rows, "parts", 3)
    assert len(table.inputFiles()) == 3 and table.count() == 1000
