from pyspark.sql import functions as F

from accordant.llm import preferences as P

from ..oracle import assert_same

SCHEMA = "pair_id long, side string, turn long, role string, text string"


def test_sql(spark, sf):
    assert_same(P.query(spark, sf), P.oracle_sql(), sf)


def test_the_query_renders_prompts(spark, sf):
    rows = P.query(spark, sf).collect()
    assert sum(r.n_prefix > 0 and r.prompt != "" for r in rows) > 0.9 * len(rows)
    assert sum(r.chosen_mask != r.rejected_mask for r in rows) > 0.6 * len(rows)


def test_long_pairs_and_clashing_names(spark):
    rows = [(1, s, i, "user" if i % 2 else "assistant", f"{i}" + ("x" if s == "chosen" and i >= 2900 else "")) for s in P.SIDES for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'q' AS prompt", "1 AS Chosen", "2 AS n_prefix")
    (r,) = P.preferences(df).collect()
    assert r.n_prefix == 2900 and len(r.chosen_mask) == 50 and r.rejected_turns == 100


def test_variants_of_odd_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 0, "assistant", "abcd"), (2, 1, "user", "gone"), (3, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("last", F.lit(9)).withColumn("n", F.lit(9))
    by = {r.pair_id: r for r in P.formatted(P.variants(turns)).collect()}
    assert by[1].n_prefix == 2 and by[1].chosen_completion == by[1].rejected_completion == ""
    assert by[2].n_prefix == 0 and by[2].rejected_completion == "<|assistant|>\nab\n" and by[2].chosen_turns == 2
    assert by[3].n_prefix == 1


def one(spark, rows):
    return P.preferences(spark.createDataFrame(rows, SCHEMA)).collect()


def test_common_prefix_and_masks(spark):
    rows = [(1, s, i, r, t) for s, last in (("chosen", "good"), ("rejected", "bad")) for i, (r, t) in enumerate([("system", "be kind"), ("user", "hi"), ("assistant", last)])]
    rows.append((1, "chosen", 3, "user", "thanks"))
    (r,) = one(spark, rows)
    assert r.n_prefix == 2 and r.prompt == "<|system|>\nbe kind\n<|user|>\nhi\n"
    assert r.chosen_completion == "<|assistant|>\ngood\n<|user|>\nthanks\n" and r.rejected_completion == "<|assistant|>\nbad\n"
    assert [r.chosen_completion[m.start : m.end] for m in r.chosen_mask] == ["good\n"]
    assert [r.rejected_completion[m.start : m.end] for m in r.rejected_mask] == ["bad\n"]
    assert (r.chosen_turns, r.rejected_turns) == (2, 1)


def test_a_difference_ends_the_prefix_for_good(spark):
    rows = [(1, "chosen", 0, "user", "a"), (1, "rejected", 0, "user", "b"), (1, "chosen", 1, "assistant", "c"), (1, "rejected", 1, "assistant", "c")]
    (r,) = one(spark, rows)
    assert r.n_prefix == 0 and r.prompt == "" and r.chosen_turns == 2


def test_equal_missing_null_and_repeated(spark):
    rows = [
        *[(1, s, 0, "user", "same") for s in ("chosen", "rejected", "chosen")],
        (2, "chosen", 0, "assistant", "alone"),
        (3, "rejected", None, None, None),
        (3, "chosen", 0, "", ""),
        (4, "chosen", 0, "user", "x" * 100_000),
        (4, "rejected", 0, "user", "x" * 100_000),
    ]
    by = {r.pair_id: r for r in one(spark, rows)}
    assert by[1].n_prefix == 1 and by[1].chosen_completion == by[1].rejected_completion == "" and by[1].chosen_mask == []
    assert by[2].rejected_completion is None and by[2].rejected_mask is None and by[2].chosen_completion == "<|assistant|>\nalone\n"
    assert by[3].n_prefix == 1 and by[3].prompt == "<||>\n\n"
    assert len(by[4].prompt) > 100_000
    assert one(spark, []) == []
