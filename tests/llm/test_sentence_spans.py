import random
import re

from pyspark.sql import functions as F

from accordant.llm import common as C
from accordant.llm import sentence_spans as S

from ..oracle import assert_same

P = ["Here begins a passage of several sentences.", "It stands in two documents word for word.", "Nothing in it was changed at all.", "So it must be found."]


def test_sql(spark, sf):
    assert_same(S.query(spark, sf), S.oracle_sql(), sf)


def brute(texts):
    """What is left of each text (by falling precedence), by plain strings."""
    cut, seen, out = re.compile(r"[.!?,;:][\x09-\x0D ]+|\n[\x09-\x0D ]*"), set(), []
    for text in texts:
        ends = [m.end() for m in cut.finditer(text)]
        pieces = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]
        real = [k for k, p in enumerate(pieces) if p.split()]
        parts = [pieces[k].strip() for k in real]
        words = [len(p.split()) for p in parts]
        found = set()
        for i in range(len(parts)):
            for r in range(1, S.MIN_WORDS + 1):
                if i + r <= len(parts) and sum(words[i : i + r]) >= S.MIN_WORDS:
                    found.add((i, i + r))
                    break
            for r in range(1, S.MIN_WORDS + 1):
                if i + 1 - r >= 0 and sum(words[i + 1 - r : i + 1]) >= S.MIN_WORDS:
                    found.add((i + 1 - r, i + 1))
                    break
        gone, fresh = set(), set()
        for a, b in sorted(found):
            if tuple(parts[a:b]) in seen | fresh:
                gone |= {real[k] for k in range(a, b)}
            fresh.add(tuple(parts[a:b]))
        seen |= fresh
        out.append("".join(p for k, p in enumerate(pieces) if k not in gone))
    return out


def test_brute_force(spark):
    random.seed(5)
    stock = [" ".join(random.choices("ab cd ef gh".split(), k=random.randrange(1, 9))) + random.choice([".", "!", ", then", ";", "\n", ""]) for _ in range(12)]
    texts = [random.choice([" ", "\n", "\n\n", "  \t"]).join(random.choices(stock, k=random.randrange(0, 14))) for _ in range(300)]
    got = S.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in got] == brute(texts) and sum(r.n_removed for r in got) > 200


def test_first_stays_and_later_goes(spark):
    rows = [
        (1, "An own start. " + " ".join(P) + " An own end."),
        (2, "Another start here.\n\n" + "\n".join(P) + "\n  Another end here."),
        (3, " ".join(P) + " Middle words. " + " ".join(P[:3])),
        (4, "Only one of them is here. " + P[0] + " This is not enough to be a span."),
    ]
    got = {r.doc_id: r for r in S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert got[2].text == "Another start here.\n\nAnother end here." and got[2].n_removed == 4
    assert got[3].text == "Middle words. " and got[3].n_sentences == 8
    assert got[4].text == rows[3][1]


def test_few_words_are_no_span(spark):
    df = spark.createDataFrame([(1, "Yes. No. Yes."), (2, "Yes. No. Yes.")], "doc_id long, text string")
    assert {r.n_removed for r in S.without_repeats(df).collect()} == {0}


def test_short_clauses(spark):
    """A passage of 60 clauses of two words, one of 60 of a word, and 40 lines of two words, each in two documents."""
    passages = [" ".join(f"{k}{i} go," for i in range(60)) for k in "ab"] + [" ".join(f"w{i};" for i in range(60)), "\n".join(f"line {i}" for i in range(40))]
    rows = [(2 * i + j, f"An own start of {2 * i + j}.\n{p}\nAn own end {2 * i + j}.") for i, p in enumerate(passages) for j in range(2)]
    got = {r.doc_id: r for r in S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, n in enumerate((60, 60, 60, 40)):
        assert got[2 * i].n_removed == 0 and got[2 * i + 1].n_removed == n
        assert got[2 * i + 1].text == f"An own start of {2 * i + 1}.\nAn own end {2 * i + 1}."


def test_hot_keys_are_not_shuffled(spark):
    """Of a join on unique keys only the rows of other keys reach the shuffle."""
    left = spark.range(90000).select(F.when(F.col("id") < 60000, 0).otherwise(F.col("id")).alias("k"), "id")
    right, _ = C.store(left.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "test-unique")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for how in ("inner", "left"):
            rows = C.join_on_unique(left, right, ["k"], "n", 90000, how)
            sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p"), (F.col("k") == 0).alias("hot")).count().filter("NOT hot").collect()]
            hot = [r["count"] for r in rows.filter("k = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(sizes) == 30000 and max(sizes) < 2 * min(sizes)
            assert sum(hot) == 60000 and len(hot) > 1 and max(hot) < 40000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark, odd, none):
    out = S.without_repeats(odd.withColumn("n_removed", F.lit("x")).withColumn("Places", F.lit(1))).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_removed == 0 and [r.text for r in by[2]] == ["", ""] and by[3][0].text is None and by[4][0].text == "" and by[5][0].n_sentences == 0
    # The long text repeats itself: from its second sentence on a repeat covers it.
    assert by[6][0].n_sentences == 12000 and 1 <= by[6][0].n_sentences - by[6][0].n_removed <= 4
    assert S.without_repeats(none).count() == 0


def test_stage(spark, odd, documents):
    kept = S.stage(spark, documents, "")
    assert kept.columns == documents.columns
    rows = {r.doc_id: r for r in S.stage(spark, odd, "").collect() if r.doc_id is not None}
    assert set(rows) == {1, 3, 4, 5, 6, 7} and rows[6].n_chars == len(rows[6].text)


def test_passages_with_cut_ends(spark):
    """A passage of 53 words, cut at both ends by what stands around it, is for the most part removed; its surroundings stay as they were."""
    two = ["A first part of " + " ".join(f"word{i}" for i in range(16)) + ", with a clause of five.", "Then a second with " + " ".join(f"more{i}" for i in range(24)) + "."]
    assert len(" ".join(two).split()) == 53
    passage = " ".join(two)
    rows = [(1, f"The third is about other things {passage} It goes on alone."), (2, f"Unrelated is the fourth one.\n\n{passage} and closes\tby itself."), (3, "A pair of short ones. Is left alone here."), (4, "Sixth start. A pair of short ones. Is left alone here.")]
    got = {r.doc_id: r.text for r in S.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert {i: got[i] for i in (1, 3, 4)} == {r[0]: r[1] for r in rows if r[0] != 2}
    assert got[2].startswith("Unrelated is the fourth one.\n\n") and got[2].endswith("and closes\tby itself.") and len(got[2].split()) < 5 + 3 + 53 // 2 + 18
