from pyspark.sql import functions as F

from accordant.operators import report as R


def test_phrases(spark):
    keys = ["structural|AB|bind|to|verbal", "structural|AB|activate|by|passive", "relational|RELATIONAL|identity|_|verbal", "structural|AA|interact|_|reciprocal", "short"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(R.readable(F.col("k"))).collect()] == ["A bind to B", "B is activate (passive) by A", "A [identity] B", "A and B interact", "A  B"]


def test_types_and_labels(spark):
    df = spark.createDataFrame([("passive", "s"), ("compound_state", "s"), (None, "relational"), ("x", None)], "c string, e string")
    assert [r[0] for r in df.select(R.trigger_type(F.col("c"), F.col("e"))).collect()] == ["verb", "state", "relation", "other"]
    assert [r[0] for r in df.select(R.public_label(F.col("c"), {"x": "named"})).collect()] == ["passive", "compound state", None, "named"]


def test_words_and_page(spark):
    df = spark.createDataFrame([("bind", "verb", 2), ("bind", "noun", 5), ("bind", "verb", 1), ("<b>", "verb", 1)], "w string, k string, n long")
    rows = {r.w: r for r in R.trigger_words(df, "w", "k", "n").collect()}
    assert (rows["bind"].total, rows["bind"].kinds) == (8, "noun=5, verb=3")
    page = R.evidence_page(df.orderBy("w", "n"), ["w", "n"], "T & x", limit=2)
    assert "&lt;b&gt;" in page and "T &amp; x" in page and page.count("<tr>") == 3
