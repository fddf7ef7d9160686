from collections import Counter

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from accordant.llm import quality_rules as Q

from ..oracle import assert_same


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars = [len(w) for w in words]

    def covered(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        seen = Counter(grams)
        return {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + n)}

    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for i, x in enumerate(lines) if x in lines[:i]]
    return [
        len(words), sum(chars), sum(c in "#*$%&|<>" for c in text), len(again), len(covered(3)), *(sum(chars[j] for j in covered(n)) for n in Q.LIMITS),
        sum(len(w) for x in again for w in re.findall(r"[^\x20\x09-\x0D]+", x)), len(lines),
    ]


@given(st.lists(st.text(st.sampled_from("ab é#\n\t "), max_size=60), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_measures_are_those_of_brute_force(texts):
    got = Q.measure([t.encode() for t in texts])
    assert got.tolist() == [brute(t) for t in texts]


def test_sql(spark, sf):
    assert_same(Q.query(spark, sf), Q.oracle_sql(), sf)


def test_odd_rows(spark, odd, none):
    rows = Q.quality_rules(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[3].base_failed and not by[3].kept
    assert by[6].n_words == 14 * 4000 and not by[6].kept
    assert Q.quality_rules(none).count() == 0
    clash = Q.quality_rules(odd.withColumn("KEPT", F.lit("x")).withColumn("n_words", F.lit(None).cast("string")))
    assert [c for c in clash.columns if c.lower() == "kept"] == ["kept"] and dict(clash.dtypes)["n_words"] == "bigint"


def test_stage_keeps_columns_and_clean_documents(spark, documents):
    kept = Q.stage(spark, documents, "")
    assert kept.columns == documents.columns
    assert 0.8 * documents.count() < kept.count() < documents.count()
