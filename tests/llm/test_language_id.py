import numpy as np
from pyspark.sql import functions as F

from accordant.llm import language_id as L


def test_held_out_accuracy(spark, sf, documents):
    rows = L.query(spark, sf.replace("0.001", "0.01"))
    truth = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang")
    assert rows.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got = rows.filter("held_out").join(truth, "doc_id").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_fold_is_by_crc32(spark):
    import zlib

    rows = spark.range(200).toDF("doc_id").select("doc_id", L.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_prediction_reads_the_text_alone(spark, documents, odd):
    model = L.fit(documents)
    one = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(documents.limit(50), model).collect()}
    other = documents.limit(50).withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    assert one == {r.doc_id: (r.lang_pred, r.score) for r in L.identify(other.repartition(3), model).collect()}
    by = {r.doc_id: r for r in L.identify(odd, model).collect()}
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[3].score == 0 and not by[3].accepted
    assert by[1].score == by[2].score


def test_nothing_to_learn_from(spark, odd, none):
    assert L.fit(none) is None and L.fit(odd.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in L.identify(odd, None).collect()} == {"und"}
    assert L.identify(none, None).count() == 0


def test_training_is_bounded_and_repeats(documents):
    a, b = L.fit(documents, 40), L.fit(documents, 40)
    assert (a.logits == b.logits).all() and a.temperature == b.temperature


def test_stage_keeps_clean_documents(spark, documents):
    kept = L.stage(spark, documents, "")
    assert kept.columns == documents.columns and kept.count() >= 0.97 * documents.count()


def test_prediction_is_the_softmax_of_the_mean_embedding(documents):
    rows = documents.filter("lang IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").limit(90).collect()
    texts, labels = [r.text for r in rows], [r.lang for r in rows]
    languages = sorted(set(labels))
    table, weights, _ = L.descend(texts, labels, languages, 11)
    model = L.train(texts, labels)

    def mean(text):
        raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in (" " + text.lower() + " ").encode())
        found = []
        for n in (2, 3, 4):
            for i in range(len(raw) - n + 1):
                g = raw[i : i + n]
                if 32 in g[1:-1] or (g[0] == 32 and g[-1] == 32):
                    continue
                h = n
                for b in g:
                    h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
                    h ^= h >> 15
                found.append(table[(h * 0x9E3779B1 & 0xFFFFFFFF) >> 17].astype(float))
        return np.mean(found, axis=0)

    asked = [*texts[:40], "one", "é", "Straße? 12 ½", texts[0] * 300]
    lang, score, accepted = L.predict(model, asked)
    for text, a, b, ok in zip(asked, lang, score, accepted):
        z = mean(text) @ weights / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(p.max() - b) < 1e-3 and (a == languages[int(p.argmax())] or np.sort(p)[-2] > p.max() - 1e-3)
        assert ok == (b >= model.least)


def test_numerals_are_no_letters(documents):
    model = L.fit(documents, 200)
    lang, score, accepted = L.predict(model, ["½ ²", "12 ٣", "", None, "ª"])
    assert lang[:4] == ["und"] * 4 and lang[4] != "und" and not score[:4].any() and not accepted[:4].any()


def test_rejection_is_fitted(documents):
    model = L.fit(documents, 300)
    assert 0 < model.least < 1
    junk = ["zqx " * 3, "\u4e00\u4e8c\u4e09 \u56db", "\u0436\u0449 \u044b"]
    plain = [r.text for r in documents.filter("lang IS NOT NULL AND n_chars > 300").limit(60).collect()]
    _, a, _ = L.predict(model, junk)
    _, b, kept = L.predict(model, plain)
    assert a.mean() < b.mean() and kept.mean() >= 0.98


def test_one_id_with_many_texts_is_bounded(spark):
    rows = spark.range(5000).selectExpr("CAST(3 AS long) AS doc_id", "concat('text number ', chr(97 + id % 26), id) AS text", "'en' AS lang")
    seen = []
    train, L.train = L.train, lambda texts, labels: seen.append(len(texts))
    try:
        L.fit(rows, 300)
    finally:
        L.train = train
    assert seen == [300]


def test_clashing_names(spark, odd):
    out = L.identify(odd.withColumn("Lang_Pred", F.lit(1)).withColumn("score", F.lit("x")), None)
    assert out.columns == [*odd.columns, "lang_pred", "score", "accepted"] and out.count() == odd.count()


def test_stage_without_labels_keeps_all_rows(spark, documents):
    bare = documents.withColumn("lang", F.lit(None).cast("string"))
    assert L.stage(spark, bare, "").count() == documents.count()
