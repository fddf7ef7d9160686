import hashlib
import zlib

from pyspark.sql import functions as F

from accordant.llm import media_sequences as M


def test_parse_keeps_order_and_captions():
    html = """<title>T</title><p>one <b>two</b></p><figure><img src="x"><figcaption>cap &amp; more</figcaption></figure>
      <script>no()</script><figure><figcaption>before</figcaption><img src=y alt=z></figure>tail<img src=w alt="alt"><figure><figcaption>alone</figcaption></figure>"""
    got = [(i["position"], i["kind"], i["text"], i["src"], i["caption"]) for i in M.parse(html)]
    assert got == [(0, "text", "T", None, None), (1, "text", "one two", None, None), (2, "media", None, "x", "cap & more"), (3, "media", None, "y", "before"), (4, "text", "tail", None, None), (5, "media", None, "w", "alt"), (6, "text", "alone", None, None)]
    assert M.parse(None) == M.parse("") == []


def test_query_is_lossless(spark, sf, texts):
    rows = M.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        stored = M.to_media(payload)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.media_bytes) == (len(raw), len(payload), zlib.crc32(payload[-64:]), len(stored))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())
        assert r.feature == M.feature(M.from_media(stored)) and r.caption == f"{len(raw)} bytes" and r.position == 3
        assert r.sequence == f"0:text:Document|1:media:mark:64|2:text:Its text:|3:media:{len(raw)} bytes:{len(payload)}|4:text:So it ends."


def test_feature_by_hand():
    payload = bytes([0, 255] * 32 + [16] * 64)
    # 64 columns; means: column sums 16 and 271 in turn, 143.5 on average; 32 samples of 0, 32 of 255, 64 of 16.
    histogram = [250, 500] + [0] * 13 + [250]
    assert M.feature(M.from_media(M.to_media(payload))) == f"2|{(255 * 32 + 16 * 64) * 1000 // 128}|{','.join(map(str, histogram))}|{'55' * 8}"


def items(html):
    return [(i["kind"], i["text"] or i["src"], i["caption"]) for i in M.parse(html)]


def test_open_elements_end_with_their_parents():
    assert items("<figure><img src=x><figcaption>cap</figure><p>rest</p>") == [("media", "x", "cap"), ("text", "rest", None)]
    assert items("<figure><img src=x><figcaption>cap") == [("media", "x", "cap")]
    assert items("<div>a<template>b</div><p>c</p>") == [("text", "a", None), ("text", "c", None)]
    assert items("a<noscript><img src=x><p>rest</p>") == [("text", "a", None), ("media", "x", None), ("text", "rest", None)]
    assert items("a<template>b</template>c<noscript>d") == [("text", "ac", None), ("text", "d", None)] or items("a<template>b</template>c<noscript>d") == [("text", "acd", None)]
    assert items("<figure><figcaption>one<figure><img src=y></figure>z") == [("text", "one", None), ("media", "y", None), ("text", "z", None)]
    assert items("<p>x</div></p></b>y") == [("text", "x", None), ("text", "y", None)]
    deep = items("<div>" * 50_000 + "end")
    assert deep == [("text", "end", None)]


def test_repeated_pages_and_clashing_names(spark, odd):
    store = M.features(M.stored_media(odd.withColumn("payload", M.payload_of(F.col("text"))).withColumn("digest", F.sha2("payload", 256)), "digest", "payload"))
    digest = store.first().digest
    html = f'a<img src="{M.SCHEME}{digest}" alt="c"><img src="{M.SCHEME}{digest}" alt="d">b'
    rows = [(1, html), (1, html), (1, f'<img src="{M.SCHEME}{digest}">'), (None, html), (None, None)]
    pages = M.sequences(spark.createDataFrame(rows, "page_id long, html string"), "page_id").withColumn("_row", F.lit("x")).withColumn("n", F.lit(1)).withColumn("digest", F.lit(2))
    out = M.interleave(pages, "page_id", store)
    got = out.collect()
    assert len(got) == 5 and set(out.columns) == {"page_id", "items", "n", "digest"}
    whole = [[(x.kind, x.caption, x.media and x.media.digest) for x in r["items"]] for r in got if len(r["items"]) == 4]
    assert whole == [[("text", None, None), ("media", "c", digest), ("media", "d", digest), ("text", None, None)]] * 3


def test_query_on_odd_rows(spark, odd, none, tmp_path):
    odd.withColumn("payload", F.lit("x")).withColumn("digest", F.lit(1)).write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = M.query(spark, f"{tmp_path}/a").collect()
    assert len(rows) == odd.count() and sum(r.n_bytes == 0 and r.payload_bytes == 64 for r in rows) == 3
    none.write.parquet(f"{tmp_path}/b/documents.parquet")
    assert M.query(spark, f"{tmp_path}/b").count() == 0


def test_pages_and_odd_rows(spark, sf, odd, none):
    store = M.features(M.stored_media(odd.withColumn("payload", M.payload_of(F.col("text"))).withColumn("digest", F.sha2("payload", 256)), "digest", "payload"))
    assert store.count() == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    digest = store.first().digest
    pages = spark.createDataFrame([(1, f'a<img src="{M.SCHEME}{digest}" alt="c">b'), (2, f'<img src="{M.SCHEME}{"0" * 64}">'), (3, None), (4, "<p>x")], "page_id long, html string")
    found = {r.page_id: r["items"] for r in M.interleave(M.sequences(pages, "page_id"), "page_id", store).collect()}
    assert [x.kind for x in found[1]] == ["text", "media", "text"] and found[1][1].media.digest == digest and found[1][1].media.feature and found[1][1].caption == "c"
    assert found[2][0].media.feature is None and found[3] == [] and found[4][0].media is None
    assert M.features(M.stored_media(none.select(F.col("text").alias("digest"), F.col("text").cast("binary").alias("payload")), "digest", "payload")).count() == 0
    real = M.sequences(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").filter("size(items) > 0")
    assert real.count() == spark.read.parquet(f"{sf}/pages.parquet").count()
