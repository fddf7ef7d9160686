import random

from pyspark.sql import functions as F

from accordant.llm import packing as P


def brute(pieces, capacity):
    """Best fit by looking at every bin."""
    bins, where = [], []
    for size, source, cluster in pieces:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and not (b[1] & source or b[2] & cluster) and b[0] > 0]
        if fits:
            _, i = min(fits)
        else:
            bins.append([capacity, 0, 0])
            i = len(bins) - 1
        b = bins[i]
        bins[i] = [b[0] - size, b[1] | source, b[2] | cluster]
        where.append(i)
    return where


def test_the_tightest_compatible_bin_is_found():
    rng = random.Random(5)
    for n, sources in ((5, 2), (300, 3), (2000, 12)):
        pieces = [(rng.randint(1, 100), 1 << min(rng.randrange(sources), rng.randrange(sources)), rng.choice([0, 0, 0, 1 << rng.randrange(8)])) for _ in range(n)]
        pieces.sort(key=lambda p: -p[0])
        assert P.pack(pieces, 128) == brute(pieces, 128)


def check(df, docs, capacity):
    rows = df.collect()
    length, source = {}, {}
    for r in docs:
        length[r.doc_id] = length.get(r.doc_id, 0) + len((r.text or "").encode()) + 1
        source[r.doc_id] = r.source
    total = {}
    bins = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        bins.setdefault(r.bin_id, []).append(r)
    assert total == length
    for own in bins.values():
        own.sort(key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and sum(r.length for r in own) == own[0].bin_used <= capacity
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        named = [source[r.doc_id] for r in own if source[r.doc_id] is not None]
        assert len(named) == len(set(named))


def test_documents(spark, sf, documents):
    check(P.query(spark, sf), documents.collect(), P.CAPACITY)


def test_small_shards_and_odd_rows(spark, documents, odd, none):
    check(P.best_fit(documents, 1000, 16), documents.collect(), 1000)
    clash = odd.withColumn("shard", F.lit(1)).withColumn("length", F.lit(2)).withColumn("bin_id", F.lit("x"))
    check(P.best_fit(clash, 4096, 4), odd.collect(), 4096)
    assert P.best_fit(none).count() == 0


def test_copies_never_share_a_bin(spark):
    rows = [(i, "The  same text" if i % 2 else "the same TEXT", None) for i in range(20)]
    out = P.best_fit(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert out.select("bin_id").distinct().count() == 20


def test_sequences_hold_the_texts(spark, documents, texts):
    few = documents.filter("doc_id < 30")
    packed = P.best_fit(few, 2000)
    data = {r.bin_id: bytes(r.data) for r in P.sequences(few, packed, 2000).collect()}
    whole = {}
    for r in sorted(packed.collect(), key=lambda r: r.piece):
        whole[r.doc_id] = whole.get(r.doc_id, b"") + data[r.bin_id][r.start : r.start + r.length]
    assert whole == {d: texts[d].encode() + b"\0" for d in range(30)}
