import hashlib
import itertools
import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

from accordant.llm import jaccard_forest as J


def sets_of(text, n=5):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = root[i], root[j]
            root = [a if r == b else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return sorted((rows[i][0] if rows[i][0] is not None else -1, least[root[i]], links[i]) for i in range(len(rows)))


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.n_links) for r in df.collect())


def test_prefix_is_shortened_to_the_measured_recall(spark, documents):
    signed = J._signatures(documents, J.WORDS, J.THRESHOLD, J.TREES, J.DEPTH, 1).cache()
    met = [k for r in signed.filter("met IS NOT NULL").collect() for k in r.met]
    assert len(met) > 300
    share = {k: sum(m >= k for m in met) / len(met) for k in range(1, J.DEPTH + 1)}
    for target in (0.9, 0.99, J.RECALL):
        k, got_share = J.matched_prefix(signed, J.TREES, J.DEPTH, J.THRESHOLD, target)
        assert got_share == share[k] >= target and (k == J.DEPTH or share[k + 1] < target)
    # The planted pairs are at the threshold, so their shares are those of the minima there.
    assert all(abs(share[k] - (1 - (1 - 0.8**k) ** J.TREES)) < 0.05 for k in share)
    none = signed.filter("met IS NULL AND false")
    assert J.matched_prefix(none, J.TREES, J.DEPTH, J.THRESHOLD, J.RECALL)[0] >= 1


def test_planted_sets_reach_the_threshold():
    for n in (5, 9, 40, 900):
        own = np.arange(n, dtype=np.uint64) * np.uint64(1 << 40)
        for x in J.planted(own, 0.8, 3, n):
            both = len(set(own.tolist()) & set(x.tolist()))
            assert 0.8 <= both / (len(own) + len(x) - both) < 0.8 + 2 / n + 1e-9
    assert J.planted(np.arange(3, dtype=np.uint64), 0.8, 2, 1) == []


def test_tries_meet_by_prefixes():
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(40)]
    sets += [np.concatenate([x[10:], rng.integers(0, 1 << 63, 10).astype(np.uint64)]) for x in sets]
    rows = J.signatures(np.concatenate(sets), np.arange(81) * 200, 6, 8)
    raw = [[r.tobytes() for r in x.astype(">u2")] for x in rows]
    for i, j in itertools.combinations(range(80), 2):
        longest = max(len(os.path.commonprefix([a, b])) // 2 for a, b in zip(raw[i], raw[j]))
        assert J.shared_prefix(rows[i][None], rows[j][None])[0] == longest


def test_documents(spark, sf, texts):
    assert got(J.query(spark, sf)) == brute(list(texts.items()))


def near_copies(n, seed=3):
    rng = random.Random(seed)
    base = [f"word{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"other{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_a_large_group_goes_in_blocks_and_loses_no_link(spark):
    rows = near_copies(90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.classes(df, block=16)) == got(J.classes(df)) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    clash = odd.withColumnRenamed("lang", "tkey").withColumnRenamed("source", "root").withColumnRenamed("n_chars", "n")
    out = [x for x in got(J.classes(clash)) if x[0] not in (-1,)]
    assert out == [x for x in brute(rows) if x[0] not in (-1,)]
    assert J.classes(none).count() == 0
    short = spark.createDataFrame([(1, "Two words"), (2, "two  WORDS!"), (3, "two other words"), (4, "...")], "doc_id long, text string")
    assert got(J.classes(short)) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_stage_keeps_one_of_each_class(spark, odd, documents, texts):
    kept = J.stage(spark, documents, "")
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute(list(texts.items()))})
    ids = [r.doc_id for r in J.stage(spark, odd, "").collect()]
    assert sorted(x for x in ids if x is not None) == [1, 3, 4, 5, 6, 7] and ids.count(None) == 2


def test_components(spark):
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    path = [(digest(f"{i}"), digest(f"{i + 1}")) for i in range(40)] + [("a", "b"), ("c", "b"), ("a", "a"), ("b", "a")]
    rows = J.components(spark.createDataFrame(path, "a string, b string"), "test").collect()
    assert len(rows) == len({r.node for r in rows}) == 44
    assert {r.root for r in rows if len(r.node) == 32} == {min(digest(f"{i}") for i in range(41))}
    assert {r.root for r in rows if len(r.node) == 1} == {"a"}
    numbered = [(f"{i}", f"{i + 1}") for i in range(6)]
    assert {r.root for r in J.components(spark.createDataFrame(numbered, "a string, b string"), "test").collect()} == {"0"}
    assert J.components(spark.createDataFrame([], "a string, b string"), "test").count() == 0


def test_signatures_do_not_depend_on_batches(spark, documents):
    made = lambda df: {r.doc_id: (r.signature, r.met) for r in J._signatures(df, 5, 0.8, 4, 3, 2).collect()}
    one = made(documents.limit(30).coalesce(1))
    assert one == made(documents.limit(30).repartition(7)) and any(m for _, m in one.values())
    assert not made(documents.filter(F.lit(False)))


def test_repeated_rows_are_one_text_and_hubs_are_joined(spark):
    rows = near_copies(40) + [near_copies(40)[0]] * 60
    assert got(J.classes(spark.createDataFrame(rows, "doc_id long, text string"), block=16)) == brute(rows)


def test_stage_keeps_each_text_of_a_repeated_id(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(40)) for w in ("one", "two", "three", "four"))
    rows = [
        (1, one, "a"),
        (2, one + " more", "near copy of 1"),
        (2, two, "b"),
        (2, two, "copy"),
        (3, three, "c"),
        (3, three + " more", "near copy, the same id"),
        (None, one, "copy of 1"),
        (None, four, "d"),
        (None, four + " more", "near copy of d"),
        (None, four, "copy of d"),
        (None, None, "e"),
        (None, "", "f"),
        (4, "", "g"),
        (4, None, "h"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    kept = J.stage(spark, df, "").collect()
    assert [(r.doc_id, r.text) for r in kept if r.doc_id in (1, 2)] in ([(1, one), (2, two)], [(2, two), (1, one)])
    assert sum(r.doc_id == 3 for r in kept) == 1 and {r.text for r in kept if r.doc_id == 4} == {"", None}
    nameless = [r.text for r in kept if r.doc_id is None]
    assert len(nameless) == 3 and {None, ""} < set(nameless) and (set(nameless) - {None, ""}) < {four, four + " more"}


def test_every_text_gets_planted_pairs(spark, monkeypatch):
    """The prefix is measured on all texts, however many there are: none of them is drawn."""
    seen = []
    whole = J.matched_prefix
    monkeypatch.setattr(J, "matched_prefix", lambda signed, *a: seen.append(signed.filter("size(met) = 2").count()) or whole(signed, *a))
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 12), k -> concat('w', id * 31 + k))) AS text")
    J._linked(docs, J.WORDS, J.THRESHOLD, J.TREES, J.DEPTH, J.RECALL, J.BLOCK)
    assert seen == [5000]
