import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from accordant.llm import bpe_codec as B
from accordant.llm import token_counts as N
from accordant.llm.pretokens import Units

JSON, RANKS = public_tokenizers.path(N.VOCABULARY), public_tokenizers.path(B.VOCABULARY)
library = Tokenizer.from_file(JSON)
ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.ranks_of(RANKS), special_tokens={})
codec = B.Codec(RANKS)
text = st.text(st.sampled_from("abthe Zé漢1 \n\t  \x1c'.!<|>") | st.sampled_from(["<|endoftext|>", "  ", "'ll", " the"]).flatmap(lambda s: st.just(s[0])), max_size=40)
with_special = st.lists(text | st.just("<|endoftext|>") | st.just("  "), max_size=5).map("".join)


@given(st.lists(with_special, min_size=1, max_size=4))
@settings(max_examples=150, deadline=None)
def test_units_give_the_library_s_counts(texts):
    own, units = N.merger(JSON), Units(texts)
    got = units.sums(np.array([own.count(x) for x in units.distinct]))
    assert got.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@given(st.lists(with_special, min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_codec_gives_the_library_s_ids(texts):
    units = Units(texts)
    flat, n = codec.encode(units.distinct)
    ids, raw = np.split(flat, np.cumsum(n)[:-1]), codec.decode(flat, n)
    for i, t in enumerate(texts):
        run = units.index[units.offset[i] : units.offset[i + 1]]
        assert [x for k in run for x in ids[k].tolist()] == ranked.encode_ordinary(t)
        assert b"".join(raw[k] for k in run) == t.encode() and n[run].sum() == len(ranked.encode_ordinary(t))


def one_word(raw):
    return tiktoken.Encoding("one", pat_str=r"(?s).+", mergeable_ranks=B.ranks_of(RANKS), special_tokens={})._core_bpe.encode_single_piece(raw)


@given(st.lists(st.binary(max_size=400) | st.text(st.sampled_from("aeinrst"), max_size=600).map(str.encode) | st.lists(st.sampled_from([b"the", b"ing", b"a", b"     ", b"==", b"tion"]), max_size=120).map(b"".join), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_long_words_are_joined_at_their_seams(words):
    got = codec.contract([w for w in words if w])
    assert got == [codec.merged([w])[0] for w in words if w]
    assert [x for w, x in zip(filter(None, words), got) if w not in codec.ranks] == [one_word(w) for w in words if w and w not in codec.ranks]


def test_words_of_a_hundred_thousand_bytes(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("etaoinshrdlucmfwyp"), 100_000)), "a" * 100_000, "=" * 99_999, "é漢" * 20_000]
    began = time.time()
    rows = B.encode(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), RANKS).collect()
    assert time.time() - began < 120
    for r in rows:
        ids = ranked.encode_ordinary(r.text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_counts_of_whole_texts(spark, sf, texts):
    for r in N.query(spark, sf).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_codec_of_whole_texts(spark, sf, texts):
    for r in B.query(spark, sf).collect():
        ids = ranked.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark, odd, none):
    clash = odd.withColumn("N_tokens", F.lit("x"))
    counts = N.count_tokens(clash, JSON).collect()
    assert len(counts) == odd.count()
    for r in counts:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
    for r in B.encode(clash, RANKS, with_ids=True).collect():
        assert list(r.ids) == ranked.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert N.count_tokens(none, JSON).count() == B.encode(none, RANKS).count() == 0


def test_decode(spark):
    ids = ranked.encode_ordinary("ein Text, wie er ist: 漢字 ")
    df = spark.createDataFrame([(1, ids), (2, []), (3, None)], "i int, ids array<int>")
    got = {r.i: r.decoded for r in B.decode(df, RANKS).collect()}
    assert bytes(got[1]).decode() == "ein Text, wie er ist: 漢字 " and bytes(got[2]) == b"" and got[3] is None
    with pytest.raises(Exception, match="not in the vocabulary"):
        B.decode(spark.createDataFrame([(1, [10**6])], "i int, ids array<int>"), RANKS).collect()
