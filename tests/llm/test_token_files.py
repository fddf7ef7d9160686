import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from accordant.llm import common as C
from accordant.llm import range_coder as R
from accordant.llm import token_files as T

PATH = public_tokenizers.path(T.VOCABULARY)
library = Tokenizer.from_file(PATH)


def ids_of(text):
    return library.encode(text or "", add_special_tokens=False).ids + [T.END]


@given(st.lists(st.integers(0, 50256), max_size=400) | st.lists(st.sampled_from([1, 2, 3]), max_size=3000))
@settings(max_examples=60, deadline=None)
def test_round_trip(ids):
    assert R.decode(R.encode(np.array(ids, dtype=np.int64), 50257)).tolist() == ids


def test_a_predictable_block_is_small_and_a_random_one_little_larger():
    rng = np.random.default_rng(0)
    assert len(R.encode(np.tile([5, 6, 7], 40_000), 50257)) < 30_000
    assert len(R.encode(rng.integers(0, 50257, 100_000), 50257)) < 100_000 * 2.3


@pytest.mark.parametrize("change", [lambda b: b[:-1], lambda b: b[:50] + bytes([b[50] ^ 1]) + b[51:], lambda b: b"XXXX" + b[4:], lambda b: b""])
def test_damage_is_found(change):
    with pytest.raises(ValueError):
        R.decode(change(R.encode(np.arange(1000), 50257)))


@given(st.binary(max_size=60), st.binary(max_size=60))
def test_combined_checksums(a, b):
    assert T.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def expected(rows):
    out, start = [], 0
    for doc, text in rows:
        ids = ids_of(text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_of_whole_texts(spark, sf, texts):
    got = sorted(tuple(r)[:4] for r in T.query(spark, sf).collect())
    assert got == expected(sorted(texts.items()))


def test_long_documents_are_cut_and_joined(spark, texts):
    rows = sorted(texts.items())[:40]
    path = f"{C.scratch_dir(spark)}/cut-test"
    T.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), path, PATH, block=300, long=700)
    assert sorted(tuple(r) for r in T.documents_of(spark, path).collect()) == expected(rows)
    pieces = {}
    for r in sorted(T.read_ids(spark, path).collect(), key=lambda r: (r.part, r.block)):
        pieces.setdefault(r.doc_id, []).extend(r.ids)
    assert pieces == {d: ids_of(t) for d, t in rows}
    C.drop_stored(spark, path)


def test_odd_rows(spark, odd, none):
    path = f"{C.scratch_dir(spark)}/odd-test"
    T.write_ids(odd, path, PATH)
    got = T.documents_of(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, 1, 2, 2, 3, 4, 5, 6, 7]
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    by = {r.doc_id: r for r in got}
    assert by[3].n_tokens == by[4].n_tokens == 1 and by[6].n_tokens == len(ids_of(next(r.text for r in odd.collect() if r.doc_id == 6)))
    C.drop_stored(spark, path)
    T.write_ids(none, path, PATH)
    assert T.documents_of(spark, path).count() == 0
    C.drop_stored(spark, path)


def test_units_go_to_the_library_together():
    """Units of one space and letters are encoded many in a call; whatever has other white space or special strings stays as it is."""
    odd = ["", None, "a\nb  c", " x\n\ny ", "don't can't\t 's 's", "<|endoftext|> hi <|end", "a <|endoftext|>b", " x  y\x1c z \x85", "漢字 。 é\r\n", "  lead", "trail ", "\n", " ", "\n Ċ x", "x" * 300 + " " + "é" * 200]
    texts = [*odd, *(f"word{i} other{i}, {i}." for i in range(3000))]

    class Counted:
        given = 0

        def __getattr__(self, name):
            def call(some, **named):
                self.given += len(some)
                return getattr(library, name)(some, **named)

            return call

    own = T.Encoder(PATH)
    own.library = counted = Counted()
    ids, n = own.texts(texts, T.END)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [ids_of(x) for x in texts]
    assert counted.given < 3100  # the first units of the texts, which have no space, and a few calls


def test_units_are_numbered_once_and_long_ones_are_not_kept(monkeypatch):
    """Units joined without marks, across calls, with a cache that empties between them."""
    own = T.Encoder(PATH)
    for some in (["a b c b", " b\n\nc d", "\n b"], ["", None], ["x " + "long" * 40 + " y", "e f b d it's b! d.\n"], ["e b, d; it's. f? b!", "b. d.\nb. 1. é. é", " it's, 's."], [" f", "b " + "long" * 40 + " z.\nQ w"]):
        ids, n = own.texts(some, T.END)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [ids_of(x) for x in some]
        assert own.count == own.kept == len(own.known) + 1 and " " + "long" * 40 not in own.known
        monkeypatch.setattr(T, "UNITS", 9)


@given(st.lists(st.text(st.sampled_from(list("ab'sé.,! \n\t\r\x1c\x85  ​1٣漢<|")), max_size=30), max_size=12))
@settings(max_examples=200, deadline=None)
def test_joined_units_are_those_of_the_library(some):
    ids, n = T.encoder(PATH).texts(some, T.END)
    assert n.tolist() == [len(ids_of(x)) for x in some] and ids.tolist() == [i for x in some for i in ids_of(x)]


def test_a_block_steps_in_many_lanes():
    """A block of half a million ids takes 64 steps, each coding 8192 ids at once, and no more room than 16 bits an id that all are alike rare."""
    ids = np.random.default_rng(1).integers(0, 50257, 1 << 19)
    block = R.encode(ids, 50257)
    assert R._HEAD.unpack_from(block)[2] == 1 << 13 and len(block) < 2.1 * len(ids)
    assert (R.decode(block) == ids).all()


@pytest.mark.parametrize("n", [1, 63, 129, 8191, (1 << 13) * 64 + 5])
def test_carries_and_uneven_lanes(n):
    """Ids that the model names for long stretches and then fails at drive the lanes' numbers close to their upper ends."""
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.02, rng.integers(0, 50257, n), 50256)
    assert (R.decode(R.encode(ids, 50257)) == ids).all()
