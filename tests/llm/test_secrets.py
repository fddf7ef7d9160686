import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from accordant.llm import secrets as S
from accordant.llm.automaton import Rule, compile_rules

from ..oracle import assert_same

RULES = (*S.BASE, *S.FURTHER)
BITS = """password pass secret token Api_Key APIKEY api = : ' " AKIA AK ABCD1234EFGH 0123456789abcdef deadbeef ghp_ xoxb- AIza RSA_PRIVATE . / , é x t s - ----- -----BEGIN""".split()
BITS += [" ", "  ", "\n", "a" * 36, "RSA PRIVATE KEY-----", "PRIVATE KEY", "-----BEGIN ", "Z9_" * 12, " ", "K"]


def brute(text):
    """Spans by the regular expression engine, one kind after another."""
    out = []
    for k, r in enumerate(RULES):
        for m in re.finditer(r.pattern, text or "", (re.IGNORECASE | re.ASCII) if r.either_case else 0):
            if len(m[2] if r.tail else m[0]) >= r.least:
                out.append((m.start(), k, m.end()))
    say = lambda s: ",".join(f"{RULES[k].name}:{a}:{b}" for a, k, b in sorted(s))
    base = [x for x in out if x[1] < 3]
    return (*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(say(base).encode()).hexdigest(), say(out))


def test_sql(spark, sf):
    assert_same(S.query(spark, sf), S.oracle_sql(), sf)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table that has secrets
    got = {r.doc_id: tuple(r[1:]) for r in S.query(spark, sf).collect()}
    assert got == {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()} and any(r[4] for r in got.values())
    assert_same(S.query(spark, sf), S.oracle_sql(), sf)


def test_random_texts(spark):
    random.seed(8)
    texts = ["".join(random.choices(BITS, k=random.randrange(0, 40))) for _ in range(4000)]
    got = S.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    n = 0
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) == want, texts[r.doc_id]
        n += want[4].count(":")
    assert n > 4000


def test_too_short_is_spent(spark):
    text = "token = secret = abcdefghi; passwd='abcdefgh' AKIA12345678901 " + "0" * 31 + " secretoken=12345678"
    r = S.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    at = text.index("passwd"), text.index("token=")
    assert r.spans == f"assign:{at[0]}:{at[0] + 16},assign:{at[1]}:{len(text)}"


def test_odd_rows(spark, odd, none):
    out = S.find_secrets(odd.withColumn("spans", F.lit(1)).withColumn("N_hex", F.lit("x"))).collect()
    assert len(out) == odd.count() and {r.spans for r in out} == {""} and {r.base_sha256 for r in out} == {hashlib.sha256(b"").hexdigest()}
    assert S.find_secrets(none).count() == 0


def test_long_text_without_a_cut(spark):
    """No line end, no byte at which to cut: one lane for each."""
    rows = [(1, "0123456789abcdef" * 20000), (2, "token=" + "A/" * 100000 + " " * 50000 + "é" + "ghp_" + "b" * 36), (3, "secret" + " " * 30000 + "= 'abcdefgh'")]
    got = {r.doc_id: r.spans for r in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t)[4] for i, t in rows} and got[3] == "assign:0:30017"


def test_no_two_states_are_alike():
    a = compile_rules(S.BASE)
    table = a.table.reshape(a.states, -1)
    rows = {(*table[s].tolist(), *a.matches[:, s].tolist(), *a.marks[:, s].tolist()) for s in range(a.states)}
    assert len(rows) == a.states and not a.matches[:, 0].any()


@pytest.mark.parametrize("pattern", ["a*", "ab+c?d", "a+b", "(ab", "a)", "x[ab]*x[ab]*y", "a.b", "*a"])
def test_refused(pattern):
    with pytest.raises((ValueError, IndexError)):
        a = compile_rules((Rule("r", pattern, 1), Rule("s", "x", 1)))
        assert a is None, a
