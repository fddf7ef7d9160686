import random
import zlib

from pyspark.sql import functions as F

from accordant.llm import release as R

from ..oracle import database

SCHEMA = "conv_id long, turn long, role string, text string"


def test_sql(spark, sf):
    """By rows, as pandas would make floats of numbers that may be null."""
    got = R.query(spark, sf)
    want = database(sf).execute(f"SELECT {', '.join(got.columns)} FROM ({R.oracle_sql()})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def brute(rows):
    """The replay by plain loops, a conversation at a time."""
    out, by = [], {}
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            out.append((conv, turn, *[None] * 6))
        else:
            by.setdefault(conv, []).append((turn, zlib.crc32((text or "").encode())))
    for conv, turns in by.items():
        turns.sort()
        got = []
        for p, (turn, crc) in enumerate(turns):
            h = lambda k: zlib.crc32(f"{k}:{conv}:{turn}".encode())  # noqa: B023, E731
            arrival, d = 7 * p, h(0) % 5
            above = got[p - d] if 0 < d <= p else None
            if above and above[0] != "delivered":
                got.append(("blocked", 0, None, None, p, crc))
                continue
            now = first = max(arrival, above[3]) if above else arrival
            status, a = "dead", 1
            while True:
                if h(1) % 101 >= 50 or not (now < arrival + h(2) % 101 or h(a + 2) % 3 == 0):
                    status = "delivered"
                    break
                if a == 6:
                    break
                now += 20 * 2 ** (a - 1)
                a += 1
            got.append((status, a, first, now, p, crc))
        state, number = 0, {}
        for n, g in enumerate(sorted((g for g in got if g[0] == "delivered"), key=lambda g: (g[3], turns[g[4]][0], g[4])), 1):
            state += n * g[5]
            number[g[4]] = (n, state)
        out += [(conv, turns[g[4]][0], *g[:4], *number.get(g[4], (None, None))) for g in got]
    return sorted(map(repr, out))


def check(spark, rows):
    got = R.replay(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)
    return got


def test_long_conversation(spark):
    """One conversation has most rows, so that it lies in many ranges."""
    random.seed(2)
    rows = [(1, t, "user", f"text {t}") for t in range(3000)] + [(c, t, "user", f"é {c * t}") for c in range(2, 200) for t in range(random.randrange(1, 9))]
    random.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.status for r in got} == {"delivered", "dead", "blocked"} and max(r.attempts for r in got) == 6


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 5, "user", ""), (1, 5, "user", "a"), (1, 5, "user", "a"), (1, -3, None, "x"), (None, 1, "user", "x"), (2, None, "user", "x"), (None, None, None, None), (3, 9, "user", "long " * 50000)]
    rows += [(4, 1, "user", "same")] * 50
    check(spark, rows)


def test_empty_and_clashing(spark):
    assert R.replay(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "user", "y")], SCHEMA)
    more = df.withColumn("p", F.lit("a")).withColumn("Status", F.lit(1)).withColumn("part", F.lit(2)).withColumn("n", F.lit(3))
    assert sorted(R.replay(more).collect()) == sorted(R.replay(df).collect())


def test_state_wraps(spark):
    """release_no * crc32 summed beyond 2^63 goes on in two's complement."""
    rows = R.released(spark.createDataFrame([(1, t, t, 4294967295, "delivered", 1, t, t) for t in range(3)], "conv_id long, turn long, p long, crc long, status string, attempts int, first_at long, last_at long"))
    assert [r.state for r in rows.orderBy("turn").collect()] == [4294967295, 3 * 4294967295, 6 * 4294967295]
