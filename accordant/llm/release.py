"""Quarantine and cascading release: turns that wait for their parent, retry, die or block what hangs on them.

A conversation's turns, numbered p from 0 by turn, arrive at second SPACING * p. h(k) is the crc32 of decimal `k:conv_id:turn`. A turn's
parent is h(0) % 5 turns earlier; a distance of 0, or one before the first turn, is none. A turn with h(1) % 101 < 50 is faulty until
h(2) % 101 seconds after its arrival. Attempt 1 comes at arrival or at the parent's delivery, whichever is later; attempt a of a faulty turn fails
before its repair or if h(a + 2) % 3 = 0, and is repeated 20 * 2^(a-1) seconds later; ATTEMPTS failures mean dead. Children of
dead or blocked parents are blocked.

Level by level: the roots are resolved, and each resolved depth is joined to its children by (conversation, parent position),
where the outcome is one expression of the parent's delivery. A level is one join of what is still open with the depth resolved
last; its rows, resolved or still open, are written to the shared folder, which cuts the lineage. A turn has no parent with a probability of a fifth,
so what is open shrinks by a factor from level to level: all levels together move about five times the rows, and there are as many
of them as the longest chain has turns, some log(rows).

Numbers and sums within a conversation hold for conversations of any size, a third of all rows included: rows are dealt in ranges of
(conversation, order), windows run within a range, and what earlier ranges hold of the same conversation is added. Only conversations
that begin before their range need that: one a range at most, so that these go by a broadcast bounded by the number of ranges.

Rows of one conversation and turn share their hashes but are turns of their own, in the order of their texts' crc32. A row without conv_id or turn
belongs to no conversation: it gets a row whose results are null. A null text counts as empty in state. state is kept as 64 bits in two's complement.
An empty table gives an empty table. Further columns, of any name, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SPACING, ATTEMPTS, FIRST_WAIT = 7, 6, 20
#: Seconds from the first attempt to attempt a.
WAITS = [FIRST_WAIT * (2 ** (a - 1) - 1) for a in range(1, ATTEMPTS + 1)]
_TURN = ["conv_id", "turn", "p", "crc", "parent", "faulty", "repaired", "unlucky"]
_OUTCOME = ["status", "attempts", "first_at", "last_at"]


def h(k: int) -> Column:
    return F.crc32(F.concat(F.lit(f"{k}:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).cast("binary"))


def dealt(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df in ranges of (conv_id, *order), written to the shared folder with each row's range, as another run could cut the ranges elsewhere."""
    return C.store(df.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), name)[0]


def _within(order: list[str]) -> tuple[Window, Window]:
    """A row's conversation in its range, up to it; and that conversation's ranges before this one."""
    return Window.partitionBy("part", "conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, turn and crc of turns with both ids, and p."""
    order = ["turn", "crc", "tie"]
    rows = dealt(turns.select("conv_id", "turn", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("crc"), F.monotonically_increasing_id().alias("tie")), order, "turns")
    here, before = _within(order)
    earlier = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.sum("n").over(before)).filter("n > 0")
    return rows.withColumn("i", F.row_number().over(here)).join(F.broadcast(earlier), ["conv_id", "part"], "left").select("conv_id", "turn", "crc", (F.col("i") - 1 + F.coalesce("n", F.lit(0))).alias("p"))


def outcome(df: DataFrame, start: Column, blocked: Column, known: Column) -> DataFrame:
    """df with the columns of _OUTCOME: null unless known; start is the second of the first attempt."""
    works = [~F.col("faulty") | ((start + wait >= F.col("repaired")) & (F.col("unlucky").bitwiseAND(1 << a) == 0)) for a, wait in enumerate(WAITS)]
    attempts = F.coalesce(*(F.when(w, F.lit(a + 1)) for a, w in enumerate(works)), F.lit(ATTEMPTS))
    delivered = works[0]
    for w in works[1:]:
        delivered = delivered | w
    tried = known & ~blocked
    return df.withColumns(
        {
            "status": F.when(tried, F.when(delivered, "delivered").otherwise("dead")).when(known, "blocked"),
            "attempts": F.when(tried, attempts).when(known, F.lit(0)),
            "first_at": F.when(tried, start),
            "last_at": F.when(tried, start + F.element_at(F.array(*map(F.lit, WAITS)), attempts)),
        }
    )


def resolved(turns: DataFrame) -> DataFrame:
    """The columns of _TURN and _OUTCOME of numbered turns."""
    distance, arrival = h(0) % 5, F.col("p") * SPACING
    facts = turns.withColumns(
        {
            "parent": F.when((distance > 0) & (distance <= F.col("p")), F.col("p") - distance),
            "faulty": h(1) % 101 < 50,
            "repaired": arrival + h(2) % 101,
            "unlucky": sum((F.when(h(a + 3) % 3 == 0, F.lit(1 << a)).otherwise(F.lit(0)) for a in range(ATTEMPTS)), F.lit(0)),
        }
    )
    level, _ = C.store(outcome(facts, arrival, F.lit(False), F.col("parent").isNull()).select(*_TURN, *_OUTCOME), "level")
    done = [level.filter("status IS NOT NULL")]
    while not (waiting := level.filter("status IS NULL").select(*_TURN)).isEmpty():
        last = done[-1].select("conv_id", F.col("p").alias("parent"), F.col("status").alias("above"), F.col("last_at").alias("above_at"))
        joined = waiting.join(last, ["conv_id", "parent"], "left")
        next_ = outcome(joined, F.greatest(arrival, F.col("above_at")), F.col("above") != "delivered", F.col("above").isNotNull())
        level, _ = C.store(next_.select(*_TURN, *_OUTCOME), "level")
        done.append(level.filter("status IS NOT NULL"))
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    return out


def released(turns: DataFrame) -> DataFrame:
    """Resolved turns with release_no and state of the delivered ones."""
    order, delivered = ["last_at", "turn", "p"], F.col("status") == "delivered"
    wide = "decimal(38,0)"
    rows = dealt(turns.select("conv_id", "turn", "p", F.when(delivered, F.col("crc")).otherwise(0).alias("crc"), *_OUTCOME), order, "resolved")
    here, before = _within(order)
    rows = rows.withColumn("i", F.sum(F.when(delivered, 1).otherwise(0)).over(here))
    rows = rows.withColumns({"sum": F.sum("crc").over(here), "weighted": F.sum((F.col("i").cast(wide) * F.col("crc")).cast(wide)).over(here)})
    totals = rows.groupBy("conv_id", "part").agg(F.max("i").alias("n"), F.max("sum").alias("s"), F.max("weighted").alias("w")).withColumn("n_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = totals.withColumn("state_before", F.sum((F.col("n_before").cast(wide) * F.col("s")).cast(wide) + F.col("w")).over(before)).filter("n_before > 0").select("conv_id", "part", "n_before", "state_before")
    both = rows.join(F.broadcast(totals), ["conv_id", "part"], "left").withColumn("n_before", F.coalesce("n_before", F.lit(0)))
    state = F.coalesce(F.col("state_before"), F.lit(0).cast(wide)) + (F.col("n_before").cast(wide) * F.col("sum")).cast(wide) + F.col("weighted")
    half, whole = (F.lit(str(2**n)).cast("decimal(20,0)") for n in (63, 64))
    wrapped = (F.pmod((state.cast(wide) + half).cast(wide), whole) - half).cast("long")
    return both.select("conv_id", "turn", *_OUTCOME, F.when(delivered, F.col("n_before") + F.col("i")).alias("release_no"), F.when(delivered, wrapped).alias("state"))


def replay(turns: DataFrame) -> DataFrame:
    """conv_id, turn, status, attempts, first_at, last_at, release_no and state of each row."""
    turns = turns.select("conv_id", "turn", "text")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    out = released(resolved(numbered(turns.filter(known))))
    null = [F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields[2:]]
    return out.unionByName(turns.filter(~known).select("conv_id", "turn", *null))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(C.table(spark, sf_dir, "conversations"))


def _crc(text: str, table: str) -> str:
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(1, len({digits}) + 1, 2), lambda i: ('0x' || substr({digits}, i::INT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def oracle_sql() -> str:
    """The same by a recursion over parents and plain windows; crc32 by its table of 256 remainders, made by its rule. DuckDB's rows have both ids."""
    hashes = ", ".join(f"{_crc(f"'{k}:' || conv_id || ':' || turn", 't.t')} AS h{k}" for k in range(ATTEMPTS + 3))
    works = lambda start, a: f"(NOT faulty OR ({start} + {WAITS[a]} >= 7 * p + h2 % 101 AND h{a + 3} % 3 <> 0))"
    first = lambda start: "CASE " + " ".join(f"WHEN {works(start, a)} THEN {a + 1}" for a in range(ATTEMPTS)) + f" ELSE {ATTEMPTS + 1} END"
    return f"""
    WITH RECURSIVE t AS MATERIALIZED (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n))
    , d AS MATERIALIZED (SELECT conv_id, turn, {_crc("coalesce(text, '')", 't.t')} AS crc, {hashes} FROM conversations, t)
    , n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, crc) - 1 AS p, h1 % 101 < 50 AS faulty FROM d)
    , f AS MATERIALIZED (SELECT *, CASE WHEN h0 % 5 BETWEEN 1 AND p THEN p - h0 % 5 END AS parent FROM n)
    , r AS (SELECT conv_id, p, 7 * p AS first_at, {first("7 * p")} AS a FROM f WHERE parent IS NULL
            UNION ALL
            SELECT conv_id, p, first_at, CASE WHEN first_at IS NULL THEN 0 ELSE {first("first_at")} END FROM
                (SELECT f.*, CASE WHEN r.a BETWEEN 1 AND {ATTEMPTS} THEN greatest(7 * f.p, r.first_at + {WAITS}[r.a]) END AS first_at FROM r JOIN f ON f.conv_id = r.conv_id AND f.parent = r.p))
    , o AS (SELECT conv_id, turn, p, crc, first_at, CASE a WHEN 0 THEN 'blocked' WHEN {ATTEMPTS + 1} THEN 'dead' ELSE 'delivered' END AS status, least(a, {ATTEMPTS})::INT AS attempts,
            first_at + {WAITS}[least(a, {ATTEMPTS})] AS last_at FROM r JOIN f USING (conv_id, p))
    , z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY last_at, turn, p) AS release_no FROM o WHERE status = 'delivered')
    SELECT conv_id, turn, status, attempts, first_at, CASE WHEN status <> 'blocked' THEN last_at END AS last_at, NULL::BIGINT AS release_no, NULL::BIGINT AS state FROM o WHERE status <> 'delivered'
    UNION ALL
    SELECT conv_id, turn, status, attempts, first_at, last_at, release_no, (sum(release_no * crc) OVER (PARTITION BY conv_id ORDER BY release_no))::BIGINT FROM z"""
