"""Preference formatting of conversation pairs.

A pair has a chosen and a rejected conversation (turns of role and text). Their longest common prefix of turns, equal in
role and text, is rendered once as the prompt. What is left of each side is its completion, with a mask: the spans
(start, end; characters of the completion) that assistants wrote, which a loss would count. The template renders a
turn as `<|role|>`, a line end, its text and a line end; the span of a turn is its text and the line end after.

A pair is one row of the result, so its turns are gathered by one shuffle of the texts: repeated rows of a turn go before it, and
the prefix, the renderings and the masks are expressions over the sorted arrays. Turns are placed by their turn number (null
first), then role and text; repeated rows of a turn are one turn, and several turns of one number stand one after the other. A null role
renders as an empty one, a null text as an empty one. Where one side is missing its completion is null and the other side is all
completion; equal sides are all prompt. Texts are kept whole whatever their length; a pair must fit in a row. An empty table gives an
empty table. Only pair_id, side, turn, role and text are read of the input. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SIDES = ("chosen", "rejected")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n"))


def preferences(turns: DataFrame) -> DataFrame:
    """pair_id, n_prefix, prompt, and of each side the completion, its number of turns and its mask, of turns with pair_id, side (chosen or rejected), turn, role and text."""
    return formatted(turns.groupBy("pair_id").agg(*(F.sort_array(F.collect_set(F.when(F.col("side") == s, _turn()))).alias(s) for s in SIDES)))


def _turn() -> Column:
    empty = F.lit("")
    return F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))


def formatted(sides: DataFrame) -> DataFrame:
    """What preferences gives, of pairs whose sides are sorted arrays of turns (turn, role, text)."""
    plain = [F.transform(s, lambda x: F.struct(x["role"].alias("role"), rendered(x["role"], x["text"]).alias("line"))).alias(s) for s in SIDES]
    lines = sides.select("pair_id", *plain)
    # The first place at which the sides' turns differ; a shorter side differs from its end on.
    least = F.least(*(F.size(s) for s in SIDES))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["line"] == b["line"]), F.lit(False)))
    first = F.array_position(same, False).cast("int")
    cut = lines.withColumn("n_prefix", F.when(first > 0, first - 1).otherwise(least))

    def text(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda x: x["line"]), "")

    def mask(items: Column) -> Column:
        """Spans of the assistants' texts: the lengths before a turn are summed along the array."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc: Column, x: Column) -> Column:
            end = acc["at"] + F.char_length(x["line"])
            head = acc["at"] + F.char_length(x["role"]) + 5
            span = F.struct(head.alias("start"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(items, start, step, lambda acc: acc["spans"])

    out = [F.col("pair_id"), F.col("n_prefix"), text(F.slice("chosen", F.lit(1), F.col("n_prefix"))).alias("prompt")]
    for s in SIDES:
        has, items = F.size(s) > 0, F.slice(s, F.col("n_prefix") + 1, F.size(s))
        out += [
            F.when(has, text(items)).alias(f"{s}_completion"),
            F.when(has, F.size(items)).alias(f"{s}_turns"),
            F.when(has, mask(items)).alias(f"{s}_mask"),
        ]
    return cut.select(out)


def variants(turns: DataFrame) -> DataFrame:
    """Pairs made of whole conversations, for `formatted`: as they are (chosen), and up to their last assistant turn, which is cut to the
    first half of its characters (rejected). A conversation without an assistant turn stays whole on both sides."""
    whole = turns.groupBy(F.col("conv_id").alias("pair_id")).agg(F.sort_array(F.collect_set(_turn())).alias("chosen"))
    spoken = F.filter("chosen", lambda x: (x["role"] == "assistant") & x["turn"].isNotNull())
    last = F.array_max(F.transform(spoken, lambda x: x["turn"]))
    half = lambda x: F.substr(x["text"], F.lit(1), F.floor(F.char_length(x["text"]) / 2).cast("int"))
    kept = F.filter("chosen", lambda x: F.coalesce(x["turn"] <= last, F.lit(True)))
    cut = F.transform(kept, lambda x: x.withField("text", F.when((x["turn"] == last) & (x["role"] == "assistant"), half(x)).otherwise(x["text"])))
    return whole.withColumn("rejected", F.sort_array(F.array_distinct(cut)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation (chosen) and its variant with a cut last answer (rejected) are a pair; turns without a conversation's id have no pair and are left out."""
    turns = C.table(spark, sf_dir, "conversations").filter("conv_id IS NOT NULL")
    pairs = formatted(variants(turns))
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return pairs.select("pair_id", "n_prefix", "prompt", *(c for s in SIDES for c in (f"{s}_completion", f"{s}_turns", flat(F.col(f"{s}_mask")).alias(f"{s}_mask"))))


def oracle_sql() -> str:
    def side(s: str) -> str:
        return f"""string_agg(line, '' ORDER BY place) FILTER (side = '{s}' AND place >= n_prefix) AS {s}_text, bool_or(side = '{s}') AS has_{s},
            (count(*) FILTER (side = '{s}' AND place >= n_prefix))::INTEGER AS {s}_n,
            string_agg((head + length(role) + 5)::VARCHAR || '-' || (head + length(line))::VARCHAR, ',' ORDER BY place) FILTER (side = '{s}' AND place >= n_prefix AND role = 'assistant') AS {s}_spans"""

    out = ", ".join(
        f"CASE WHEN has_{s} THEN coalesce({s}_text, '') END AS {s}_completion, CASE WHEN has_{s} THEN {s}_n END AS {s}_turns, CASE WHEN has_{s} THEN coalesce({s}_spans, '') END AS {s}_mask"
        for s in SIDES
    )
    return f"""
    WITH l AS (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations WHERE conv_id IS NOT NULL)
    , t AS (SELECT DISTINCT conv_id AS pair_id, 'chosen' AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM l
            UNION SELECT conv_id, 'rejected', turn, coalesce(role, ''), coalesce(CASE WHEN turn = last AND role = 'assistant' THEN left(text, length(text) // 2) ELSE text END, '')
            FROM l WHERE coalesce(turn <= last, true))
    , r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) - 1 AS place, '<|' || role || '|>' || chr(10) || text || chr(10) AS line FROM t)
    , j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.place, b.place) AS place, a.role = b.role AND a.text = b.text AS same
            FROM (FROM r WHERE side = 'chosen') a FULL JOIN (FROM r WHERE side = 'rejected') b ON a.pair_id = b.pair_id AND a.place = b.place)
    , n AS (SELECT pair_id, coalesce(min(place) FILTER (same IS NOT TRUE), count(*))::INTEGER AS n_prefix FROM j GROUP BY pair_id)
    , p AS (SELECT r.*, n_prefix, coalesce(sum(length(line)) OVER (PARTITION BY r.pair_id, side, place >= n_prefix ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS head
            FROM r JOIN n ON r.pair_id = n.pair_id)
    , g AS (SELECT pair_id, min(n_prefix) AS n_prefix, coalesce(string_agg(line, '' ORDER BY place) FILTER (side = 'chosen' AND place < n_prefix), '') AS prompt,
            {side("chosen")}, {side("rejected")} FROM p GROUP BY pair_id)
    SELECT pair_id, n_prefix, prompt, {out} FROM g"""
