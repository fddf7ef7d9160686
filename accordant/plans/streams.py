"""Queries over recoverable streams and nested records, each with the SQL it is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from ..scratch import folder
from ..streaming import records as X
from . import store
from .fixtures import read

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\n]+', 0)"
#: What the stream writes of each turn: a record, and a candidate for each word of eight characters or more.
_TABLES = {
    "records": lambda b: b.select("conv_id", "turn", F.expr(f"cast(size({_WORDS}) as int)").alias("words"), F.expr("length(coalesce(text, ''))").alias("chars")),
    "candidates": lambda b: b.select("conv_id", "turn", F.posexplode(F.expr(_WORDS)).alias("place", "word")).filter("length(word) >= 8"),
}
_SCHEMAS = {"records": "conv_id long, turn long, words int, chars int", "candidates": "conv_id long, turn long, place int, word string"}


class Stopped(Exception):
    """A run that was ended in the middle of a batch."""


def _interrupted(number: int):
    """Ends the run in that batch, when its first table is written and the others and the commit aren't."""

    def wrap(write):
        def run(batch: DataFrame, n: int) -> None:
            if n == number:
                some = batch.limit(3)  # what was written before the end came, of this batch and wrong
                some.transform(_TABLES["records"]).write.mode("overwrite").parquet(f"{run.path}/records/batch={n}")
                raise Stopped(f"batch {n}")
            write(batch, n)

        return run

    return wrap


def record_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Records and candidates of all turns, by a stream in several batches whose second one dies on its way; then it is started again."""
    at = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    read(spark, sf, "conversations").repartition(6, "conv_id").write.parquet(f"{at}/source")
    written = spark.read.parquet(f"{at}/source")
    a_third = max(1, len(written.inputFiles()) // 3)
    source = lambda: spark.readStream.schema(written.schema).option("maxFilesPerTrigger", a_third).parquet(f"{at}/source")
    stop = _interrupted(1)

    def dying(write):
        run = stop(write)
        run.path = f"{at}/out"
        return run

    try:
        X.start(source(), f"{at}/out", _TABLES, wrap=dying).awaitTermination()
    except Exception as ended:
        if "Stopped" not in str(ended):
            raise
    X.start(source(), f"{at}/out", _TABLES).awaitTermination()
    tables = {n: X.read(spark, f"{at}/out", n, s) for n, s in _SCHEMAS.items()}
    records = tables["records"].select(F.lit("record").alias("kind"), "conv_id", "turn", F.col("words").alias("place"), F.col("chars").cast("string").alias("word"))
    return records.unionByName(tables["candidates"].select(F.lit("candidate").alias("kind"), "conv_id", "turn", "place", "word"))


def _event_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    final = F.when(F.col("id").endswith("1"), F.array(F.struct(F.lit(1).alias("a"), F.lit(2).alias("b")))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    return {
        "events": store.events(spark, sf).select("sentence_id", "event_id", "event_type", "predicate_lemma"),
        "candidate_relations": store.candidates(spark, sf).select("sentence_id", "candidate_id", "pair_a", "pair_b", "source_event_id"),
        "projection_plans": store.plans(spark, sf).select("sentence_id", "id", "source_event_id", "application_status", "reason_code", final.alias("final_pairs")),
    }


def records(spark: SparkSession, sf: str) -> DataFrame:
    """A record a sentence: its events, proposals with their decisions, and plans, as text."""
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sentences = store.sentences(spark, sf).select("sentence_id", "text", "label", F.size("pred_pairs").alias("predicted"), F.coalesce(F.size("gold_pairs"), F.lit(-1)).alias("gold"))
    tables = {name: R.bucketed(df, name, n) for name, df in {"sentences": sentences, **_event_tables(spark, sf)}.items()}
    rows = R.with_decisions(R.build(tables.pop("sentences"), tables))
    join = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *(F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields))), ";")
    return rows.select(
        "sentence_id", "text", "label", "predicted", "gold", join(F.col("events"), "event_id", "event_type", "predicate_lemma").alias("events"),
        join(F.sort_array("candidate_relations"), "candidate_id", "pair_a", "pair_b", "source_event_id", "decision").alias("candidate_relations"), join(F.col("projection_plans"), "id", "source_event_id", "application_status", "reason_code").alias("projection_plans"),
    )


def catalogue() -> dict[str, tuple]:
    text = lambda *fields: " || ':' || ".join(f"coalesce({f}::VARCHAR, '-')" for f in fields)
    words = r"regexp_extract_all(coalesce(text, ''), '[^ \n]+')"
    pair = "pair_a IS NOT NULL AND pair_b IS NOT NULL AND least(pair_a, pair_b) = 1 AND greatest(pair_a, pair_b) = 2"
    return {
        "K4_record_stream": (record_stream, f"""SELECT 'record' AS kind, conv_id, turn, len({words})::INT AS place, length(coalesce(text, ''))::VARCHAR AS word FROM conversations
            UNION ALL SELECT 'candidate', conv_id, turn, place, word FROM (SELECT conv_id, turn, unnest(range(len(w)))::INT AS place, unnest(w) AS word FROM (SELECT conv_id, turn, {words} AS w FROM conversations)) WHERE length(word) >= 8"""),
        "P21_records": (records, store.sql_over(f"""SELECT s.sentence_id, text, label, (SELECT count(*) FROM (SELECT DISTINCT x, y FROM given g WHERE g.sentence_id = s.sentence_id AND pred))::INT AS predicted, CASE WHEN released THEN (SELECT count(*) FROM (SELECT DISTINCT x, y FROM given g WHERE g.sentence_id = s.sentence_id AND gold))::INT ELSE -1 END AS gold,
            coalesce(e.t, '') AS events, coalesce(c.t, '') AS candidate_relations, coalesce(p.t, '') AS projection_plans FROM sentences s
            LEFT JOIN (SELECT sentence_id, string_agg({text("event_id", "event_type", "predicate_lemma")}, ';' ORDER BY event_id, event_type, predicate_lemma) AS t FROM event_rows GROUP BY ALL) e USING (sentence_id)
            LEFT JOIN (SELECT sentence_id, string_agg({text("candidate_id", "pair_a", "pair_b", "source_event_id", "decided")}, ';' ORDER BY candidate_id, pair_a NULLS FIRST, pair_b NULLS FIRST, source_event_id NULLS FIRST, decided) AS t FROM (SELECT c.*, CASE WHEN {pair} AND EXISTS (SELECT 1 FROM plans q WHERE q.sentence_id = c.sentence_id AND q.source_event_id = c.source_event_id AND ends_with(q.id, '1')) THEN 'applied'
                WHEN o.status IN ('review_only', 'not_applied') THEN o.status ELSE 'not_selected' END AS decided FROM candidates c LEFT JOIN (SELECT sentence_id, source_event_id, list(application_status ORDER BY id, source_event_id, application_status NULLS FIRST, reason_code NULLS FIRST)[1] AS status FROM plans GROUP BY ALL) o ON o.sentence_id = c.sentence_id AND o.source_event_id = c.source_event_id) GROUP BY ALL) c USING (sentence_id)
            LEFT JOIN (SELECT sentence_id, string_agg({text("id", "source_event_id", "application_status", "reason_code")}, ';' ORDER BY id, source_event_id NULLS FIRST, application_status NULLS FIRST, reason_code NULLS FIRST) AS t FROM plans GROUP BY ALL) p USING (sentence_id)""")),
    }
