"""The driver's tables in the roles of a labelled corpus, as a DataFrame and as the same in SQL.

The observation ledger has a row a line item: corpus, sentence and document ids, an unordered pair, gold and predicted
labels, the parts of a pattern key, a carrier word (none for some), a decision and a place in the input (seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: name -> the same expression for both engines.
_COLUMNS = {
    "corpus": "concat('corpus', cast(l_suppkey % 5 as string))",
    "sentence_id": "concat('corpus', cast(l_suppkey % 5 as string), '.d', cast(l_orderkey % 60 as string), '.s', cast(l_orderkey as string))",
    "seq": "(cast(l_orderkey as bigint) * 8 + l_linenumber) * 1000000 + (l_partkey * 1009 + l_suppkey * 31) % 1000000",
    "pair_a": "cast(l_partkey % 7 as int)",
    "pair_b": "cast(l_suppkey % 5 as int)",
    "gold_label": "case when l_tax > 0.075 then 'unlabeled' when l_discount > 0.01 * (3 + l_suppkey % 5) then 'positive' else 'negative' end",
    "predicted_label": "case when l_quantity > 25 then 'positive' else 'negative' end",
    "evidence_class": "case when l_returnflag = 'R' then 'relational' else 'structural' end",
    "shape": "case l_linenumber % 4 when 0 then 'AA' when 1 then 'AB' when 2 then 'AB_NMOD' else 'RELATIONAL' end",
    "predicate_lemma": "concat('verb', cast(l_partkey % 30 as string))",
    "case_marker": "case when l_partkey % 3 = 0 then 'of' when l_partkey % 3 = 1 then '' else 'to' end",
    "construction": "case when l_linestatus = 'O' then 'verbal' else 'nominal' end",
    "carrier_word": "case when l_partkey % 4 = 0 then null else concat('noun', cast(l_partkey % 11 as string)) end",
    "decision": "case l_linenumber when 1 then 'applied' when 2 then 'review_only' when 3 then 'not_applied' else 'not_selected' end",
    "assertion_status": "case when l_quantity < 3 then 'negated' when l_quantity < 6 then 'uncertain' else 'asserted' end",
    "channel": "case l_linenumber % 3 when 0 then 'clause' when 1 then 'event_nominal' else 'state' end",
}


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(*(F.expr(x).alias(n) for n, x in _COLUMNS.items()))


LEDGER = "ledger AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in _COLUMNS.items()).replace("as string", "as varchar") + " FROM lineitem)"


def sql(body: str, *ctes: str) -> str:
    """A query over the ledger and further common tables."""
    return "WITH " + ", ".join([LEDGER, *ctes]) + " " + body
