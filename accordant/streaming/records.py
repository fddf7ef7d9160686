"""A recoverable sink: several tables from one stream, each batch written once however often it is run.

A batch's tables go to `<path>/<table>/batch=<id>`, in the place of what an earlier attempt at the batch left there; then its number goes to `<path>/_commits`. Readers take the
batches that are there only. A run that dies in the middle of a batch leaves no commit: started again on the same checkpoint, Spark gives the batch the same
number and the same input, and its tables are written anew. Nothing is held on the driver but batch numbers.

A batch of no rows commits with no rows. A table that was never written has no rows. Columns named `batch` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sink(path: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes each table of a batch, then commits it. A batch that was committed before isn't written again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not committed(spark, path).filter(F.col("batch") == number).isEmpty():
            return
        rows = batch.persist()  # read once for all tables
        try:
            for name, make in tables.items():
                make(rows).drop("batch").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            spark.range(1).select(F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{path}/_commits/batch={number}")
        finally:
            rows.unpersist()

    return write


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The numbers of the committed batches, as batch."""
    try:
        return spark.read.schema("number long").parquet(f"{path}/_commits/batch=*").select(F.col("number").alias("batch"))
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "batch long")


def read(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """The rows of a table's committed batches, with batch."""
    done = committed(spark, path)
    try:
        rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/{table}").parquet(f"{path}/{table}/batch=*")
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], f"{schema}, batch long")
    return rows.join(done, "batch", "left_semi")


def start(stream: DataFrame, path: str, tables: dict[str, Callable[[DataFrame], DataFrame]], mode: str = "append", wrap: Callable = lambda write: write) -> StreamingQuery:
    """Runs the stream over what its source has; checkpoint and tables lie in path."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_checkpoint").foreachBatch(wrap(sink(path, tables))).trigger(availableNow=True).start()


def latest(rows: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the row of its last batch: the result of a stream in update mode."""
    value = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*value), "batch").alias("_v")).select(*key, "_v.*")
