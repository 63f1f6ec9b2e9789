"""Keyed state over micro-batches: the latest record per key and running tallies.

Both are streaming aggregations, so Spark keeps their state by key in the checkpoint's state store: a late or repeated
record meets the state of its key, whichever batch it arrives in.  Each batch writes the rows that it changed below
``batch_id=N``; a batch that runs again after a failure overwrites its own folder, so the log holds each batch once and
a restart without new input changes nothing.  The log is the history; its last row per key is the present state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.fmt import pct


def keyed_latest(stream: DataFrame, keys: Sequence[str], order_col: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Per key the record with the greatest ``order_col`` so far, in whatever order records arrive.

    Null keys are a key of their own; a record whose order is NULL never wins over one that has an order.  Repeated
    records change nothing.  Of several records of one key and order one is kept, whole.
    """
    cols = [c for c in (columns or stream.columns) if c not in keys]
    record = F.struct(*[F.col(c) for c in cols])
    # the order's own absence sorts first, so that a key of null orders alone keeps a record too
    at = F.struct(F.col(order_col).isNotNull().alias("known"), F.col(order_col).alias("at"))
    return stream.groupBy(*keys).agg(F.max_by(record, at).alias("__rec")).select(*keys, *[F.col(f"__rec.{c}").alias(c) for c in cols])


def running_tally(stream: DataFrame, keys: Sequence[str], success: str = "success") -> DataFrame:
    """total, successes and success percent per key so far (a NULL flag is no success)."""
    ok = F.coalesce(F.col(success), F.lit(False))
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successes")).withColumn("percent", pct("successes", "total", 1))


def write_changes(state: DataFrame, out_path: str, checkpoint: str) -> None:
    """Run every available batch of ``state`` and write the rows each one changed to ``out_path/batch_id=N``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    q = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def history(spark: SparkSession, out_path: str, schema) -> DataFrame:
    """All changed rows with the ``batch_id`` that changed them."""
    columns = schema.fields if hasattr(schema, "fields") else spark.createDataFrame([], schema).schema.fields
    log = spark.read.option("basePath", out_path).parquet(out_path)
    return log.select(*[F.col(f.name).cast(f.dataType) for f in columns], F.col("batch_id").cast("long").alias("batch_id"))


def current(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The present state: the last change of every key, by a map-side combined aggregate."""
    cols = [c for c in log.columns if c not in (*keys, "batch_id")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("__rec"))
    return last.select(*keys, *[F.col(f"__rec.{c}").alias(c) for c in cols])
