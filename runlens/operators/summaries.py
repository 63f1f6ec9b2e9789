"""Describe statistics that are kept and merged: a batch is summarised once, and never read again.

A state has one row per batch and column: count, mean, sum of squared deviations, extremes and a KLL sketch of the
values.  States merge in any grouping (``merge_states`` of merged states is the merge of all), so a table that grows by
batches, or lies in many places, is described from a few kilobytes per batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.stats import stack_long

#: Sketch size: larger is more exact; see ``rank_error``.
SKETCH_K = 1024

STATE = "column string, n long, mean double, m2 double, min double, max double, sketch binary"


def rank_error(k: int = SKETCH_K) -> float:
    """How far a quantile's rank may be off, as a share of all rows, at 99 % confidence (the sketch's published bound)."""
    return 2.296 / k**0.9723


def describe_state(df: DataFrame, cols: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """The state of one batch, a row per column with values; nulls and NaN are no values.

    One scan with map-side partial aggregates; a column without values has no row, nor has an empty table.
    """
    long = stack_long(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count(F.lit(1))).alias("m2"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.kll_sketch_agg_double("value", k).alias("sketch"),
    )


def merge_states(states: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """The state of all batches together, a row per column; the empty merge is empty.

    The squared deviations are taken around the merged mean, which is known from a first pass over the states, so no
    difference of large sums loses digits.  The sketches merge in map-side partial aggregates.
    """
    means = states.groupBy("column").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("__mean"))
    # one row per column of a literal list
    moved = states.join(F.broadcast(means), "column")
    return moved.groupBy("column").agg(
        F.sum("n").alias("n"),
        F.first("__mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("__mean"), 2)).alias("m2"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("sketch", k).alias("sketch"),
    )


def describe_merged(state: DataFrame, qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, n, mean, std, min, max, quantiles array) of a merged state; the sample std of one row is NULL.

    Moments and extremes are exact; a quantile is a value of the column whose rank is within ``rank_error`` of q.
    """
    quantiles = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(q)) for q in qs]))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return state.select("column", "n", "mean", std.alias("std"), "min", "max", quantiles.alias("quantiles"))


def store_state(df: DataFrame, cols: Sequence[str], path: str, batch: int, k: int = SKETCH_K) -> None:
    """Add a batch's state below ``path``; a batch that runs again replaces its own state and counts once."""
    describe_state(df, cols, k).write.mode("overwrite").parquet(f"{path}/batch={batch:d}")


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    """All states stored below ``path``."""
    return spark.read.schema(f"{STATE}, batch long").parquet(path).drop("batch")
