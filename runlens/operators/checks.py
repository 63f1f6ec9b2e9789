"""Data-quality check suites over tables.

A check is a one-row aggregate (observed value) compared with a threshold.
``run_checks`` unions all checks into one DataFrame so the suite runs as one
action; ``passed`` and ``severity`` are independent (a low count can warn and
still pass).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Check:
    """``observed`` is a one-row DataFrame with columns (observed LONG, detail STRING)."""

    name: str
    observed: DataFrame
    op: str  # '>=', '<=', '=='
    threshold: int
    severity: str = "error"  # reported when the comparison fails
    fail_passes: bool = False  # a warning-only check still passes


def min_count(name: str, df: DataFrame, threshold: int, severity: str = "error", fail_passes: bool = False) -> Check:
    obs = df.agg(F.count(F.lit(1)).alias("observed")).withColumn("detail", F.lit(None).cast("string"))
    return Check(name, obs, ">=", threshold, severity, fail_passes)


def refs_exist(name: str, df: DataFrame, key: str, ref: DataFrame, ref_key: str) -> Check:
    """Every key of ``df`` exists in ``ref``: count of dangling keys must be 0 (anti join)."""
    # both sides by key (map-side combine), so a hot key is one row in the join
    probe = df.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    dangling = probe.join(ref.select(F.col(ref_key).alias("__k")).distinct(), "__k", "left_anti")
    obs = dangling.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("observed")).withColumn("detail", F.lit(None).cast("string"))
    return Check(name, obs, "==", 0, "error")


def required_present(name: str, df: DataFrame, col: str, required: Sequence[str]) -> Check:
    """Every required value occurs in ``col``; the missing ones are listed (bounded by the list)."""
    spark = df.sparkSession
    req = spark.createDataFrame([(i, r) for i, r in enumerate(required)], "req_pos INT, v STRING")
    # only required values are shuffled, at most the list from each task
    present = df.where(F.col(col).isin(list(required))).select(F.col(col).alias("v")).distinct()
    missing = req.join(present, "v", "left_anti")
    obs = missing.agg(
        F.count(F.lit(1)).alias("observed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("req_pos", "v"))), lambda s: s["v"]), ",").alias("detail"),
    ).withColumn("detail", F.when(F.col("detail") != "", F.col("detail")))
    return Check(name, obs, "==", 0, "error")


def safe_check(name: str, build, spark=None) -> Check:
    """Build a check; an exception while building it becomes a failed check (error severity).

    ``build`` is a zero-argument callable returning a ``Check``; ``spark`` is
    needed only to express the failure row.
    """
    try:
        return build()
    except Exception as e:  # a broken check is a failed check, not a crashed suite
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.getActiveSession()
        obs = spark.createDataFrame([(None, f"{type(e).__name__}: {e}")], "observed BIGINT, detail STRING")
        return Check(name, obs, "==", 0, "error")


def _cmp(op: str, a: Column, b: Column) -> Column:
    return {">=": a >= b, "<=": a <= b, "==": a == b}[op]


def run_checks(checks: Sequence[Check]) -> DataFrame:
    """(check_no, check, passed, severity, observed, threshold, detail): one row per check.

    ``severity`` is NULL for a met check.
    """
    out = None
    for i, c in enumerate(checks, 1):
        met = F.coalesce(_cmp(c.op, F.col("observed"), F.lit(c.threshold)), F.lit(False))
        row = c.observed.select(
            F.lit(i).alias("check_no"),
            F.lit(c.name).alias("check"),
            (met | F.lit(c.fail_passes)).alias("passed"),
            F.when(~met, F.lit(c.severity)).alias("severity"),
            F.col("observed").cast("long").alias("observed"),
            F.lit(c.threshold).cast("long").alias("threshold"),
            F.col("detail"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@dataclass
class Watch:
    """A check whose observed value comes from ``metrics``, aggregates of the rows of a write."""

    name: str
    metrics: list[Column]
    result: Callable[[list], tuple[int, str | None]]  # metric values -> (observed, detail)
    op: str
    threshold: int
    severity: str = "error"
    fail_passes: bool = False


def watch_count(name: str, threshold: int, severity: str = "error", fail_passes: bool = False) -> Watch:
    """``min_count`` of the rows written."""
    return Watch(name, [F.count(F.lit(1))], lambda v: (v[0], None), ">=", threshold, severity, fail_passes)


def watch_required(name: str, col: str, required: Sequence[str]) -> Watch:
    """``required_present`` of the rows written: a flag per required value (bounded by the list)."""

    def result(seen):
        missing = [r for r, found in zip(required, seen, strict=True) if not found]
        return len(missing), ",".join(missing) or None

    return Watch(name, [F.max(F.coalesce(F.col(col) == r, F.lit(False))) for r in required], result, "==", 0)


def watch_no_nulls(name: str, col: str) -> Watch:
    """No row written has a null in ``col``; observed is the number that do."""
    return Watch(name, [F.count_if(F.col(col).isNull())], lambda v: (v[0], None), "==", 0)


def checks_while_writing(df: DataFrame, checks: Sequence[Watch], write: Callable[[DataFrame], None]) -> DataFrame:
    """Run ``write(df)`` and return the rows of ``run_checks`` for what it wrote, without a scan of their own.

    The metrics ride on the write's own tasks, so ``write`` must run exactly one action on the frame it is given, and
    without a shuffle behind it (a re-run map stage would be counted again); an exception of the write is the
    caller's.  An empty table counts 0 rows and misses every required value.
    """
    named = [(f"c{i}_{j}", m) for i, c in enumerate(checks) for j, m in enumerate(c.metrics)]
    seen: dict = {}
    if named:
        watched = Observation()
        write(df.observe(watched, *[m.alias(n) for n, m in named]))
        seen = watched.get
    else:
        write(df)
    rows = []
    for i, c in enumerate(checks):
        observed, detail = c.result([seen[f"c{i}_{j}"] for j in range(len(c.metrics))])
        met = {">=": observed >= c.threshold, "<=": observed <= c.threshold, "==": observed == c.threshold}[c.op]
        rows.append((i + 1, c.name, met or c.fail_passes, None if met else c.severity, observed, c.threshold, detail))
    return df.sparkSession.createDataFrame(
        rows, "check_no INT, check STRING, passed BOOLEAN, severity STRING, observed LONG, threshold LONG, detail STRING"
    )


def check_status(results: DataFrame) -> DataFrame:
    """'failed' with any error, else 'degraded' with any warning, else 'ready'."""
    return results.agg(
        F.count_if(F.col("severity") == "error").alias("n_errors"),
        F.count_if(F.col("severity") == "warning").alias("n_warnings"),
    ).withColumn(
        "status",
        F.when(F.col("n_errors") > 0, F.lit("failed")).when(F.col("n_warnings") > 0, F.lit("degraded")).otherwise(F.lit("ready")),
    )
