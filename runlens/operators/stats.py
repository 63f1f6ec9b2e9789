"""Before/after pairing and descriptive statistics.

Quantiles are exact (linear interpolation, as pandas ``describe`` and SQL
``quantile_cont``) but computed from ranks: distinct values are counted in
parallel, ranked with the distributed running sum, and only the few rows that
bracket each target rank are kept.  No task ever holds all values of a column,
unlike the ``percentile`` aggregate whose final merge does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordering import latest, running_sum
from runlens.operators.runs import successful, verified

# The statistic labels and order of a numeric describe table.
DESCRIBE_LABELS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def pair_runs(
    base: DataFrame,
    valid: DataFrame,
    key: str = "class",
    order_col: str = "ordinal",
    metrics: Sequence[tuple[str, str, str]] = (("cov", "baseline_cov", "valid_cov"), ("mut", "baseline_mut", "valid_mut")),
    missing: str = "zero",
) -> DataFrame:
    """Pair each verified row with the last successful baseline of its key.

    Failed baselines are removed before the later-wins choice; verified rows are
    not de-duplicated (many-to-one kept).  A missing metric counts as 0
    (``missing="zero"``, the reference's default, which biases means) or stays
    NULL (``missing="null"``).
    The baseline side is reduced to one row per key by a partial aggregate, so
    the join sees a unique build side; AQE picks broadcast or a skew-split
    sort-merge join.
    """
    src_cols = [m[0] for m in metrics]
    last = latest(successful(base).select(key, order_col, *src_cols), [key], order_col, [order_col, *src_cols])
    b = last.select(key, *[F.col(s).alias(f"__b_{s}") for s in src_cols])
    v = verified(valid).select(F.col(order_col).alias("ordinal"), key, *src_cols)
    joined = v.join(b, key, "inner")
    out = [F.col("ordinal"), F.col(key)]
    if missing not in ("zero", "null"):
        raise ValueError("missing must be 'zero' or 'null'")
    fill = (lambda c: F.coalesce(c, F.lit(0.0))) if missing == "zero" else (lambda c: c)
    for src, b_name, v_name in metrics:
        out.append(fill(F.col(f"__b_{src}")).cast("double").alias(b_name))
        out.append(fill(F.col(src)).cast("double").alias(v_name))
    return joined.select(*out)


def stack_long(df: DataFrame, cols: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Wide numeric columns to (name, value) rows; nulls kept."""
    entries = F.array(*[F.struct(F.lit(c).alias("n"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(F.inline(entries)).toDF(name, value)


def value_counts(long_df: DataFrame, key: str = "column", value: str = "value", materialize: bool = True) -> DataFrame:
    """(key, value, cnt): distinct values per key, NULL and NaN dropped (pandas treats NaN as missing).

    The aggregate is map-side combined; it is written once because moments,
    quantiles and fences are all derived from it (see ``session.release``).
    """
    v = F.col(value)
    counts = long_df.where(v.isNotNull() & ~F.isnan(v)).groupBy(key, value).agg(F.count(F.lit(1)).alias("cnt"))
    if materialize:
        from runlens.session import materialize as _mat

        counts = _mat(counts, "value_counts")
    return counts


def quantiles_from_counts(
    counts: DataFrame,
    key: str,
    value: str,
    qs: Sequence[float],
    partitions: int | None = None,
) -> DataFrame:
    """(key, q, quantile) with linear interpolation between closest ranks, from (key, value, cnt).

    Every row knows the ranks it covers and its key's total, so the rows that
    bracket each target rank are picked in one aggregate, without a join.
    """
    ranked = running_sum(counts, [value], "cnt", [key], out="__upto", partitions=partitions, total_out="__n")

    def at(rank):
        """The value that covers a rank: the only one with first <= rank <= upto."""
        return F.max(F.when((rank > F.col("__upto") - F.col("cnt")) & (rank <= F.col("__upto")), F.col(value)))

    aggs = []
    for i, q in enumerate(qs):
        h = (F.col("__n") - 1) * F.lit(float(q))
        aggs += [at(F.floor(h) + 1).alias(f"__lo{i}"), at(F.ceil(h) + 1).alias(f"__hi{i}"), F.max(h - F.floor(h)).alias(f"__f{i}")]
    picked = ranked.groupBy(key).agg(*aggs)
    cells = [
        F.struct(F.lit(float(q)).alias("q"), (F.col(f"__lo{i}") + F.col(f"__f{i}") * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))).alias("quantile"))
        for i, q in enumerate(qs)
    ]
    return picked.select(key, F.inline(F.array(*cells)))


def exact_quantiles(long_df: DataFrame, key: str, value: str, qs: Sequence[float], partitions: int | None = None) -> DataFrame:
    """(key, q, quantile) over a long (key, value) table; see ``quantiles_from_counts``."""
    counts = value_counts(long_df, key, value).withColumnRenamed(value, "value")
    return quantiles_from_counts(counts, key, "value", qs, partitions)


def _moment_cells(counts: DataFrame) -> DataFrame:
    """(column, stat_order, v) cells of count/mean/std/min/max from (column, value, cnt).

    Two passes over the small distinct-value table for a stable std: the
    per-column mean (one row per column) is broadcast into the second pass.
    """
    first = counts.groupBy("column").agg(
        F.sum("cnt").cast("double").alias("count"),
        (F.sum(F.col("value") * F.col("cnt")) / F.sum("cnt")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    sq = counts.join(F.broadcast(first.select("column", "mean", "count")), "column").groupBy("column").agg(
        F.sqrt(F.try_divide(F.sum(F.col("cnt") * F.pow(F.col("value") - F.col("mean"), 2)), F.first("count") - 1)).alias("v")
    )
    cells = F.array(*[F.struct(F.lit(i).alias("stat_order"), F.col(c).alias("v")) for i, c in ((0, "count"), (1, "mean"), (3, "min"), (7, "max"))])
    return first.select("column", F.inline(cells)).unionByName(sq.select("column", F.lit(2).alias("stat_order"), "v"))


def describe_numeric(df: DataFrame, cols: Sequence[str], digits: int | None = 6, partitions: int | None = None,
                     approx_accuracy: int | None = None) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 %, max per column: 8 labelled rows.

    Output columns: ``statistic``, ``stat_order`` plus one column per input
    column.  Everything is derived from one materialized table of distinct
    (column, value, count) rows, so the input is read once; the cells are
    assembled by a union and a pivot over the literal column list.  The sample
    std of a single row is NULL.
    """
    if approx_accuracy:
        # one aggregate with bounded-memory sketches; nothing is written
        long = stack_long(df, cols).where(F.col("value").isNotNull() & ~F.isnan("value"))
        picked = long.groupBy("column").agg(
            F.count(F.lit(1)).cast("double").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
            F.percentile_approx("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), approx_accuracy).alias("__q"), F.max("value").alias("max"),
        )
        qs = picked.select("column", F.posexplode("__q").alias("__i", "quantile")).select("column", ((F.col("__i") + 1) * 0.25).alias("q"), "quantile")
        cells = F.array(*[F.struct(F.lit(i).alias("stat_order"), F.col(c).alias("v")) for i, c in ((0, "count"), (1, "mean"), (2, "std"), (3, "min"), (7, "max"))])
        moments = picked.select("column", F.inline(cells))
    else:
        counts = value_counts(stack_long(df, cols))
        qs = quantiles_from_counts(counts, "column", "value", [0.25, 0.5, 0.75], partitions)
        moments = _moment_cells(counts)
    q_cells = qs.select("column", (F.lit(4) + F.round(F.col("q") * 4).cast("int") - 1).alias("stat_order"), F.col("quantile").alias("v"))
    spark = df.sparkSession
    # every column and statistic exists even on empty input (count 0, others NULL)
    grid = spark.createDataFrame(
        [(c, i, 0.0 if i == 0 else None) for c in cols for i in range(len(DESCRIBE_LABELS))], "column STRING, stat_order INT, v DOUBLE"
    )
    labels = spark.createDataFrame(list(enumerate(DESCRIBE_LABELS)), "stat_order INT, statistic STRING")
    cells = grid.unionByName(moments).unionByName(q_cells)
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    wide = cells.groupBy("stat_order").pivot("column", list(cols)).agg(F.max("v"))
    return wide.join(F.broadcast(labels), "stat_order").select(
        "statistic", "stat_order", *[r(F.col(c)).alias(c) for c in cols]
    )


def box_stats(df: DataFrame, cols: Sequence[str], whis: float = 1.5, digits: int | None = 6, partitions: int | None = None) -> DataFrame:
    """Data behind a box plot, per column: quartiles, fences, whiskers, outlier count.

    Whiskers are the most extreme values inside [Q1 - whis*IQR, Q3 + whis*IQR]
    (the plotting library's default rule).  All from the checkpointed distinct
    (column, value, count) table with the per-column fences broadcast.
    """
    counts = value_counts(stack_long(df, cols))
    qs = quantiles_from_counts(counts, "column", "value", [0.25, 0.5, 0.75], partitions)
    quart = qs.groupBy("column").agg(
        *[F.max(F.when(F.col("q") == q, F.col("quantile"))).alias(n) for q, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    ).withColumn("iqr", F.col("q3") - F.col("q1")).withColumn(
        "lower_fence", F.col("q1") - whis * F.col("iqr")
    ).withColumn("upper_fence", F.col("q3") + whis * F.col("iqr"))
    f = F.broadcast(quart.select("column", "lower_fence", "upper_fence"))
    inside = (F.col("value") >= F.col("lower_fence")) & (F.col("value") <= F.col("upper_fence"))
    pass2 = counts.join(f, "column", "inner").groupBy("column").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("cnt")).otherwise(0)).cast("long").alias("n_outliers"),
        F.sum("cnt").cast("long").alias("n"),
    )
    res = quart.join(pass2, "column", "inner")
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return res.select(
        "column",
        "n",
        *[r(F.col(c)).alias(c) for c in ("q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_low", "whisker_high")],
        "n_outliers",
    )


def improvement(df: DataFrame, pairs: Sequence[tuple[str, str, str]], digits: int | None = 6) -> DataFrame:
    """Data behind the before/after scatter: improved / equal / worse counts and mean delta per metric."""
    aggs = []
    for name, before, after in pairs:
        d = F.col(after) - F.col(before)
        aggs += [
            F.count_if(d > 0).alias(f"{name}__up"),
            F.count_if(d == 0).alias(f"{name}__eq"),
            F.count_if(d < 0).alias(f"{name}__down"),
            F.avg(d).alias(f"{name}__mean"),
            F.count(d).alias(f"{name}__n"),
        ]
    wide = df.agg(*aggs)
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(f"{name}__n").alias("n"),
                F.col(f"{name}__up").alias("n_improved"),
                F.col(f"{name}__eq").alias("n_equal"),
                F.col(f"{name}__down").alias("n_worse"),
                r(F.col(f"{name}__mean")).alias("mean_delta"),
            )
            for name, _, _ in pairs
        ]
    )
    return wide.select(F.inline(entries))


def describe_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, unique, top, freq per text column (tie for top -> smallest value).

    One scan for all columns; a column without values has a NULL count, no unique value and no top.
    """
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols]))
    # value counts in parallel, then one aggregate over the distinct values
    freq = df.select(cells).where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("f"))
    found = freq.groupBy("column").agg(
        F.sum("f").cast("long").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by(F.col("v"), F.struct(-F.col("f"), F.col("v"))).alias("top"),
        F.max("f").alias("freq"),
    )
    asked = df.sparkSession.createDataFrame([(c,) for c in cols], "column STRING")
    # a row per column of a literal list on either side
    return asked.join(F.broadcast(found), "column", "left").select("column", "count", F.coalesce("unique", F.lit(0)).cast("long").alias("unique"), "top", "freq")


# The pandas dtype name shown for each Spark type family.
_DTYPE_NAMES = {"bigint": "int64", "int": "int32", "double": "float64", "float": "float32", "string": "object",
                "boolean": "bool", "timestamp": "datetime64[ns]"}


def profile(df: DataFrame) -> DataFrame:
    """(column, position, non_null, dtype) per column in one aggregate."""
    fields = df.schema.fields
    wide = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    entries = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(i).cast("long").alias("position"),
                F.col(f"c{i}").alias("non_null"),
                F.lit(_DTYPE_NAMES.get(f.dataType.simpleString(), "object")).alias("dtype"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return wide.select(F.inline(entries))
