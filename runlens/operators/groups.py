"""Group statistics over (key, value, ordinal) tables such as the class manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordering import first_k, positions, top_k
from runlens.operators.selection import first_n
from runlens.session import materialize


def group_lists(df: DataFrame, key: str, value: str, order_col: str, pos: str = "pos") -> DataFrame:
    """key -> its values in input order, as long form (key, pos, value).

    A list per key would put a hot key's whole group in one row and one task;
    the long form with a distributed 1-based position carries the same order.
    """
    return positions(df.select(key, value, order_col), [order_col], [key], out=pos).select(key, pos, value)


def with_position(df: DataFrame, key: str, order_col: str, pos: str = "pos", total: str = "n") -> DataFrame:
    """Progress position ``[i/n]`` inside each key group (1-based), without a per-group window."""
    return positions(df, [order_col], [key], out=pos, total_out=total)


def overview(df: DataFrame, key: str) -> DataFrame:
    """Number of distinct groups and total rows."""
    return df.agg(F.count_distinct(F.col(key)).alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))


def group_size_stats(df: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """min / max / mean rows per group (mean rounded); two-level aggregate."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.min("n").alias("min_size"),
        F.max("n").alias("max_size"),
        F.round(F.avg("n"), digits).alias("mean_size"),
    )


def leading_segment(col: str | Column, default: str = "default") -> Column:
    """First dotted segment, ``default`` when the name has no dot."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.contains("."), F.split_part(c, F.lit("."), F.lit(1))).otherwise(F.lit(default))


def most_common(df: DataFrame, col: str | Column, k: int, order_col: str, name: str = "value") -> DataFrame:
    """The ``k`` most frequent values; ties broken by first appearance (min ordinal)."""
    c = F.col(col) if isinstance(col, str) else col
    counts = df.groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.min(order_col).alias("first_seen"))
    return top_k(counts, [F.desc("n"), F.asc("first_seen")], k).select(name, "n", "rank")


def groups_by_size(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """All groups by size descending, ties in first-seen order, rank as a column (distributed rank)."""
    # written before its ranges are dealt, so that the aggregate runs once
    g = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order_col).alias("first_seen")), "groups")
    return positions(g, [-F.col("n"), F.col("first_seen")], out="rank")


def head_groups(df: DataFrame, key: str, k: int) -> DataFrame:
    """First ``k`` groups by name with their sizes, plus how many groups remain (never negative)."""
    # written once: the head and the number of groups both read it
    g = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "groups")
    head = top_k(g, [F.asc(key)], k)
    remaining = g.agg(F.greatest(F.count(F.lit(1)) - F.lit(k), F.lit(0)).alias("remaining"))
    # a scalar subquery: one aggregate value attached to the k head rows
    return head.withColumn("remaining", remaining.scalar())


#: Up to this many rows every task may hold a whole head.
SMALL_HEAD = 10_000


def limit_input(df: DataFrame, n: int | None, order_col: str | Sequence[str]) -> DataFrame:
    """First ``n`` rows in order; ``None`` or 0 keeps everything.

    A small head is a top-k; a larger one is selected (see ``selection.first_n``), so that its size is no task's.
    """
    if not n:
        return df
    if n <= SMALL_HEAD:
        return df.orderBy(*[F.col(c) for c in _columns(order_col)]).limit(int(n))
    return first_n(df, _columns(order_col), int(n))


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def sample_groups(df: DataFrame, names: Sequence[str], key: str, order_col: str, k: int) -> DataFrame:
    """For listed keys present in ``df``, in list order, the first ``k`` rows of each.

    The literal (position, name) table is bounded by the list and broadcast.
    """
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"list_pos INT, {key} STRING")
    picked = df.join(F.broadcast(wanted), key, "inner")
    return first_k(picked, [key], [order_col], k)


def group_with_counts(df: DataFrame, other: DataFrame, key: str, out_self: str = "n", out_other: str = "n_other") -> DataFrame:
    """Per key of ``df``: its row count and the row count in ``other`` (0 when absent)."""
    a = df.groupBy(key).agg(F.count(F.lit(1)).alias(out_self))
    b = other.groupBy(key).agg(F.count(F.lit(1)).alias(out_other))
    return a.join(b, key, "left").withColumn(out_other, F.coalesce(F.col(out_other), F.lit(0)).cast("long"))


def _columns(order_col: str | Sequence[str]) -> list[str]:
    return [order_col] if isinstance(order_col, str) else list(order_col)


def row_at(df: DataFrame, order_col: str | Sequence[str], n: int) -> DataFrame:
    """The row at 0-based position ``n`` in order (``dataset[n]``), by distributed positions whatever ``n`` is."""
    return positions(df, _columns(order_col), out="__pos").where(F.col("__pos") == n + 1).drop("__pos")


def preview(df: DataFrame, order_col: str | Sequence[str], n: int = 5) -> DataFrame:
    """``head()``: the first ``n`` rows in order (a small head)."""
    return df.orderBy(*[F.col(c) for c in _columns(order_col)]).limit(n)
