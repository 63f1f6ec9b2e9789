"""Order-dependent primitives that never put a whole key group into one task.

The reference relies on input order (first seen, later wins, first k, position
``[i/n]``).  Spark has no row order, so every operator here takes explicit order
columns.  Positions and running sums are computed without an unpartitioned
window and without a per-key window over a whole group:

1. the input is dealt over ranges of ``(keys, order)`` and written once, each
   row with the number of its range.  A hot key is split over many ranges in
   contiguous order, and every plan branch reads the same stored numbers;
2. sum locally inside each (range, key) slice;
3. add the totals of the earlier slices of the same key.  Only the first and the
   last key of a range can have slices in other ranges, so the offset table has
   at most two rows per range and is broadcast with that proven bound.

There is one path at every size; the number of ranges is that of the shuffle
partitions, which follow the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import materialize

ColLike = str | Column


def _col(c: ColLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ranged(df: DataFrame, sort_cols: Sequence[str], n: int, out: str = "__pid") -> DataFrame:
    """``df`` stored with a range number in [0, n) per row, ascending in ``sort_cols``.

    The sort order, nulls and NaN included, is Spark's.  Ranges are written by
    as many tasks as the session has shuffle partitions, so thousands of ranges
    don't make thousands of files.
    """
    tasks = min(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = df.repartitionByRange(n, *[F.col(c) for c in sort_cols]) if n > 1 else df
    return materialize(dealt.withColumn(out, F.spark_partition_id() if n > 1 else F.lit(0)).coalesce(tasks), "ranges")


def running_sum(
    df: DataFrame,
    order_cols: Sequence[ColLike],
    weight: ColLike | None = None,
    keys: Sequence[str] = (),
    out: str = "running",
    partitions: int | None = None,
    total_out: str | None = None,
) -> DataFrame:
    """Inclusive running sum of ``weight`` (1 per row when None) inside ``keys``, ascending order.

    Ties in ``order_cols`` get distinct, arbitrary consecutive values, as with
    ``row_number``.  Null keys form their own group.  For a descending order
    pass a negated numeric column.  ``total_out`` adds the key's total, taken
    from the same slices.  The input is read twice: for the borders of the
    ranges and to be dealt over them.
    """
    keys = list(keys)
    w = F.lit(1).cast("long") if weight is None else _col(weight)
    order = [f"__o{i}" for i in range(len(order_cols))]
    base = df.select(*[F.col(c) for c in df.columns], w.alias("__w"), *[_col(c).alias(o) for c, o in zip(order_cols, order, strict=True)])
    n = int(partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    table = ranged(base, [*keys, *order], n)
    slice_w = Window.partitionBy("__pid", *keys)
    local = table.withColumn("__local", F.sum("__w").over(slice_w.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if total_out:
        local = local.withColumn("__slice", F.sum("__w").over(slice_w))
    slices = table.groupBy("__pid", *keys).agg(F.sum("__w").alias("__slice"))
    whole = Window.partitionBy(*keys)
    offsets = (
        slices.withColumn("__offset", F.sum("__slice").over(whole.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("__total", F.sum("__slice").over(whole))
        .withColumn("__n", F.count(F.lit(1)).over(whole))
        .where(F.col("__n") > 1)
        .select("__pid", *[F.col(k).alias(f"__k_{k}") for k in keys], "__offset", "__total")
    )
    # only the first and the last key of a range have slices elsewhere: at most
    # two rows per range, a proven broadcast bound
    off = F.broadcast(offsets)
    cond = local["__pid"] == off["__pid"]
    for k in keys:
        cond = cond & local[k].eqNullSafe(off[f"__k_{k}"])
    joined = local.join(off, cond, "left")
    extra = [F.coalesce(off["__total"], local["__slice"]).alias(total_out)] if total_out else []
    return joined.select(
        *[local[c] for c in df.columns],
        (local["__local"] + F.coalesce(off["__offset"], F.lit(0))).alias(out),
        *extra,
    )


def positions(
    df: DataFrame,
    order_cols: Sequence[ColLike],
    keys: Sequence[str] = (),
    out: str = "pos",
    partitions: int | None = None,
    total_out: str | None = None,
) -> DataFrame:
    """1-based position of every row inside its key group (global when no keys), and the group's size on request."""
    numbered = running_sum(df, order_cols, None, keys, out, partitions, total_out)
    return numbered.withColumn(out, F.col(out).cast("long"))


def first_k(df: DataFrame, keys: Sequence[str], order_cols: Sequence[ColLike], k: int, rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows per key in order.

    ``row_number() <= k`` is planned as a partial WindowGroupLimit before the
    shuffle, so a hot key ships at most k rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*[_col(c) for c in order_cols])
    return df.withColumn(rank_col, F.row_number().over(w).cast("long")).where(F.col(rank_col) <= k)


def latest(df: DataFrame, keys: Sequence[str], order_col: str, columns: Sequence[str] | None = None,
           unique_order: bool = True) -> DataFrame:
    """The row with the greatest ``order_col`` per key (later row wins).

    An aggregate (``max_by``) with map-side partial aggregation, no window sort.
    With ``unique_order`` (every bound table carries a unique ordinal) there is
    one ``max_by`` per column, whose fixed-width buffers keep it a
    HashAggregate; otherwise one ``max_by`` of a struct keeps every column from
    the same row even when the order value ties.
    """
    cols = [c for c in (columns or df.columns) if c not in keys]
    if not unique_order:
        rec = F.struct(*[F.col(c) for c in cols])
        return df.groupBy(*keys).agg(F.max_by(rec, F.col(order_col)).alias("__rec")).select(
            *keys, *[F.col(f"__rec.{c}").alias(c) for c in cols]
        )
    return df.groupBy(*keys).agg(
        *[(F.max(order_col) if c == order_col else F.max_by(F.col(c), F.col(order_col))).alias(c) for c in cols]
    )


def top_k(df: DataFrame, order_cols: Sequence[ColLike], k: int, rank_col: str | None = "rank") -> DataFrame:
    """Global top-k by order (TakeOrderedAndProject), with an optional rank column.

    The rank window runs over at most ``k`` rows after the limit.
    """
    order = [_col(c) for c in order_cols]
    limited = df.orderBy(*order).limit(k)
    if rank_col is None:
        return limited
    return limited.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)).cast("long"))


def concat_chunks(
    df: DataFrame, keys: Sequence[str], order_cols: Sequence[ColLike], value: ColLike, sep: str, out: str, chunk_rows: int = 512
) -> DataFrame:
    """(keys..., chunk, out): ``value`` strings joined in order, ``chunk_rows`` of them per row; no row grows with its group."""
    order = [_col(c) for c in order_cols]
    staged = positions(df.withColumn("__v", _col(value)), order, keys, out="__pos").withColumn("chunk", F.floor((F.col("__pos") - 1) / chunk_rows))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("__pos").alias("o"), F.col("__v").alias("v"))))
    return staged.groupBy(*keys, "chunk").agg(F.array_join(F.transform(pairs, lambda s: s["v"]), sep).alias(out))


def ordered_concat(
    df: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[ColLike],
    value: ColLike,
    sep: str,
    out: str,
    chunk_rows: int = 512,
    chunk_col: ColLike | None = None,
) -> DataFrame:
    """Join ``value`` strings per key in order, in two aggregation levels.

    Level 1 joins bounded chunks (``chunk_rows`` consecutive rows, or the
    caller's ``chunk_col`` when it already bounds chunk size) in parallel;
    level 2 joins the chunk strings of a key.  No task ever sorts a whole group.
    """
    order = [_col(c) for c in order_cols]
    v = _col(value)
    if chunk_col is None:
        staged = positions(df.withColumn("__v", v), order, keys, out="__pos")
        staged = staged.withColumn("__chunk", F.floor((F.col("__pos") - 1) / chunk_rows)).withColumn(
            "__ord", F.col("__pos")
        )
        sort_key = [F.col("__ord")]
    else:
        staged = df.withColumn("__v", v).withColumn("__chunk", _col(chunk_col))
        sort_key = order
    part = staged.groupBy(*keys, "__chunk").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.struct(*sort_key).alias("o"), F.col("__v").alias("v")))),
                lambda s: s["v"],
            ),
            sep,
        ).alias("__part")
    )
    return part.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col("__chunk").alias("c"), F.col("__part").alias("p")))),
                lambda s: s["p"],
            ),
            sep,
        ).alias(out)
    )
