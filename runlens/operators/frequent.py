"""The most frequent values of a column with very many, by Misra-Gries summaries and an exact second count.

Counting every value shuffles a row per value and task.  A summary keeps at most ``counters`` values of a task, so the
first pass shuffles that many; the second counts, exactly, only the values that can be among the first k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordering import top_k
from runlens.session import materialize

#: Counters of a task's summary at first, and the most it may get before every value is counted instead.
COUNTERS, MAX_COUNTERS, MORE = 4096, 1 << 18, 8


def _summaries(counters: int):
    """(value, n) of each task's summary, and one row with a null value: what the others may have lost."""

    def run(batches):
        kept, lost = None, 0
        for b in batches:
            found = pc.value_counts(b.column(0).drop_null())
            part = pa.table({"value": found.field("values"), "n": found.field("counts")})
            kept = part if kept is None else pa.concat_tables([kept, part]).group_by("value").aggregate([("n", "sum")]).rename_columns(["value", "n"])
            if kept.num_rows > counters:
                n = kept.column("n").to_numpy()
                # taken from counters + 1 values at least, so all that is lost stays below rows / counters
                cut = int(np.partition(n, -(counters + 1))[-(counters + 1)])
                lost += cut
                kept = pa.table({"value": kept.column("value"), "n": pa.array(n - cut)}).filter(pa.array(n > cut))
        if kept is not None:
            yield from kept.combine_chunks().to_batches(max_chunksize=10_000)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kept.schema.field("value").type), pa.array([lost], pa.int64())], names=["value", "n"])

    return run


def candidates(values: DataFrame, k: int, counters: int) -> DataFrame | None:
    """(value): a superset of the ``k`` most frequent of ``values`` (value), or None when the counters prove none.

    With E lost over all tasks, a value is in the summaries n times and in the rows n to n + E times.  The k-th largest n
    is a lower bound L of the k-th count: values of n + E < L are out, and one that no summary holds is out if E < L.
    """
    kind = values.schema["value"].dataType.simpleString()
    parts = materialize(values.mapInArrow(_summaries(counters), f"value {kind}, n long"), "summaries")
    merged = materialize(parts.where("value IS NOT NULL").groupBy("value").agg(F.sum("n").alias("n")), "summary")
    lost = parts.where("value IS NULL").agg(F.sum("n")).first()[0] or 0
    # one row of the k-th largest, or none
    first = merged.orderBy(F.desc("n")).limit(k).agg(F.count(F.lit(1)), F.min("n")).first()
    least = first[1] if first[0] == k else 0
    if lost and lost >= least:
        return None
    return merged.where(F.col("n") + F.lit(lost) >= least).select("value")


def most_frequent(df: DataFrame, col: str | Column, k: int, counters: int = COUNTERS, max_counters: int = MAX_COUNTERS) -> DataFrame:
    """(value, n, rank): the ``k`` most frequent values with their exact counts; ties go to the smaller value.

    Nulls are not counted; NaN is a value like others; an empty table, or k = 0, has no rows.  A summary that can't
    prove its candidates is made again with more counters; a column without frequent values (beyond ``max_counters``)
    has all its values counted, with the same result.  A value's rows are counted in the tasks that read them, so a hot
    value is no hot key.
    """
    values = df.select((F.col(col) if isinstance(col, str) else col).alias("value")).where("value IS NOT NULL")
    found = None
    while k > 0 and found is None and counters <= max_counters:
        found = candidates(values, k, counters)
        counters *= MORE
    if found is not None:
        # counted before the join would mean all values; the candidates are few, and adaptive execution sees how few
        values = values.join(found, "value", "left_semi")
    counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, [F.desc("n"), F.asc("value")], k).select("value", "n", "rank")
