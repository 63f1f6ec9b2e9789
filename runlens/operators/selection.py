"""The first n rows in order by selection: no sort of the table and no task that holds n rows.

A mergeable sketch of the order key brackets the n-th row between two values.  One more pass counts the rows below the
bracket and writes those inside it; the result is a filter, plus the first rows of the bracket.  A bracket that is
still large is narrowed the same way, and one that is a single value goes on with the next order column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.operators.ordering import positions
from runlens.session import materialize

#: Accuracy of the sketch: a bracket holds about 4 / ACCURACY of the rows.
ACCURACY = 10_000
#: A bracket of at most so many rows is put in order as it is.
SMALL_BRACKET = 100_000

_LEAST, _GREATEST = -1.7976931348623157e308, 1.7976931348623157e308
_NULL, _NAN = float("-inf"), float("inf")


def _codes(name: str, kind: T.DataType) -> tuple[list[Column], bool]:
    """Doubles that ascend as the column does, from coarse to fine, and whether equal codes mean equal values."""
    c = F.col(name)
    whole = lambda x: [F.shiftright(x, 20).cast("double"), x.bitwiseAND(F.lit((1 << 20) - 1)).cast("double")]
    exact = True
    if isinstance(kind, T.LongType):  # a double is exact to 53 bits only
        out = whole(c)
    elif isinstance(kind, T.TimestampType):
        out = whole(F.unix_micros(c))
    elif isinstance(kind, T.TimestampNTZType):
        out = whole(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c))
    elif isinstance(kind, T.DateType):
        out = [F.unix_date(c).cast("double")]
    elif isinstance(kind, T.BooleanType):
        out = [c.cast("int").cast("double")]
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        out = [F.when(F.isnan(d), F.lit(_NAN)).otherwise(F.least(F.greatest(d, F.lit(_LEAST)), F.lit(_GREATEST)))]
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        out = [c.cast("double")]
    elif isinstance(kind, T.DecimalType):
        out, exact = [c.cast("double")], kind.precision <= 15
    elif isinstance(kind, T.StringType):  # strings compare by their bytes
        chunk = lambda i: F.rpad(F.hex(F.substring(c.cast("binary"), 6 * i + 1, 6)), 12, "0")
        out, exact = [F.conv(chunk(i), 16, 10).cast("double") for i in range(4)], False
    else:
        out, exact = [], False
    return [F.when(c.isNull(), F.lit(_NULL)).otherwise(x) for x in out], exact


def _bracket(cell: DataFrame, code: Column, need: int, wider: int) -> tuple[float, float] | None:
    """Code values between which the ``need``-th row lies, as a sketch of 2,001 quantiles sees it; None if there are no more rows."""
    grid = F.array(*[F.lit(i / 2000) for i in range(2001)])
    seen = cell.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(code, grid, ACCURACY).alias("q")).first()
    if seen["n"] <= need:
        return None
    at = need * 2000 // seen["n"]
    low, high = at - wider, at + 1 + wider
    return seen["q"][low] if low > 0 else _NULL, seen["q"][high] if high < 2000 else _NAN


def _narrowed(cell: DataFrame, code: Column, need: int) -> tuple[DataFrame, int, float | None] | None:
    """(bracket rows, rows below it, its only value if it has one)."""
    wider = 1
    while True:
        ends = _bracket(cell, code, need, wider)
        if ends is None:
            return None
        low, high = (F.lit(x) for x in ends)
        # rows below the bracket are counted by the pass that writes those inside
        seen = Observation()
        counted = cell.observe(seen, F.count_if(code < low).alias("below"), F.count_if(code <= high).alias("upto"))
        bracket = materialize(counted.where(code.between(low, high)), "bracket")
        below, upto = seen.get["below"], seen.get["upto"]
        if below < need <= upto:
            return bracket, below, ends[0] if ends[0] == ends[1] else None
        wider *= 4  # the sketch missed


def _split_off(cell: DataFrame, code: Column, need: int) -> tuple[DataFrame, int, float | None]:
    """As ``_narrowed``, by the least value alone: for a few values that hold many rows each."""
    least = cell.agg(F.min(code).alias("m")).first()["m"]
    held = cell.where(code == F.lit(least)).count()
    return (cell.where(code == F.lit(least)), 0, least) if need <= held else (cell.where(code > F.lit(least)), held, None)


def first_n(df: DataFrame, order_cols: Sequence[str], n: int) -> DataFrame:
    """The ``n`` first rows by ``order_cols`` ascending (nulls first, NaN last); all rows where there are no more.

    Rows of equal order are interchangeable, and as many of them are kept as fit.  Where the bracket is small at once,
    the table is read three times: for the sketch and for the bracket by its order columns alone, and for the result.
    """
    order = list(order_cols)
    if n <= 0:
        return df.limit(0)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cell, need, size = df.select(*order), n, None
    for name in order:
        codes, exact = _codes(name, kinds[name])
        for code in codes:
            value = None
            while value is None and (size is None or size > SMALL_BRACKET):
                found = _narrowed(cell, code, need)
                if found is None and size is None:
                    return df
                if found is None:  # the bracket's last row is the one
                    size = 0
                    break
                now = found[0].count()
                if size is not None and 2 * now > size:
                    found = _split_off(cell, code, need)
                    now = found[0].count()
                cell, below, value = found
                need, size = need - below, now
        if not exact or value in (_LEAST, _GREATEST):
            break  # rows of one code may still differ here: what is left is put in order as it is
    # the n-th row's key, and how many rows of that key are still wanted
    key = F.struct(*order)
    last = materialize(positions(cell, order, out="__at").where(F.col("__at") == need).select(key.alias("key")), "last")
    if last.isEmpty():
        return df
    bound = last.scalar()
    counts = cell.agg(F.count_if(key < bound).alias("less"), F.count_if(key == bound).alias("equal")).first()
    if counts["less"] + counts["equal"] == need:
        return df.where(key <= bound)
    ties = positions(df.where(key == bound), order, out="__at").where(F.col("__at") <= need - counts["less"]).drop("__at")
    return df.where(key < bound).unionByName(ties)
