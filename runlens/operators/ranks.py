"""Rank statistics for paired before/after metrics (signed-rank, rank-sum, A12).

Midranks never need an unpartitioned window: values are first reduced to
distinct (value, count) rows in parallel, then ranked by the distributed
running sum (order ranges + broadcast range offsets).  The final
statistics are one global aggregate with map-side partial aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.operators.ordering import running_sum


def midranks(counts: DataFrame, value: str, cnt: str = "cnt", out: str = "midrank", partitions: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Midrank of every distinct value (of its ``keys``): (number of smaller values) + (cnt + 1) / 2."""
    ranked = running_sum(counts, [value], cnt, keys, out="__upto", partitions=partitions)
    return ranked.withColumn(out, F.col("__upto") - F.col(cnt) + (F.col(cnt) + 1) / 2.0).drop("__upto")


def _number(c: str) -> Column:
    """A value as double; NaN counts as missing, as in the describe tables."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _round(digits: int | None):
    return (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)


def _signed(df: DataFrame, before: str, after: str, keys: Sequence[str]) -> DataFrame:
    """(keys..., n, w_plus, w_minus, ties, z) of the nonzero deltas."""
    d = (_number(after) - _number(before)).alias("__d")
    deltas = df.select(*keys, d).where(F.col("__d").isNotNull() & ~F.isnan("__d") & (F.col("__d") != 0))
    counts = deltas.groupBy(*keys, F.abs("__d").alias("__a")).agg(F.count(F.lit(1)).alias("__cnt"), F.count_if(F.col("__d") > 0).alias("__npos"))
    r = midranks(counts, "__a", "__cnt", "__rank", keys=keys)
    s = r.groupBy(*keys).agg(
        F.coalesce(F.sum("__cnt"), F.lit(0)).cast("long").alias("n"),
        F.sum(F.col("__rank") * F.col("__npos")).alias("w_plus"),
        F.sum(F.col("__rank") * (F.col("__cnt") - F.col("__npos"))).alias("w_minus"),
        F.sum(F.pow("__cnt", 3) - F.col("__cnt")).alias("ties"),
    )
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    return s.withColumn("z", F.try_divide(F.col("w_plus") - n * (n + 1) / 4.0, F.sqrt(var)))


def signed_rank(df: DataFrame, before: str, after: str, digits: int | None = 6) -> DataFrame:
    """Wilcoxon signed-rank statistic of ``after - before``: n, W+, W-, z (zeros dropped, tie-corrected, no continuity correction)."""
    r = _round(digits)
    return _signed(df, before, after, ()).select("n", *[r(F.col(c)).alias(c) for c in ("w_plus", "w_minus", "z")])


def _pooled_ranks(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    pooled = df.select(*keys, F.inline(F.array(F.struct(F.lit(0).alias("__g"), _number(x).alias("__v")),
                                               F.struct(F.lit(1).alias("__g"), _number(y).alias("__v")))))
    counts = pooled.where(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(
        F.count(F.lit(1)).alias("__cnt"), F.count_if(F.col("__g") == 0).alias("__cx")
    )
    r = midranks(counts, "__v", "__cnt", "__rank", keys=keys)
    return r.groupBy(*keys).agg(
        F.sum("__cx").cast("long").alias("n1"),
        (F.sum("__cnt") - F.sum("__cx")).cast("long").alias("n2"),
        F.sum(F.col("__rank") * F.col("__cx")).alias("r1"),
        F.sum(F.pow("__cnt", 3) - F.col("__cnt")).alias("ties"),
    )


def _rank_sums(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """(keys..., n1, n2, u1, u2, ties, z) of sample x against sample y."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    s = _pooled_ranks(df, x, y, keys).withColumn("u1", F.col("r1") - n1 * (n1 + 1) / 2.0)
    big_n = n1 + n2
    sigma = F.sqrt(n1 * n2 / 12.0 * ((big_n + 1) - F.try_divide(F.col("ties"), big_n * (big_n - 1))))
    return s.withColumn("u2", n1 * n2 - F.col("u1")).withColumn("z", F.try_divide(F.col("u1") - n1 * n2 / 2.0, sigma))


def rank_sum(df: DataFrame, x: str, y: str, digits: int | None = 6) -> DataFrame:
    """Mann-Whitney U of sample x against sample y over pooled midranks: n1, n2, U1, U2, z (tie-corrected)."""
    r = _round(digits)
    return _rank_sums(df, x, y, ()).select("n1", "n2", *[r(F.col(c)).alias(c) for c in ("u1", "u2", "z")])


# ---------------------------------------------------------------- significance

#: Terms of the series and levels of the fraction: both are exact to double precision on their side of ``_SPLIT``.
_TERMS, _LEVELS, _SPLIT = 70, 60, 2.5


def normal_tail(z: Column) -> Column:
    """P(Z > |z|) of a standard normal, as a column expression: a power series near 0, a continued fraction beyond."""
    x = F.abs(z) / math.sqrt(2.0)
    two_xx = 2.0 * x * x
    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    series = F.aggregate(down(_TERMS), F.lit(1.0), lambda acc, k: 1.0 + acc * two_xx / (2 * k + 1))
    near = 0.5 - F.exp(-two_xx / 2) * x * series / math.sqrt(math.pi)
    fraction = F.aggregate(down(_LEVELS), F.lit(1.0), lambda acc, k: 1.0 + k / (two_xx * acc))
    far = F.exp(-two_xx / 2) / (2.0 * math.sqrt(math.pi) * x * fraction)
    return F.when(x < _SPLIT, near).otherwise(far)


def signed_rank_count(n: Column, w: Column) -> Column:
    """How many of the 2^n sign patterns of the ranks 1..n have a positive sum of at most ``w`` (a double, exact to n = 53).

    Dynamic programming over the ranks: rank k adds the patterns that reach s - k to those that reach s.
    """
    sums = F.sequence(F.lit(0), w.cast("int"))
    start = F.transform(sums, lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    reach = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")), start, lambda acc, k: F.transform(acc, lambda c, s: c + F.coalesce(F.get(acc, s - k), F.lit(0.0)))
    )
    return F.aggregate(reach, F.lit(0.0), lambda a, c: a + c)


def rank_sum_count(n1: Column, n2: Column, u: Column) -> Column:
    """How many of the C(n1 + n2, n1) arrangements have a U of at most ``u``.

    Arrangements of U = s are partitions of s into at most n1 parts of at most n2, whose counts are the product of
    (1 - q^(n2+i)) / (1 - q^i) over i <= n1, taken up to q^u one factor at a time.
    """
    start = F.transform(F.sequence(F.lit(0), u.cast("int")), lambda s: F.when(s == 0, 1.0).otherwise(0.0))

    def factor(acc, i):
        divided = F.transform(
            acc, lambda _, s: F.aggregate(F.sequence(F.lit(0), F.floor(s / i).cast("int")), F.lit(0.0), lambda a, k: a + F.get(acc, s - i * k))
        )
        bound = F.array(divided)
        return F.element_at(F.transform(bound, lambda d: F.transform(d, lambda c, s: c - F.coalesce(F.get(d, s - i - n2.cast("int")), F.lit(0.0)))), 1)

    counts = F.aggregate(F.sequence(F.lit(1), n1.cast("int")), start, factor)
    return F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)


def _tested(s: DataFrame, p: Column, exact: Column, keys: Sequence[str], counts: list[str], numbers: list[str], digits: int | None) -> DataFrame:
    # p is computed before the numbers are rounded under their own names: inside a lambda those names would mean the rounded ones
    s = s.withColumns({"p_value": p, "method": F.when(exact, "exact").otherwise("normal")})
    r = _round(digits)
    return s.select(*keys, *counts, *[r(F.col(c)).alias(c) for c in (*numbers, "p_value")], "method")


def signed_rank_test(df: DataFrame, before: str, after: str, keys: Sequence[str] = (), exact_n: int = 50, digits: int | None = 6) -> DataFrame:
    """(keys..., n, w_plus, w_minus, z, p_value, method): two-sided Wilcoxon signed-rank test of ``after - before`` per key.

    Without ties and with at most ``exact_n`` (up to 53) nonzero deltas the p-value is exact, otherwise that of the normal
    approximation (tie-corrected, no continuity correction).  No delta: no row of a key, and p NULL without keys.
    """
    s = _signed(df, before, after, keys)
    exact = (F.col("n") > 0) & (F.col("n") <= min(exact_n, 53)) & (F.col("ties") == 0)
    low = F.least("w_plus", "w_minus")
    p = F.when(exact, F.least(F.lit(1.0), 2.0 * signed_rank_count(F.col("n"), low) / F.pow(F.lit(2.0), F.col("n")))).otherwise(F.least(F.lit(1.0), 2.0 * normal_tail(F.col("z"))))
    p = F.when(F.col("n") > 0, p)
    return _tested(s, p, exact, keys, ["n"], ["w_plus", "w_minus", "z"], digits)


def rank_sum_test(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), exact_n: int = 20, digits: int | None = 6) -> DataFrame:
    """(keys..., n1, n2, u1, u2, z, p_value, method): two-sided Mann-Whitney test of ``x`` against ``y`` per key.

    Exact without ties and with both samples of 1 to ``exact_n`` (up to 25) values, otherwise by the normal approximation;
    NULL where a sample is empty or all values are equal.
    """
    s = _rank_sums(df, x, y, keys)
    most = min(exact_n, 25)
    exact = F.col("n1").between(1, most) & F.col("n2").between(1, most) & (F.col("ties") == 0)
    ways = F.aggregate(F.sequence(F.lit(1), F.col("n1").cast("int")), F.lit(1.0), lambda a, i: a * (F.col("n2") + i) / i)
    low = F.least("u1", "u2")
    p = F.when(exact, F.least(F.lit(1.0), 2.0 * rank_sum_count(F.col("n1"), F.col("n2"), low) / ways)).otherwise(F.least(F.lit(1.0), 2.0 * normal_tail(F.col("z"))))
    p = F.when(F.col("z").isNotNull(), p)
    return _tested(s, p, exact, keys, ["n1", "n2"], ["u1", "u2", "z"], digits)


def effect_size(df: DataFrame, x: str, y: str, digits: int | None = 6) -> DataFrame:
    """Vargha-Delaney A12 of y over x = P(Y > X) + P(Y = X) / 2, with its magnitude label."""
    s = _pooled_ranks(df, x, y)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    u2 = n1 * n2 - (F.col("r1") - n1 * (n1 + 1) / 2.0)
    a12 = F.try_divide(u2, n1 * n2)
    dist = F.abs(a12 - 0.5)
    # Vargha-Delaney magnitude thresholds on |A12 - 0.5|.
    label = (
        F.when(a12.isNull(), F.lit(None))
        .when(dist >= 0.21, F.lit("large"))
        .when(dist >= 0.14, F.lit("medium"))
        .when(dist >= 0.06, F.lit("small"))
        .otherwise(F.lit("negligible"))
    )
    r6 = _round(digits)
    return s.select(r6(a12).alias("a12"), label.alias("magnitude"))
