"""Significance: tables of the exact distributions, plain enumeration, and the normal tail."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from runlens.operators import ranks as RK


def test_normal_tail(spark):
    zs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.96, 2.5, 3.5355, 3.5356, 4.0, 6.0, 8.0, 20.0, 38.0, -1.96]
    got = [r[0] for r in spark.createDataFrame([(float(z),) for z in zs], "z DOUBLE").select(RK.normal_tail(F.col("z"))).collect()]
    for z, p in zip(zs, got, strict=True):
        assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)) / 2, rel=1e-10), z


def test_signed_rank_p_values_match_enumeration(spark):
    rows, expected = [], {}
    for n in (1, 2, 3, 5, 8, 10):
        for trial in range(3):
            deltas = [(k + 1) * (1 if (k * 7 + trial * 5 + n) % 3 else -1) for k in range(n)]
            rows += [(f"{n}/{trial}", 0.0, float(d)) for d in deltas]
            w = min(sum(d for d in deltas if d > 0), -sum(d for d in deltas if d < 0))
            at_most = sum(1 for signs in itertools.product((0, 1), repeat=n) if sum(k + 1 for k in range(n) if signs[k]) <= w)
            expected[f"{n}/{trial}"] = min(1.0, 2 * at_most / 2**n)
    # Two-sided p of W = 8 at n = 10 and W = 52 at n = 20, from published tables of the exact distribution
    rows += [("ten", 0.0, float(d)) for d in (1, 7, *(-k for k in (2, 3, 4, 5, 6, 8, 9, 10)))]
    expected["ten"] = 0.048828125
    got = {r["g"]: (r["p_value"], r["method"]) for r in RK.signed_rank_test(spark.createDataFrame(rows, "g STRING, b DOUBLE, a DOUBLE"), "b", "a", ["g"], digits=None).collect()}
    assert {g: p for g, (p, _) in got.items()} == pytest.approx(expected, abs=1e-12) and all(m == "exact" for _, m in got.values())


def test_rank_sum_p_values_match_enumeration(spark):
    rows, expected = [], {}
    for n1, n2 in ((1, 1), (1, 4), (3, 3), (4, 6), (5, 2), (6, 6)):
        for trial in range(2):
            order = sorted(range(n1 + n2), key=lambda v: (v * 5 + trial * 3 + n1) % 7)
            x, y = order[:n1], order[n1:]
            rows += [(f"{n1}/{n2}/{trial}", float(v), None) for v in x] + [(f"{n1}/{n2}/{trial}", None, float(v)) for v in y]
            u_of = lambda a, n=n1 + n2: sum(1 for p in a for q in range(n) if q not in a and p > q)
            u = min(u_of(set(x)), n1 * n2 - u_of(set(x)))
            ways = [u_of(set(c)) for c in itertools.combinations(range(n1 + n2), n1)]
            expected[f"{n1}/{n2}/{trial}"] = min(1.0, 2 * sum(1 for w in ways if w <= u) / len(ways))
    got = {r["g"]: r["p_value"] for r in RK.rank_sum_test(spark.createDataFrame(rows, "g STRING, x DOUBLE, y DOUBLE"), "x", "y", ["g"], digits=None).collect()}
    assert got == pytest.approx(expected, abs=1e-12)


def test_ties_large_samples_and_empty_tables(spark):
    rows = [("tied", 0.0, d) for d in (1.0, 1.0, 2.0, -3.0)] + [("many", 0.0, float(k) * (-1) ** k) for k in range(1, 80)] + [("none", 1.0, 1.0), ("null", None, 2.0), ("nan", float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "g STRING, b DOUBLE, a DOUBLE")
    got = {r["g"]: r for r in RK.signed_rank_test(df, "b", "a", ["g"], digits=None).collect()}
    assert set(got) == {"tied", "many"} and {r["method"] for r in got.values()} == {"normal"}
    for r in got.values():
        assert r["p_value"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), rel=1e-9)
    empty = RK.signed_rank_test(df.limit(0), "b", "a").first()
    assert empty["n"] == 0 and empty["p_value"] is None
    same = RK.rank_sum_test(spark.createDataFrame([(1.0, 1.0)] * 3, "x DOUBLE, y DOUBLE"), "x", "y").first()
    assert same["n1"] == 3 and same["p_value"] is None
    alone = RK.rank_sum_test(spark.createDataFrame([(1.0, None)], "x DOUBLE, y DOUBLE"), "x", "y").first()
    assert alone["n2"] == 0 and alone["p_value"] is None
