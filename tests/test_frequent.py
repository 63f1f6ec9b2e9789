"""The most frequent values against a plain count, for every skew."""

import random
from collections import Counter

import pytest

from runlens.operators import frequent as FQ


def _column(kind, rng):
    if kind == "zipf":
        return [f"w{int(rng.paretovariate(0.9))}" for _ in range(6000)]
    if kind == "hot":  # one value holds a third, all others are alone
        return ["hot"] * 2000 + [f"u{i}" for i in range(4000)]
    if kind == "ties":
        return [f"t{i % 50}" for i in range(3000)] + [None] * 500
    if kind == "flat":
        return [f"u{i}" for i in range(3000)]
    return []


@pytest.mark.parametrize("kind", ["zipf", "hot", "ties", "flat", "empty"])
@pytest.mark.parametrize(("k", "counters"), [(1, 4), (10, 8), (60, 4096), (10_000, 16)])
def test_equals_a_plain_count(spark, kind, k, counters):
    rows = _column(kind, random.Random(3))
    random.Random(4).shuffle(rows)
    df = spark.createDataFrame([(r,) for r in rows], "word string").repartition(5)
    got = [(r["value"], r["n"], r["rank"]) for r in FQ.most_frequent(df, "word", k, counters, 1024).orderBy("rank").collect()]
    counted = sorted(Counter(r for r in rows if r is not None).items(), key=lambda x: (-x[1], x[0]))[:k]
    assert got == [(v, n, i + 1) for i, (v, n) in enumerate(counted)]


def test_summaries_are_bounded_and_prove_the_hot_value(spark):
    rows = ["hot"] * 2000 + [f"u{i}" for i in range(4000)]
    random.Random(4).shuffle(rows)
    values = spark.createDataFrame([(r,) for r in rows], "value string").repartition(5)
    summary = values.mapInArrow(FQ._summaries(16), "value string, n long").collect()
    assert len(summary) <= 5 * 17
    lost = sum(r["n"] for r in summary if r["value"] is None)
    assert lost <= len(rows) / 17
    assert sum(r["n"] for r in summary if r["value"] == "hot") >= 2000 - lost
    assert "hot" in {r["value"] for r in FQ.candidates(values, 1, 16).collect()}
    assert FQ.candidates(values, 2, 16) is None  # the second value can't be told: all others occur once


def test_other_types_and_no_rows_wanted(spark):
    df = spark.createDataFrame([(5, 1.5), (5, None), (7, 1.5), (7, 2.0), (None, 1.5)], "a long, b double")
    assert [tuple(r) for r in FQ.most_frequent(df, "a", 1).collect()] == [(5, 2, 1)]
    assert [tuple(r) for r in FQ.most_frequent(df, df.b * 2, 5).orderBy("rank").collect()] == [(3.0, 3, 1), (4.0, 1, 2)]
    assert FQ.most_frequent(df, "a", 0).count() == 0
    nans = spark.createDataFrame([(float("nan"),), (float("nan"),), (0.0,)], "b double")
    assert [(str(r["value"]), r["n"]) for r in FQ.most_frequent(nans, "b", 1).collect()] == [("nan", 2)]
