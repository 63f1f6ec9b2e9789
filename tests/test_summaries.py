"""Stored and merged describe states against the whole table."""

import math
import random
import statistics

import pytest

from runlens.operators import summaries as SM


def _values(kind, n=4000):
    rng = random.Random(9)
    if kind == "offset":  # a large mean and a small spread: sums of squares would lose every digit
        return [1e9 + rng.random() for _ in range(n)]
    if kind == "hot":  # a third of one value
        return [5.0] * (n // 3) + [rng.gauss(0, 10) for _ in range(n - n // 3)]
    return [rng.paretovariate(1.1) for _ in range(n)]


def _ranks_hold(values, q, value, error):
    below, upto = sum(v < value for v in values), sum(v <= value for v in values)
    return below / len(values) - error <= q <= upto / len(values) + error


@pytest.mark.parametrize("kind", ["offset", "hot", "heavy tail"])
def test_halves_merge_to_the_whole(spark, tmp_path, kind):
    values = _values(kind)
    df = spark.createDataFrame([(i, v, None if i % 3 else v) for i, v in enumerate(values)], "i long, a double, b double").repartition(4)
    path = str(tmp_path / "state")
    SM.store_state(df.where("i < 500"), ["a", "b"], path, 0, k=256)
    SM.store_state(df.where("i >= 500"), ["a", "b"], path, 1, k=256)
    SM.store_state(df.where("i >= 500"), ["a", "b"], path, 1, k=256)  # again: replaces itself
    merged = {r["column"]: r for r in SM.describe_merged(SM.merge_states(SM.stored_states(spark, path), 256)).collect()}
    for column, expected in (("a", values), ("b", values[::3])):
        r = merged[column]
        assert (r["n"], r["min"], r["max"]) == (len(expected), min(expected), max(expected))
        assert math.isclose(r["mean"], statistics.fmean(expected), rel_tol=1e-12)
        assert math.isclose(r["std"], statistics.stdev(expected), rel_tol=1e-6)
        for q, value in zip((0.25, 0.5, 0.75), r["quantiles"], strict=True):
            assert value in expected and _ranks_hold(expected, q, value, SM.rank_error(256))


def test_merging_merged_states(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(300)], "i long, a double")
    parts = [SM.describe_state(df.where(f"i % 5 = {p}"), ["a"]) for p in range(5)]
    left = SM.merge_states(parts[0].unionByName(parts[1]))
    right = SM.merge_states(parts[2].unionByName(parts[3]).unionByName(parts[4]))
    both, whole = (SM.describe_merged(s).first() for s in (SM.merge_states(left.unionByName(right)), SM.describe_state(df, ["a"])))
    assert both["n"] == whole["n"] == 300 and both["quantiles"] == whole["quantiles"]
    assert math.isclose(both["mean"], whole["mean"], rel_tol=1e-12) and math.isclose(both["std"], whole["std"], rel_tol=1e-12)


def test_single_rows_nulls_nan_and_nothing(spark):
    df = spark.createDataFrame([(2.5, None), (float("nan"), None), (None, None)], "a double, b double")
    assert [tuple(r) for r in SM.describe_merged(SM.merge_states(SM.describe_state(df, ["a", "b"]))).collect()] == [("a", 1, 2.5, None, 2.5, 2.5, [2.5] * 3)]
    assert SM.merge_states(SM.describe_state(df.where("false"), ["a"])).count() == 0
