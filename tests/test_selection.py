"""Selection of the first n rows against sorted rows, for every kind of key and tie."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import groups as G
from runlens.operators import selection as SEL


def _rows():
    rng = random.Random(5)
    times = [dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rng.randint(0, 50)) for _ in range(6)]
    return [
        (rng.choice([None, 1.5, 2.0, -3.0, math.nan, math.inf, -math.inf]), rng.choice([None, "", "abcdefgh", "abcdefgi", "é", "z" * 40 + "a", "z" * 40 + "b"]),
         rng.choice([None, 2**62, 2**62 + 1, -(2**62), 5]), rng.choice([None, *times]), rng.choice([None, True, False]), rng.choice([None, dt.date(1960, 1, 1), dt.date(2020, 2, 2)]), i)
        for i in range(900)
    ]


SCHEMA = "d DOUBLE, s STRING, k BIGINT, t TIMESTAMP, b BOOLEAN, y DATE, i INT"


@pytest.mark.parametrize(
    ("small", "order"), [(3, ["d", "i"]), (3, ["s", "i"]), (3, ["k", "t", "i"]), (3, ["b", "y", "s"]), (100_000, ["t", "b", "i"]), (100_000, ["s"])]
)
def test_first_n_matches_a_sort(spark, monkeypatch, small, order):
    monkeypatch.setattr(SEL, "SMALL_BRACKET", small)
    df = spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()
    text = lambda r: tuple(map(str, r))
    for n in (1, 450, 900) if small == 3 else (333,):
        got = SEL.first_n(df, order, n).collect()
        expected = df.orderBy(*order).limit(n).collect()
        assert len(got) == len(expected) and len({r["i"] for r in got}) == len(got)
        assert sorted(text(r[c] for c in order) for r in got) == sorted(text(r[c] for c in order) for r in expected)


def test_one_value_in_all_rows(spark, monkeypatch):
    monkeypatch.setattr(SEL, "SMALL_BRACKET", 10)
    df = spark.range(500).select(F.lit(7).cast("long").alias("k"), "id")
    assert SEL.first_n(df, ["k"], 123).count() == 123
    assert SEL.first_n(df.limit(0), ["k"], 5).count() == 0 and SEL.first_n(df, ["k"], 0).count() == 0


def test_large_limit_has_no_single_task(spark):
    big = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("k"), "id")
    out = G.limit_input(big, 50_000, "k")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and "SinglePartition" not in plan.split("Subquery")[0]
    row = out.agg(F.count("*"), F.max("k")).first()
    assert row[0] == 50_000 and row[1] == sorted(i * 7919 % 200_003 for i in range(200_000))[49_999]
    assert [r["k"] for r in G.limit_input(big, 3, "k").collect()] == [0, 1, 2]
