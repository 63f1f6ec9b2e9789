"""Substring joins against a plain loop, and their plans."""

import random

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from runlens.operators import substring as SUB


def _tables(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abAB.é") for _ in range(n))
    names = [(rng.choice(["p", "q"]), i, word(rng.randint(0, 12))) for i in range(300)] + [("p", 300, None), ("q", 301, "x" * 3000 + "needle"), ("p", 302, "abab")]
    reqs = [(rng.choice(["p", "q", "r"]), i, word(rng.randint(0, 6))) for i in range(120)]
    reqs += [("q", 900, "needle"), ("p", 901, None), ("p", 902, ""), ("q", 903, "a"), ("p", 904, "Éa"), ("p", 905, "abab"), ("p", 905, "abab"), (None, 906, "a"), ("p", 907, "a\nb")]
    return reqs, names, spark.createDataFrame(reqs, "grp STRING, id INT, want STRING"), spark.createDataFrame(names, "grp STRING, pos INT, name STRING").repartition(4)


@pytest.mark.parametrize(("q", "ignore_case", "per_place", "sent"), [(3, True, 100_000, 200_000), (2, False, 5, 200_000), (3, True, 3, 0)])
def test_first_containing_matches_a_loop(spark, monkeypatch, q, ignore_case, per_place, sent):
    monkeypatch.setattr(SUB, "PER_PLACE", per_place)
    monkeypatch.setattr(SUB, "SENT_GRAMS", sent)
    reqs, names, req_df, name_df = _tables(spark)
    fold = (lambda s: s.lower()) if ignore_case else (lambda s: s)
    expected = []
    for g, i, want in reqs:
        hits = [(pos, n) for h, pos, n in names if want is not None and g == h and n is not None and fold(want) in fold(n)]
        expected.append((str(g), i, str(want), min(hits)[1] if hits else None, len(hits)))
    got = SUB.first_containing(req_df, name_df, "want", "name", ["pos"], ["grp"], q=q, ignore_case=ignore_case).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((str(r[0]), r[1], str(r[2]), r[3], r[4]) for r in got), key=key) == sorted(expected, key=key)


def test_empty_tables(spark):
    _, _, req, names = _tables(spark)
    none = SUB.first_containing(req, names.limit(0), "want", "name", ["pos"], ["grp"]).collect()
    assert len(none) == req.count() and all(r["match"] is None and r["n_candidates"] == 0 for r in none)
    assert SUB.first_containing(req.limit(0), names, "want", "name", ["pos"], ["grp"]).count() == 0


@pytest.mark.parametrize("name", ["archive_substring", "name_substring"])
def test_no_nested_loop(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
