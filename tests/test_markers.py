"""Marker search against a brute-force scan of every text for every marker."""

import random

import pytest

from runlens.operators import markers as MK


def _brute(docs, markers, fold=lambda s: s):
    out = []
    for i, text in docs:
        text = fold(text or "")
        for m in {fold(m) for m in markers if m}:
            at = [p for p in range(len(text)) if text.startswith(m, p)]
            if at:
                out.append((i, m, len(at), at[0] + 1))
    return sorted(out, key=str)


def _tables(spark, docs, markers):
    return spark.createDataFrame(docs, "doc long, body string").repartition(3), spark.createDataFrame([(m,) for m in markers], "m string")


@pytest.mark.parametrize("max_chars", [MK.MAX_CHARS, 400, 7])
@pytest.mark.parametrize("ignore_case", [False, True])
def test_equals_brute_force(spark, max_chars, ignore_case):
    rng = random.Random(5)
    docs = [(i, "".join(rng.choice("abAB é") for _ in range(rng.randrange(200)))) for i in range(40)]
    docs += [(None, "abab"), (7, "aaaa"), (7, "aaaa"), (8, None), (9, "")]
    markers = ["".join(rng.choice("abA é") for _ in range(rng.randrange(1, 6))) for _ in range(300)] + [None, "", "aa", "aa", "𝄞"]
    if max_chars == 7:  # a pass per few markers
        markers = markers[-30:]
    d, m = _tables(spark, docs, markers)
    got = sorted((tuple(r) for r in MK.find_markers(d, m, "doc", "body", "m", ignore_case, max_chars).collect()), key=str)
    assert got == _brute(docs, markers, str.lower if ignore_case else (lambda s: s))


def test_overlaps_nested_markers_and_wide_characters(spark):
    d, m = _tables(spark, [(1, "𝄞he shers"), (2, "aaaa")], ["he", "she", "hers", "aa", "𝄞"])
    got = {tuple(r) for r in MK.find_markers(d, m, "doc", "body", "m").collect()}
    assert got == {(1, "he", 2, 2), (1, "she", 1, 5), (1, "hers", 1, 6), (1, "𝄞", 1, 1), (2, "aa", 3, 1)}


def test_many_markers_and_a_very_long_text(spark):
    markers = [f"k{i:05d};" for i in range(10_000)]
    text = "".join(markers) * 20
    d, m = _tables(spark, [(1, text), (2, "k00001; k99999;")], markers)
    rows = MK.find_markers(d, m, "doc", "body", "m").collect()
    assert len(rows) == 10_001
    assert {(r["n"], r["first_at"]) for r in rows if r["doc"] == 1} == {(20, 7 * i + 1) for i in range(10_000)}


def test_empty_tables_and_clashing_names(spark):
    docs, markers = _tables(spark, [(1, "x")], ["x"])
    assert MK.find_markers(docs.where("false"), markers, "doc", "body", "m").count() == 0
    assert MK.find_markers(docs, markers.where("false"), "doc", "body", "m").columns == ["doc", "marker", "n", "first_at"]
    clash = docs.selectExpr("doc AS marker", "body AS id", "1 AS part", "2 AS n")
    assert [tuple(r) for r in MK.find_markers(clash, markers, "marker", "id", "m").toPandas().itertuples(index=False)] == [(1, "x", 1, 1)]
