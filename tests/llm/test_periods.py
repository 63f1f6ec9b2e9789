"""Periodic runs against brute force: the run finder, the operator on awkward rows, and the query on sf0.001."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from test_llm_operators import SCHEMA, awkward_rows

from runlens.llm import periods
from runlens.llm.queries import QUERIES


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def brute(w, min_words=6, min_periods=4):
    out = {}
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(min_words, min_periods * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def sequences(rng):
    for _ in range(rng.randint(1, 4)):
        n, kind = rng.randint(0, 90), rng.random()
        if kind < 0.3:
            yield [rng.randint(0, 1) for _ in range(n)]
        elif kind < 0.6:
            loop = [rng.randint(0, 2) for _ in range(rng.randint(1, 15))]
            yield [rng.randint(0, 2) for _ in range(rng.randint(0, 6))] + (loop * 9)[:n] + [rng.randint(0, 2) for _ in range(rng.randint(0, 6))]
        elif kind < 0.85:  # periodic blocks inside the period
            inner = ([0] * rng.randint(1, 9) + [1]) * rng.randint(1, 7) + [0] * rng.randint(0, 4)
            yield inner * rng.randint(1, 5)
        else:
            yield [0] * n


@pytest.mark.parametrize("least", [(6, 4), (1, 4), (10, 5)])
def test_runs_match_brute_force(least):
    rng = random.Random(least[0])
    for _ in range(700):
        many = list(sequences(rng))
        owner = np.repeat(np.arange(len(many)), [len(w) for w in many])
        first = np.r_[0, np.cumsum([len(w) for w in many])]
        got = list(zip(*(x.tolist() for x in periods.find_runs(np.array([x for w in many for x in w], dtype=np.uint64), owner, *least)), strict=True))
        assert got == [(first[k] + s, n, q) for k, w in enumerate(many) for s, n, q in brute(w, *least)]


def test_wavelet_tree_counts_and_selects():
    rng = np.random.default_rng(0)
    values = rng.permutation(200)
    tree = periods.WaveletTree(values)
    lo = rng.integers(0, 199, 300)
    hi = lo + 1 + rng.integers(0, 200 - lo)
    x, k = rng.integers(0, 201, 300), rng.integers(0, hi - lo)
    assert tree.below(lo, hi, x).tolist() == [int((values[a:b] < c).sum()) for a, b, c in zip(lo, hi, x, strict=True)]
    assert tree.nth(lo, hi, k).tolist() == [int(np.sort(values[a:b])[c]) for a, b, c in zip(lo, hi, k, strict=True)]


def test_few_periods_are_refused():
    with pytest.raises(ValueError):
        periods.find_runs(np.zeros(3, dtype=np.uint64), np.zeros(3, dtype=int), 6, 3)


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_operator_matches_brute_force(spark):
    rows = [r for r in awkward_rows() if len(r[1] or "") < 20_000]
    rows += [(900 + i, t, "en", "a", 1, True, 1, 2) for i, t in enumerate(["x " * 4000, "é 日 " * 40 + "end", "a a a a a", "a\x0ba\ta\na\ra a", "one two three " * 4])]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("runs", F.lit(1)).withColumn("n_words", F.lit(1)).withColumn("collapsed", F.lit(1)).repartition(3)
    out = periods.periodic_runs(docs).collect()
    runs = {r[1]: brute(words_of(r[1])) for r in rows}
    expected = Counter((r[0], len(words_of(r[1])), tuple(runs[r[1]]), collapsed(words_of(r[1]), runs[r[1]])) for r in rows)
    assert Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in out) == expected
    assert periods.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text(spark):
    text = "intro " + "spam eggs ham " * 100_000 + "outro"
    row = periods.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 300_000, 3)] and row["collapsed"] == "intro spam eggs ham outro"


def test_query_matches_brute_force(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for doc_id, text in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect():
        w, h = words_of(text), zlib.crc32(str(doc_id).encode())
        n, g = len(w), zlib.crc32(str(doc_id).encode()) // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        expected.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(collapsed(w, runs))))
    got = QUERIES["op13_periodic_runs"](spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(expected)
    assert sum(1 for r in expected if r[1]) > 10
