"""The Merkle manifest against a plain tree in Python, on awkward rows and other widths."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_llm_operators import SCHEMA, awkward_rows

from runlens.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    """(root, siblings (left, right) per level of every node)."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            start = at - at % fanout
            paths[i].append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + fanout])))
        nodes = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        where = [at // fanout for at in where]
    return nodes[0], paths


def expected(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0], leaf_of(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: tree([h for _, h in groups[g]], fanout) for g in order}
    root, over = tree([trees[g][0] for g in order], fanout)
    return sorted(
        (str(g), pos, str(d), h, trees[g][0], root, tuple(trees[g][1][pos] + over[i]))
        for i, g in enumerate(order)
        for pos, (d, h) in enumerate(groups[g])
    )


def own_rows():
    rows = [(r[0], r[3], ["en", "de", None, "en", "én"][i % 5], r[4], r[1]) for i, r in enumerate(awkward_rows())]
    rows += [(9, "a", "", 1, "one of its group"), (None, None, None, None, None), (None, None, None, None, None)]
    return rows


@pytest.mark.parametrize(("fanout", "span"), [(2, 4), (2, 1), (3, 2)])
def test_proofs_match_brute_force(spark, fanout, span):
    rows = own_rows()
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    # extra columns whose names the operator uses itself
    for name in ("grp", "pos", "h", "n", "block", "nodes", "carry", "by"):
        df = df.withColumn(name, F.lit(1))
    made = merkle.build(df.repartition(3), FIELDS, "lang", "doc_id", {"again": F.col("text")}, fanout, span)
    out = merkle.proofs(made).withColumn("folded", merkle.fold(F.col("leaf"), F.col("siblings"))).collect()
    got = sorted((str(r["grp"]), r["pos"], str(r["carry"]["order"]), r["leaf"], r["subroot"], r["root"], tuple((s["left"], s["right"]) for s in r["siblings"])) for r in out)
    assert got == expected(rows, fanout)
    assert all(r["folded"] == r["root"] for r in out)
    assert sorted(str(r["carry"]["again"]) for r in out) == sorted(str(r[4]) for r in rows)
    assert [r[0] for r in made.root().collect()] == [out[0]["root"]]
    # interior levels are not kept: a row per block, and one node above it
    assert all({"grp", "block", "n", "nodes", "h"} == set(level.columns) for level in made.groups.levels)
    assert all(r["c"] <= fanout**span for level in made.groups.levels for r in level.select(F.size("nodes").alias("c")).collect())


def test_one_row_and_no_row(spark):
    one = spark.createDataFrame([(3, "s", "en", 1, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.build(one, FIELDS, "lang", "doc_id")
    row = merkle.proofs(made).first()
    assert row["leaf"] == row["subroot"] == row["root"] == leaf_of((3, "s", "en", 1, "t")) and row["siblings"] == []
    empty = spark.createDataFrame([], SCHEMA)
    made = merkle.build(empty, FIELDS, "lang", "doc_id")
    assert merkle.proofs(made).count() == 0 and made.root().count() == 0


def test_a_changed_row_is_found(spark):
    df = spark.createDataFrame([(i, "s", "en", 10, f"text {i}") for i in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    other = merkle.leaf_hash(["doc_id", "source", "lang", F.col("n_chars") + F.when(F.col("doc_id") == 17, 1).otherwise(0), "text"])
    out = merkle.proofs(merkle.build(df, FIELDS, "lang", "doc_id", {"now": other}))
    bad = out.where(merkle.fold(F.col("carry.now"), F.col("siblings")) != F.col("root")).select("carry.order").collect()
    assert [r[0] for r in bad] == [17]
