"""The pipeline's stages against brute force on sf0.001, and the registered queries against DuckDB."""

import re
from collections import Counter

import pytest

import __spark_entry__ as E
import corpus_pipeline
from conftest import SF_SMALL
from runlens.llm import unigram
from runlens.llm.oracle import ORACLE
from runlens.llm.queries import QUERIES, TOKENIZER


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL)
    expected = duck.sql(ORACLE[name])
    columns = sorted(expected.columns)
    assert columns == sorted(got.columns)
    as_rows = lambda pdf: Counter(tuple(str(x) for x in r) for r in pdf[columns].itertuples(index=False))
    assert as_rows(got.toPandas()) == as_rows(expected.df())


def test_every_operator_and_the_pipeline_are_registered():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and len(corpus_pipeline.STAGES) == 5


def test_stages_follow_each_other(spark, duck, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("__x", __import__("pyspark").sql.functions.lit(1))
    columns = docs.columns
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF_SMALL).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        rows, old = after.collect(), before.collect()
        ids = Counter(r["doc_id"] for r in rows)
        if i < 4:
            assert after.columns == columns and ids.keys() <= {r["doc_id"] for r in old}
        if name == "quality rules":
            verdict = {r[0]: r[1] for r in duck.sql(f"SELECT doc_id, kept FROM ({ORACLE['op3_quality_rules']})").fetchall()}
            assert ids == Counter(d for d, k in verdict.items() if k)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "exact dedup":
            keys = [re.sub(r"\s", "", r["text"]) for r in rows]
            assert len(set(keys)) == len(keys) and set(keys) == {re.sub(r"\s", "", r["text"]) for r in old}
        elif name == "near dedup":
            assert max(ids.values()) == 1
        elif name == "mixing":
            assert max(ids.values()) <= 2
            total = sum(len(words_of(r["text"])) for r in rows)
            assert total == pytest.approx(1.5 * sum(len(words_of(r["text"])) for r in old), rel=0.25)
        else:
            model = unigram.UnigramModel.load(TOKENIZER)
            texts = {r["doc_id"]: r["text"] for r in old}
            assert ids == Counter(r["doc_id"] for r in old)
            assert all(model.decode(r["ids"]) == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in rows)
        before = after


def test_stages_take_awkward_rows(spark):
    from test_llm_operators import SCHEMA, awkward_rows

    rows = [r for r in awkward_rows() if len(r[1] or "") < 20_000]
    names = ["__id", "__fp", "__gone", "doc", "own_doc_id", "want_doc_id", "gone", "cut", "copy", "copies", "row_fp", "removed_lines"]
    docs = spark.createDataFrame(rows, SCHEMA)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, __import__("pyspark").sql.functions.lit(i))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        got = out.collect()
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0
        if name != "sentencepiece":
            assert out.columns == docs.columns and got
            assert all(r[n] == i for r in got for i, n in enumerate(names))
            assert {r["doc_id"] for r in got} <= {r[0] for r in rows}
