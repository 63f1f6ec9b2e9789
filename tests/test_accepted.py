"""Accepted artifacts written again and again: later runs, failed runs, repeated runs."""

import pytest
from pyspark.sql import functions as F

from runlens.sources import accepted as AC

SCHEMA = "id long, code string, project string"


def _table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def _rows(spark, path):
    return sorted((tuple(r) for r in AC.read_accepted(spark, path, SCHEMA).collect()), key=str)


def test_a_second_run_replaces_only_its_projects(spark, tmp_path):
    path = str(tmp_path / "out")
    assert _rows(spark, path) == []
    AC.write_run(_table(spark, [(1, "a", "p"), (2, "b", "q"), (3, "c", None), (4, "d", "q/x=1")]), path, 1)
    AC.write_run(_table(spark, [(5, "e", "q"), (6, None, "r")]), path, 2)
    assert _rows(spark, path) == sorted([(1, "a", "p"), (5, "e", "q"), (3, "c", None), (4, "d", "q/x=1"), (6, None, "r")], key=str)
    AC.write_run(_table(spark, [(7, "f", "q"), (7, "f", "q"), (8, "g", "p"), (9, "h", None)]), path, 1)  # an earlier run, written late
    assert _rows(spark, path) == sorted([(8, "g", "p"), (5, "e", "q"), (9, "h", None), (4, "d", "q/x=1"), (6, None, "r")], key=str)
    counts = {r["part"]: r["n_rows"] for r in AC.manifest(spark, path).collect()}
    assert counts == {"p": 1, "q": 1, None: 1, "q/x=1": 1, "r": 1}


def test_a_failed_run_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    first = [(i, "old", f"p{i % 4}") for i in range(20)]
    AC.write_run(_table(spark, first), path, 1)
    bad = _table(spark, [(i, "new", f"p{i % 4}") for i in range(20)]).repartition(4).withColumn("code", F.when(F.col("id") == 13, F.raise_error(F.lit("lost"))).otherwise(F.col("code")))
    with pytest.raises(Exception, match="lost"):
        AC.write_run(bad, path, 2)
    assert _rows(spark, path) == sorted(first, key=str)
    # data stands, the manifest doesn't: the run ended between its two steps
    _table(spark, [(99, "half", "p1")]).write.partitionBy("project").parquet(f"{path}/data/attempt=000000000003-00000009-dead")
    assert _rows(spark, path) == sorted(first, key=str)
    _table(spark, [(99, "half", "p1")]).select(F.col("project").alias("part"), F.lit(1).cast("long").alias("n_rows"), F.lit("x").alias("attempt")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/manifest/000000000003-00000009-dead")
    assert _rows(spark, path) == sorted(first, key=str)


def test_repeated_and_empty_runs_and_vacuum(spark, tmp_path):
    path = str(tmp_path / "out")
    AC.write_run(_table(spark, [(1, "a", "p"), (2, "b", "q")]), path, 1, deal=3)
    AC.write_run(_table(spark, [(1, "A", "p"), (2, "B", "q")]), path, 1)  # the same run again: its later attempt wins
    AC.write_run(_table(spark, []), path, 2)
    expected = [(1, "A", "p"), (2, "B", "q")]
    assert _rows(spark, path) == expected
    assert AC.vacuum(spark, path) == 2  # the first attempt and the empty run
    assert _rows(spark, path) == expected
    assert AC.vacuum(spark, path) == 0


def test_overridden_files_are_pruned(spark, tmp_path):
    path = str(tmp_path / "out")
    AC.write_run(_table(spark, [(1, "a", "p")]), path, 1)
    plan = AC.read_accepted(spark, path, SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "BroadcastHashJoin" in plan
