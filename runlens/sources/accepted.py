"""Accepted artifacts that can be written again: every run adds files, a manifest says which of them count.

A run writes its projects below ``data/attempt=<id>/project=<p>`` and then, as its last step, ``manifest/<id>`` with a
row per project.  Readers take a project's rows from the last finished run that wrote the project.  No run touches
another's files: a failed one leaves no finished manifest and is invisible, and a second run with some of the projects
replaces only those.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``; none when it doesn't exist."""
    fs, where = _folder(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()] if fs.exists(where) else []


def _finished(spark: SparkSession, path: str) -> list[str]:
    """Attempts whose manifest is whole: the write puts its marker file last."""

    def done(attempt: str) -> bool:
        fs, where = _folder(spark, f"{path}/manifest/{attempt}/_SUCCESS")
        return fs.exists(where)

    return sorted(a for a in _names(spark, f"{path}/manifest") if done(a))


def write_run(df: DataFrame, path: str, run: int, partition_col: str = "project", deal: int = 0) -> str:
    """Write a run's accepted artifacts; returns the attempt's id.  A later ``run`` number wins over an earlier one.

    A run that is written again is a further attempt, the later of which wins, so a job may simply be repeated.  A
    project without rows in this run keeps its earlier rows; a null project is a project of its own; an empty table
    changes nothing.  ``deal`` spreads the rows of a project over so many files at most, by a shuffle on (project,
    random place); 0 leaves the files to the tasks as they come.
    """
    spark = df.sparkSession
    place = len(_names(spark, f"{path}/manifest"))
    attempt = f"{run:012d}-{place:08d}-{uuid.uuid4().hex[:8]}"
    if deal:
        df = df.repartition(F.col(partition_col), F.floor(F.rand(11) * deal))
    data = f"{path}/data/attempt={attempt}"
    df.write.mode("overwrite").partitionBy(partition_col).parquet(data)
    # counted from the files that stand, which are what the manifest vouches for
    schema = df.select(partition_col).schema
    written = spark.read.schema(df.schema).parquet(data) if _names(spark, data) else spark.createDataFrame([], schema)
    rows = written.groupBy(partition_col).agg(F.count(F.lit(1)).alias("n_rows"))
    rows.select(F.col(partition_col).alias("part"), "n_rows", F.lit(attempt).alias("attempt")).write.mode("overwrite").parquet(f"{path}/manifest/{attempt}")
    return attempt


def manifest(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """(part, attempt, n_rows): which attempt's files hold each project now; ``kind`` is the project column's type."""
    schema = f"part {kind}, n_rows long, attempt string"
    finished = _finished(spark, path)
    if not finished:
        return spark.createDataFrame([], schema).select("part", "attempt", "n_rows")
    log = spark.read.schema(schema).parquet(*[f"{path}/manifest/{a}" for a in finished])
    # attempts sort by run, then by place: a map-side combined aggregate
    return log.groupBy("part").agg(F.max("attempt").alias("attempt"), F.max_by("n_rows", "attempt").alias("n_rows"))


def read_accepted(spark: SparkSession, path: str, schema, partition_col: str = "project") -> DataFrame:
    """The rows that count, in ``schema`` (the written table's); files of overridden attempts are pruned by partition."""
    fields = (schema if hasattr(schema, "fields") else spark.createDataFrame([], schema).schema).fields
    kind = next(f.dataType.simpleString() for f in fields if f.name == partition_col)
    empty = spark.createDataFrame([], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
    if not _finished(spark, path) or not _names(spark, f"{path}/data"):
        return empty
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    data = spark.read.schema(f"{full}, attempt string").option("basePath", f"{path}/data").parquet(f"{path}/data")
    now = manifest(spark, path, kind).select(F.col("part").alias("__part"), F.col("attempt").alias("__attempt"))
    here = data["attempt"] == now["__attempt"]
    return data.join(now, here & data[partition_col].eqNullSafe(now["__part"]), "left_semi").select(*[f"`{f.name}`" for f in fields])


def vacuum(spark: SparkSession, path: str, kind: str = "string") -> int:
    """Delete the files of attempts that hold no project any more, failed ones included; returns their number.

    For use while no run is being written.  Attempts are told by folder, so their number, not the rows, is what the
    driver sees.
    """
    used = {r["attempt"] for r in manifest(spark, path, kind).select("attempt").distinct().collect()}
    gone = 0
    for name in _names(spark, f"{path}/data"):
        if name.removeprefix("attempt=") not in used:
            fs, where = _folder(spark, f"{path}/data/{name}")
            fs.delete(where, True)
            gone += 1
    return gone
