"""Sources: manifests, run-record JSON, file listings, whole-text artifacts, pairs, reports.

Every reader takes an explicit schema (no inference) so plans are stable and
the scan prunes columns.
"""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST_SCHEMA = T.StructType([T.StructField("project", T.StringType()), T.StructField("class", T.StringType())])


def scan_order() -> Column:
    """Sortable input order of a file scan: (file path, split start, id inside the split).

    Taken right after the scan, ``monotonically_increasing_id`` counts rows of
    one split in read order; the split start orders splits of one file.
    """
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def _header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names in a CSV file's first line; empty for an empty file."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        line = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return tuple(next(csv.reader([line.lstrip("\ufeff")]))) if line else ()


def read_manifest(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """Header CSV with (project, class) among its columns, all strings; empty fields read as '' (not NULL).

    Columns are bound by the header of each file, in any order, and others are ignored; a file without one of the two
    is an error that names it, and an empty file holds no rows.  Files of the same header are read by one scan.  Quotes
    inside a quoted field are doubled.  ``multiline`` admits quoted line breaks behind the header (such files are not
    split).  Adds ``ordinal`` (a sortable struct) that keeps file order.  The driver opens every file once for its
    first line, as it lists every file.
    """
    files = spark.read.text(path).inputFiles()
    by_header: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(16) as pool:
        for f, header in zip(files, pool.map(lambda f: _header(spark, f), files), strict=True):
            by_header.setdefault(header, []).append(f)
    out = None
    for header, group in sorted(by_header.items()):
        if not header:
            continue
        missing = [f for f in MANIFEST_SCHEMA.names if f not in header]
        if missing:
            raise ValueError(f"manifest columns {missing} are not in the header {list(header)} of {group[0]}")
        # by position: names that repeat, or differ in case alone, don't matter
        columns = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        reader = spark.read.schema(columns).option("header", True).option("escape", '"').option("multiLine", multiline)
        df = reader.csv(group).select(
            scan_order().alias("ordinal"), *[F.coalesce(F.col(f"c{header.index(n)}"), F.lit("")).alias(n) for n in MANIFEST_SCHEMA.names]
        )
        out = df if out is None else out.unionByName(df)
    if out is None:
        return spark.read.schema(MANIFEST_SCHEMA).csv(path).select(scan_order().alias("ordinal"), "project", "class")
    return out


def read_first_existing(spark: SparkSession, paths: Sequence[str], reader: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Read the first path that exists; a path that exists but can't be read is an error."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where):
            return reader(spark, p)
    raise FileNotFoundError(f"none of {list(paths)} exists")


def read_runs(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = False) -> DataFrame:
    """Run records as JSON with a fixed schema; absent keys read as NULL.

    ``multiline=True`` reads one JSON array per file (does not split); JSON Lines
    or Parquet split and should be preferred at scale.
    """
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def list_files(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, bytes, modified) of files below ``root``; file contents are pruned from the scan."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    return r.load(root).select(F.col("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def read_artifacts(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, text): one row per whole text file; files gone before the scan are skipped."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    return r.text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_pairs(spark: SparkSession, path: str, source: str = "source", target: str = "target", keys: Sequence[str] = ()) -> DataFrame:
    """Training pairs from a Parquet snapshot: only ``keys``, source and target are read."""
    return spark.read.parquet(path).select(*keys, source, target)


def read_coverage_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header coverage report CSV (columns as strings)."""
    return spark.read.option("header", True).csv(path)


def report_available(df: DataFrame) -> DataFrame:
    """A report is usable when it has at least one data row after the header."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("available", F.col("n_rows") > 0)
