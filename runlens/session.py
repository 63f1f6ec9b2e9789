"""Session helpers: a local session for tests/bench and a shared scratch folder.

On a cluster the session comes from the caller; nothing here overrides cluster
settings.  Scratch output always goes below ``spark.checkpoint.dir`` (the shared
folder the cluster names); a local folder is only chosen when that setting is
unset, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "runlens") -> SparkSession:
    """A local session tuned for small-SF runs (tests, bench)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.default.parallelism", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; a local master gets one of its own when none is set.

    On a cluster every executor would write to its own disk, so an unset
    ``spark.checkpoint.dir`` is an error there.
    """
    current = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{_CHECKPOINT_KEY} must name a folder that all executors of {master} share")
        current = tempfile.mkdtemp(prefix="runlens-ckpt-")
        spark.conf.set(_CHECKPOINT_KEY, current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


# Scratch folders of each application that ``release`` has not deleted yet.
_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for intermediate tables; ``release`` deletes it."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "runlens-scratch", f"{name}-{uuid.uuid4().hex[:12]}")
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_paths(spark: SparkSession) -> list[str]:
    """Scratch folders written since the last ``release``."""
    return list(_SCRATCH.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession) -> int:
    """Delete the scratch tables of this application; returns their number.

    Operators that read a table more than once write it when they are called
    (see ``materialize``), and the DataFrames they return read those files.  Call
    this once those results have been written or collected.
    """
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def materialize(df, name: str = "materialized"):
    """Cut lineage by writing a Parquet table in the shared checkpoint folder and reading it back.

    Used for tables that several plan branches (and a sampling job) read, so
    the upstream work runs once (one job: ``checkpoint()`` would compute its
    input twice unless cached).  A lost executor re-reads the files instead of
    recomputing.  Never ``localCheckpoint``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
