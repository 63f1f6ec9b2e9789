"""Incremental append (K2): a rerun with the same checkpoint appends only new files."""

import os
import shutil
import tempfile

from conftest import SF_SMALL
from runlens.operators import stats as S
from runlens.session import scratch_path
from runlens.sources import sinks as SNK
from runlens.streaming import incremental as INC


def test_rerun_appends_only_new_files(spark):
    src = tempfile.mkdtemp(prefix="stream-src-")
    shutil.copy(os.path.join(SF_SMALL, "events.parquet"), os.path.join(src, "part-a.parquet"))
    schema = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).schema
    out, ckpt = scratch_path(spark, "inc-out"), scratch_path(spark, "inc-ckpt")

    INC.stream_records(INC.stream_source(spark, src, schema), out, ckpt)
    first = spark.read.schema(schema).parquet(out).count()
    INC.stream_records(INC.stream_source(spark, src, schema), out, ckpt)  # nothing new
    assert spark.read.schema(schema).parquet(out).count() == first

    shutil.copy(os.path.join(SF_SMALL, "events.parquet"), os.path.join(src, "part-b.parquet"))
    INC.stream_records(INC.stream_source(spark, src, schema), out, ckpt)
    assert spark.read.schema(schema).parquet(out).count() == 2 * first


def test_describe_summary_csv_round_trip(spark):
    df = spark.createDataFrame([(float(i), float(i * 2)) for i in range(9)], "a DOUBLE, b DOUBLE")
    desc = S.describe_numeric(df, ["a", "b"])
    path = scratch_path(spark, "summary")
    SNK.write_summary(desc.orderBy("stat_order"), path)
    back = spark.read.option("header", True).schema(desc.schema).csv(path).collect()
    assert [r.statistic for r in back] == ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    assert [r.a for r in back][4:7] == [2.0, 4.0, 6.0]
