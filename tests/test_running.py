"""Keyed streams: late and repeated records, restarts, and batches that run again."""

import random

import pytest
from pyspark.sql import functions as F

from runlens.operators import ordering as O
from runlens.operators import runs as R
from runlens.session import scratch_path
from runlens.streaming import incremental as INC
from runlens.streaming import running as RUN

SCHEMA = "ordinal INT, project STRING, success BOOLEAN, note STRING"


def _batches():
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([True, False, None]), f"n{i}") for i in range(200)]
    rng.shuffle(rows)
    cut = [rows[:70], rows[70:140], rows[140:]]
    cut[1] += cut[0][:20]  # repeated
    cut[2] += [(None, "a", True, "no order"), (None, "only", True, "no order")]
    return cut


@pytest.mark.parametrize("kind", ["latest", "tally"])
def test_stream_state_equals_batch(spark, kind):
    src, out, ckpt = (scratch_path(spark, f"{kind}-{n}") for n in ("src", "out", "ckpt"))
    state = (lambda s: RUN.keyed_latest(s, ["project"], "ordinal")) if kind == "latest" else (lambda s: RUN.running_tally(s, ["project"]))
    seen, schema = [], spark.createDataFrame([], SCHEMA).schema
    for i, rows in enumerate(_batches()):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = INC.stream_source(spark, src, schema)
        RUN.write_changes(state(stream), out, ckpt)
        seen += rows
        whole = spark.createDataFrame(seen, SCHEMA)
        if kind == "tally":
            expected, names = R.run_summary(whole, ["project"]), "project STRING, total BIGINT, successes BIGINT, percent DOUBLE"
        else:
            expected, names = O.latest(whole.where("ordinal IS NOT NULL"), ["project"], "ordinal", unique_order=False), "project STRING, ordinal INT, success BOOLEAN, note STRING"
            if i == 2:
                expected = expected.unionByName(spark.createDataFrame([("only", None, True, "no order")], names))
        log = RUN.history(spark, out, names)
        rows_of = lambda df: sorted(map(str, df.select(*expected.columns).collect()))
        assert rows_of(RUN.current(log, ["project"])) == rows_of(expected)
        assert [r[0] for r in log.select("batch_id").distinct().orderBy("batch_id").collect()] == list(range(i + 1))
    # a restart without new input, and the last batch once more, change nothing
    before = sorted(map(str, RUN.history(spark, out, names).collect()))
    RUN.write_changes(state(INC.stream_source(spark, src, schema)), out, ckpt)
    assert sorted(map(str, RUN.history(spark, out, names).collect())) == before


def test_a_batch_that_fails_half_way_is_written_once(spark):
    src, out, ckpt = (scratch_path(spark, f"fail-{n}") for n in ("src", "out", "ckpt"))
    schema = spark.createDataFrame([], SCHEMA).schema
    spark.createDataFrame(_batches()[0], SCHEMA).write.parquet(src)
    state = RUN.running_tally(INC.stream_source(spark, src, schema), ["project"])
    # rows of an attempt that was cut off, which the batch overwrites
    spark.createDataFrame([("a", 999, 999, 0.0)], "project STRING, total BIGINT, successes BIGINT, percent DOUBLE").write.parquet(f"{out}/batch_id=0")
    RUN.write_changes(state, out, ckpt)
    log = RUN.history(spark, out, "project STRING, total BIGINT, successes BIGINT, percent DOUBLE")
    assert log.where(F.col("total") == 999).count() == 0 and log.agg(F.sum("total")).first()[0] == 70
