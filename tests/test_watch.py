"""Checks that ride on a write agree with the same checks run as queries."""

import pytest
from pyspark.sql import functions as F

from runlens.operators import checks as QC


def _both(spark, df, tmp_path):
    asked = [QC.min_count("rows", df, 3), QC.min_count("many", df, 100, severity="warning", fail_passes=True), QC.required_present("langs", df, "lang", ["en", "de", "fr"])]
    watched = [QC.watch_count("rows", 3), QC.watch_count("many", 100, severity="warning", fail_passes=True), QC.watch_required("langs", "lang", ["en", "de", "fr"])]
    got = QC.checks_while_writing(df, watched, lambda d: d.write.mode("overwrite").parquet(str(tmp_path / "t")))
    want = QC.run_checks(asked)
    assert got.dtypes == want.dtypes
    assert [tuple(r) for r in got.orderBy("check_no").collect()] == [tuple(r) for r in want.orderBy("check_no").collect()]
    return spark.read.parquet(str(tmp_path / "t"))


@pytest.mark.parametrize("rows", [[], [("en",)], [("en",), (None,), ("de",), ("xx",)], [("en",), ("de",), ("fr",), ("fr",)]])
def test_equal_to_the_suite(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "lang string").repartition(3)
    assert sorted(map(str, _both(spark, df, tmp_path).collect())) == sorted(map(str, df.collect()))


def test_nulls_no_checks_and_a_failing_write(spark, tmp_path):
    df = spark.createDataFrame([("en", 1), (None, 2), (None, None)], "lang string, c0_0 int")
    row = QC.checks_while_writing(df, [QC.watch_no_nulls("lang set", "lang")], lambda d: d.write.parquet(str(tmp_path / "a"))).first()
    assert (row["passed"], row["severity"], row["observed"]) == (False, "error", 2)
    assert QC.checks_while_writing(df, [], lambda d: d.write.parquet(str(tmp_path / "b"))).count() == 0
    bad = df.withColumn("lang", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        QC.checks_while_writing(bad, [QC.watch_count("rows", 1)], lambda d: d.write.parquet(str(tmp_path / "c")))


def test_no_scan_of_its_own(spark, tmp_path):
    """Each input row is produced once: the write's tasks count it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).repartition(4).mapInArrow(count, "id long")
    row = QC.checks_while_writing(df, [QC.watch_count("rows", 1000)], lambda d: d.write.parquet(str(tmp_path / "t"))).first()
    assert row["passed"] and row["observed"] == 1000 and seen.value == 1000
