"""Records whose keys depend on their outcome, as VARIANT values: no key is lost to a fixed schema.

A record is parsed once into Spark's binary VARIANT; known keys are read by path with ``try_variant_get``, all keys can be
reported, and writing a record again keeps what no schema names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record VARIANT, malformed) of JSON Lines; a line that isn't JSON is a null record that is marked, blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    record = F.try_parse_json("value")
    return lines.select(record.alias("record"), record.isNull().alias("malformed"))


def write_records(df: DataFrame, path: str, record: str = "record") -> None:
    """JSON Lines with every key of the records; null records are left out."""
    df.where(F.col(record).isNotNull()).select(F.to_json(record).alias("value")).write.mode("overwrite").text(path)


def fields(record: str | Column, wanted: Mapping[str, tuple[str, str]]) -> list[Column]:
    """Columns ``name`` = the value at a path, of a type: NULL where the key is absent or the value doesn't fit."""
    c = F.col(record) if isinstance(record, str) else record
    return [F.try_variant_get(c, path, kind).alias(name) for name, (path, kind) in wanted.items()]


def json_type(value: Column) -> Column:
    """Type family of a variant value: object, array, string, boolean, integer, number or null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("FLOAT", "DOUBLE"), "number")
        .otherwise(F.lower(kind))
    )


def key_report(df: DataFrame, outcome: Column, record: str = "record") -> DataFrame:
    """(outcome, key, type, n): one row per top-level key, its type family and the outcome it occurs with.

    Records that are no objects have no keys.  The report grows with the distinct keys, counted map-side.
    """
    spark = df.sparkSession
    rows = df.select(outcome.alias("outcome"), F.col(record).alias("__record"))
    keys = rows.lateralJoin(spark.tvf.variant_explode(F.col("__record").outer()))
    return keys.where(F.col("key").isNotNull()).groupBy("outcome", "key", json_type(F.col("value")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def merged_schemas(df: DataFrame, outcome: Column, record: str = "record") -> DataFrame:
    """(outcome, schema): the schema that holds every record of an outcome, merged by an aggregate."""
    return df.groupBy(outcome.alias("outcome")).agg(F.schema_of_variant_agg(record).alias("schema"))
