"""Coverage-log parsing and coverage-map access.

A tool log holds lines such as ``* Coverage of criterion LINE: 87%`` among
noise.  Parsing is a narrow per-row ``posexplode`` + string expressions; the
later-line-wins rule is a ``max_by`` aggregate on the line position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import lines, rtrim_chars, trim_ws

# The marker a coverage line must contain and the word before the name.
COVERAGE_MARKER = "Coverage of criterion"
CRITERION_WORD = "criterion"

# A plain decimal number: what Python float() accepts minus nan/inf/underscores.
NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def coverage_name(line: Column) -> Column:
    """Criterion name: text after the last 'criterion' in the part before the first ':'."""
    head = F.split_part(line, F.lit(":"), F.lit(1))
    return trim_ws(F.split_part(head, F.lit(CRITERION_WORD), F.lit(-1)))


def coverage_value(line: Column) -> Column:
    """Second ':'-part, trimmed, trailing '%' removed, as DOUBLE; NULL when not a number."""
    txt = trim_ws(rtrim_chars(trim_ws(F.split_part(line, F.lit(":"), F.lit(2))), "%"))
    return F.when(txt.rlike(NUMBER_RE), txt.cast("double"))


def is_coverage_line(line: Column) -> Column:
    return line.contains(COVERAGE_MARKER) & line.contains(":")


def parse_coverage(df: DataFrame, text_col: str, keys: Sequence[str], segment: str | None = None) -> DataFrame:
    """(keys..., criterion, value) from log text; bad values skipped, later duplicate wins.

    A long log comes as several rows per key, ordered by the number in ``segment``.
    """
    part = F.col(segment).cast("long") if segment else F.lit(0).cast("long")
    at = F.posexplode(lines(text_col)).alias("__pos", "__line")
    exploded = df.select(*keys, part.alias("__seg"), at).withColumn("__ln", F.struct("__seg", "__pos"))
    parsed = (
        exploded.where(is_coverage_line(F.col("__line")))
        .select(*keys, "__ln", coverage_name(F.col("__line")).alias("criterion"), coverage_value(F.col("__line")).alias("value"))
        .where(F.col("value").isNotNull())
    )
    return parsed.groupBy(*keys, "criterion").agg(F.max_by("value", "__ln").alias("value"))


def coverage_map(long_df: DataFrame, keys: Sequence[str], name: str = "criterion", value: str = "value",
                 out: str = "coverage") -> DataFrame:
    """Per key a ``MAP<criterion, value>`` from de-duplicated long form (one entry per criterion)."""
    return long_df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(name), F.col(value)))).alias(out))


def map_get(map_col: str | Column, key: str, default: float | None = 0.0) -> Column:
    """``m.get(key, default)``: NULL map or missing key -> default (``try_element_at`` never raises)."""
    m = F.col(map_col) if isinstance(map_col, str) else map_col
    v = F.try_element_at(m, F.lit(key))
    return v if default is None else F.coalesce(v, F.lit(default))
