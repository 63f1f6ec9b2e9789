"""Formatting, unit and time column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_row(fmt: str, *cols: str | Column) -> Column:
    """printf-style fixed-width text (``format_string``).

    Round numbers before formatting when half-way cases matter: Java rounds
    1.005 with ``%.2f`` differently from C printf.
    """
    return F.format_string(fmt, *[_c(c) for c in cols])


def pct(part: str | Column, total: str | Column, digits: int | None = None) -> Column:
    """part / total * 100; NULL when total is 0 (no division error)."""
    v = F.try_divide(_c(part) * F.lit(100.0), _c(total))
    return F.round(v, digits) if digits is not None else v


def elapsed_seconds(start: str | Column, end: str | Column) -> Column:
    """end - start in seconds (microsecond precision) as DOUBLE.

    ``timestamp_diff`` in microseconds is absolute: no session time zone (and no
    daylight-saving shift) enters, for zone-free and zoned timestamps alike.
    """
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(1_000_000.0)


def hours_minutes(seconds: str | Column) -> tuple[Column, Column]:
    """Whole hours and the remaining whole minutes of a duration in seconds."""
    s = F.floor(_c(seconds)).cast("long")
    return F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long")


def run_name(ts: str | Column, prefix: str = "results_") -> Column:
    """A timestamped run name: ``<prefix>YYYYmmdd_HHMMSS``."""
    return F.concat(F.lit(prefix), F.date_format(_c(ts), "yyyyMMdd_HHmmss"))
