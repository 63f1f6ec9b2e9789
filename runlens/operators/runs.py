"""Run-record operators: filters, outcome taxonomies, verdicts, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.fmt import pct


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def successful(df: DataFrame, col: str = "success") -> DataFrame:
    """Keep rows whose flag is true; absent (NULL) counts as false."""
    return df.where(F.coalesce(F.col(col), F.lit(False)))


def verified(df: DataFrame, col: str = "verified") -> DataFrame:
    """Keep rows whose verified flag is true; NULL counts as false."""
    return df.where(F.coalesce(F.col(col), F.lit(False)))


def classify_run(
    has_project: str | Column = "has_project",
    n_jars: str | Column = "n_jars",
    tool_ok: str | Column = "tool_ok",
    tool_error: str | Column = "tool_error",
    n_files: str | Column = "n_files",
    no_tests_label: str = "no_tests_generated",
) -> Column:
    """Outcome of one generation attempt, first match wins.

    no project or no jar -> 'no_jar'; tool failed -> its error text (NULL when it
    exited nonzero without one); no test files -> 'no_tests_generated';
    otherwise 'success'.  The short-run script labels the no-files case
    ``no_tests``: pass ``no_tests_label``.
    """
    no_jar = ~F.coalesce(_c(has_project), F.lit(False)) | (F.coalesce(_c(n_jars), F.lit(0)) <= 0)
    return (
        F.when(no_jar, F.lit("no_jar"))
        .when(~F.coalesce(_c(tool_ok), F.lit(False)), _c(tool_error))
        .when(F.coalesce(_c(n_files), F.lit(0)) <= 0, F.lit(no_tests_label))
        .otherwise(F.lit("success"))
    )


def classify_runs(df: DataFrame, out: str = "outcome", no_tests_label: str = "no_tests_generated") -> DataFrame:
    """Add the outcome and a success flag (success only for the last case)."""
    outcome = classify_run(no_tests_label=no_tests_label)
    ok = (
        F.coalesce(F.col("has_project"), F.lit(False))
        & (F.coalesce(F.col("n_jars"), F.lit(0)) > 0)
        & F.coalesce(F.col("tool_ok"), F.lit(False))
        & (F.coalesce(F.col("n_files"), F.lit(0)) > 0)
    )
    return df.withColumn(out, outcome).withColumn("success", ok)


# Verdict reasons, in the order the checks are made.
REASON_COMPILE = "Compilation failed"
REASON_ORIGINAL_COMPILE = "Original compilation failed"
REASON_PASS = "Preserved (Pass)"
REASON_FAIL = "Preserved (Fail)"
REASON_REGRESSION = "Regression"
REASON_FIX = "Fix (Unexpected)"


def verdict(
    refined_ok: str | Column = "refined_ok",
    original_ok: str | Column = "original_ok",
    orig_passed: str | Column = "orig_passed",
    ref_passed: str | Column = "ref_passed",
) -> tuple[Column, Column]:
    """(valid, reason) of a rewrite against its original, first match wins."""
    r_ok, o_ok, o_pass, r_pass = (F.coalesce(_c(x), F.lit(False)) for x in (refined_ok, original_ok, orig_passed, ref_passed))
    reason = (
        F.when(~r_ok, F.lit(REASON_COMPILE))
        .when(~o_ok, F.lit(REASON_ORIGINAL_COMPILE))
        .when(o_pass & r_pass, F.lit(REASON_PASS))
        .when(~o_pass & ~r_pass, F.lit(REASON_FAIL))
        .when(o_pass & ~r_pass, F.lit(REASON_REGRESSION))
        .otherwise(F.lit(REASON_FIX))
    )
    valid = r_ok & o_ok & (o_pass == r_pass)
    return valid, reason


def with_verdict(df: DataFrame) -> DataFrame:
    """Keep every field and add ``verified`` plus ``oracle_preserved`` (valid) or ``error`` (invalid)."""
    valid, reason = verdict()
    return df.withColumns(
        {
            "verified": valid,
            "oracle_preserved": F.when(valid, F.lit(True)),
            "error": F.when(~valid, reason),
        }
    )


def has_marker(cols: Sequence[str | Column], markers: Sequence[str]) -> Column:
    """True when any marker occurs as a substring of any of the columns."""
    cond = F.lit(False)
    for c in cols:
        for m in markers:
            cond = cond | F.coalesce(_c(c).contains(m), F.lit(False))
    return cond


def has_rows(df: DataFrame) -> bool:
    """Nonempty guard (one-row probe, not a count)."""
    return not df.isEmpty()


def run_summary(df: DataFrame, keys: Sequence[str] = (), success: str = "success") -> DataFrame:
    """total, successes and success percent (NULL on empty input, no division error)."""
    ok = F.coalesce(F.col(success), F.lit(False))
    agg = [
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successes"),
    ]
    g = df.groupBy(*keys).agg(*agg)
    return g.withColumn("percent", pct("successes", "total", 1))


def tally(df: DataFrame, passed: str = "passed") -> DataFrame:
    """passed / total and the overall conjunction (an empty suite passes)."""
    return df.agg(
        F.count_if(F.col(passed)).alias("passed"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.bool_and(F.col(passed)), F.lit(True)).alias("all_passed"),
    )


def estimate_hours(df: DataFrame, seconds_per_row: int = 60) -> DataFrame:
    """rows, and rows x seconds integer-divided into whole hours."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "hours", F.expr(f"(rows * {int(seconds_per_row)}) div 3600")
    )


def ratio_metrics(
    df: DataFrame,
    killed: str = "killed",
    total: str = "total",
    covered: str = "covered",
    missed: str = "missed",
) -> DataFrame:
    """Per-row mutation score and line coverage in percent (NULL when the denominator is 0)."""
    return df.withColumns(
        {
            "mutation_score": F.try_divide(F.col(killed) * 100.0, F.col(total)),
            "line_coverage": F.try_divide(F.col(covered) * 100.0, F.col(covered) + F.col(missed)),
        }
    )


def ratio_totals(df: DataFrame, keys: Sequence[str], killed: str = "killed", total: str = "total") -> DataFrame:
    """Group mutation score as a ratio of sums (not a mean of ratios)."""
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(killed) * 100.0, F.sum(total)).alias("mutation_score"),
        F.count(F.lit(1)).alias("n"),
    )


# Reward weights and failure penalty of the composite score.
REWARD_WEIGHTS = {
    "test_smells": -0.3,
    "cyclomatic_complexity": -0.2,
    "readability": 0.15,
    "branch_coverage": 0.25,
    "mutation_score": 0.25,
    "compilation": 0.15,
}
FAILURE_PENALTY = -1.0


def composite_score(df: DataFrame, metrics: dict[str, str | Column], failed: str | Column = "failed",
                    weights: dict[str, float] | None = None, penalty: float = FAILURE_PENALTY, out: str = "score") -> DataFrame:
    """Weighted sum of metric columns; failed rows get the penalty instead."""
    weights = weights or REWARD_WEIGHTS
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.coalesce(_c(metrics[name]).cast("double"), F.lit(0.0))
    return df.withColumn(out, F.when(F.coalesce(_c(failed), F.lit(False)), F.lit(penalty)).otherwise(total))


def explode_artifacts(df: DataFrame, files: str = "test_files", out: str = "test_file") -> DataFrame:
    """One row per listed file (absent or empty list -> no rows), with list size and first entry."""
    return df.select(
        "*",
        F.size(F.col(files)).alias("num_tests"),
        F.get(F.col(files), 0).alias("first_file"),
        F.explode(F.col(files)).alias(out),
    )
