"""File-listing statistics over (ordinal, path, dir, bytes) tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import paths as P
from runlens.operators.ordering import top_k

MB = 1024.0 * 1024.0


def to_mb(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c / F.lit(MB)


def size_stats(df: DataFrame, size: str = "bytes", digits: int = 2) -> DataFrame:
    """count, total, mean, min, max in MB (rounded); empty input gives count 0 and NULLs."""
    mb = to_mb(size)
    return df.agg(
        F.count(F.col(size)).alias("n_files"),
        F.round(F.sum(mb), digits).alias("total_mb"),
        F.round(F.avg(mb), digits).alias("mean_mb"),
        F.round(F.min(mb), digits).alias("min_mb"),
        F.round(F.max(mb), digits).alias("max_mb"),
    )


def listing_rollup(df: DataFrame, dir_col: str = "dir", path: str = "path", size: str = "bytes",
                   suffixes: Sequence[str] = (".html",)) -> DataFrame:
    """Files per directory with per-suffix counts and total bytes."""
    aggs = [F.count(F.lit(1)).alias("n_files"), F.sum(size).cast("long").alias("total_bytes")]
    for s in suffixes:
        aggs.append(F.count_if(F.col(path).endswith(s)).alias("n_" + s.strip(".").replace(".", "_")))
    return df.groupBy(dir_col).agg(*aggs)


def recursive_counts(df: DataFrame, roots: DataFrame, root: str = "root", path: str = "path", suffixes: Sequence[str] = (".html",)) -> DataFrame:
    """Files at any depth below each root, with per-suffix counts; 0 where nothing is.

    Every path counts once for each directory above it (bounded by its depth),
    pre-aggregated per directory before the join with the roots.
    """
    names = {s: "n_" + s.strip(".").replace(".", "_") for s in suffixes}
    parts = F.split(F.col(path), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    each = df.where(F.col(path).contains("/")).select(F.col(path), F.explode(above).alias(root))
    counts = each.groupBy(root).agg(F.count(F.lit(1)).alias("n_files"), *[F.count_if(F.col(path).endswith(s)).alias(n) for s, n in names.items()])
    out = roots.select(root).distinct().join(counts, root, "left")
    return out.select(root, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n_files", *names.values())])


def largest(df: DataFrame, k: int, size: str = "bytes", path: str = "path", order_col: str = "ordinal") -> DataFrame:
    """Top ``k`` files by size (ties by path, then ordinal)."""
    return top_k(df, [F.desc(size), F.asc(path), F.asc(order_col)], k)


def latest_name(pattern: str, fallback: str, path: str = "path") -> Column:
    """Aggregate expression: the lexically greatest matching name, else the fallback."""
    return F.coalesce(F.max(F.when(F.col(path).rlike(pattern), F.col(path))), F.lit(fallback))


def union_listings(parts: Sequence[tuple[DataFrame, str, str]], path: str = "path", size: str = "bytes") -> DataFrame:
    """Union of listings, each path made relative to its own root; ``parts`` = (df, label, root)."""
    out = None
    for df, label, root in parts:
        rel = df.select(F.lit(label).alias("source"), P.relative_to(F.col(path), root).alias("rel_path"), F.col(size).alias("bytes"))
        out = rel if out is None else out.unionByName(rel)
    return out


def leading_digit(df: DataFrame, col: str | Column) -> DataFrame:
    """Rows whose name starts with a digit."""
    c = F.col(col) if isinstance(col, str) else col
    return df.where(c.rlike("^[0-9]"))


def count_suffix(df: DataFrame, col: str, suffix: str, out: str = "n") -> DataFrame:
    return df.agg(F.count_if(F.col(col).endswith(suffix)).alias(out))


def visible(df: DataFrame, name_col: str) -> DataFrame:
    """Entries whose name does not start with '.'."""
    return df.where(~F.col(name_col).startswith("."))
