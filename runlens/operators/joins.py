"""Lookups and reference joins: priority catalogs, anti/semi joins, containment, fuzzy names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions.paths import depth
from runlens.functions.text import contains_ci


def _first_per_key(df: DataFrame, key: str, order_col: str, cols: Sequence[str]) -> DataFrame:
    """First row per key by ``order_col`` (duplicate catalog keys: first wins)."""
    return df.groupBy(key).agg(*[F.min_by(F.col(c), F.col(order_col)).alias(c) for c in cols])


def lookup_priority(
    req: DataFrame,
    catalogs: Sequence[tuple[str, DataFrame]],
    key: str,
    value_cols: Sequence[str],
    order_col: str = "ordinal",
    tag: str = "dataset",
) -> DataFrame:
    """Find each key in catalog 1, else catalog 2, ...; NULL when absent; ``tag`` names the match.

    Each catalog is de-duplicated by a partial aggregate, then left equi-joined;
    ``coalesce`` in catalog order picks the first hit.
    """
    out = req
    hits = []
    for i, (name, cat) in enumerate(catalogs):
        dedup = _first_per_key(cat, key, order_col, value_cols).select(
            key, F.lit(True).alias(f"__hit{i}"), *[F.col(c).alias(f"__{c}{i}") for c in value_cols]
        )
        out = out.join(dedup, key, "left")
        hits.append((name, i))
    tag_col = None
    for name, i in reversed(hits):
        tag_col = F.when(F.col(f"__hit{i}"), F.lit(name)).otherwise(tag_col if tag_col is not None else F.lit(None).cast("string"))
    sel = [F.col(c) for c in req.columns]
    for c in value_cols:
        sel.append(F.coalesce(*[F.when(F.col(f"__hit{i}"), F.col(f"__{c}{i}")) for _, i in hits]).alias(c))
    sel.append(tag_col.alias(tag))
    return out.select(*sel)


def missing_refs(df: DataFrame, ref: DataFrame, key: str, ref_key: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key does not exist in ``ref`` (left anti join).

    Reference keys are de-duplicated first (map-side combine), so a hot,
    repeated reference key is never buffered whole by the join.
    """
    rk = ref_key or key
    r = ref.select(F.col(rk).alias(key)).distinct()
    # distinct probe keys find the dangling ones; a hot key's rows then meet one row per key
    dangling = df.select(key).distinct().join(r, key, "left_anti").select(F.col(key).alias("__k"))
    return df.join(dangling, F.col(key).eqNullSafe(F.col("__k")), "left_semi")


def presence_report(df: DataFrame, ref: DataFrame, key: str, out: str = "present") -> DataFrame:
    """Every key of ``df`` with a flag telling whether ``ref`` holds it."""
    r = ref.select(key).distinct().withColumn("__p", F.lit(True))
    return df.join(r, key, "left").withColumn(out, F.coalesce(F.col("__p"), F.lit(False))).drop("__p")


def find_container(
    req: DataFrame,
    members: DataFrame,
    req_member: str = "member",
    member: str = "member",
    archive: str = "archive",
    keys: Sequence[str] = (),
) -> DataFrame:
    """First archive holding each requested member path, among those of the same ``keys``; NULL when none.

    Archives at the top of a tree come before nested ones, then by path.  Exact
    member equality (an equi-join that scales); members are first reduced to
    one row per key and path by a partial aggregate.
    """
    order = F.struct(depth(archive).alias("depth"), F.col(archive).alias("archive"))
    first = members.groupBy(*keys, F.col(member).alias(req_member)).agg(F.min(order).alias("__first"))
    return req.join(first, [*keys, req_member], "left").withColumn(archive, F.col("__first.archive")).drop("__first")


def fuzzy_match(
    names: DataFrame,
    patterns: Sequence[str],
    name_col: str,
    order_col: str,
    out: str = "match",
) -> DataFrame:
    """For each requested pattern, the first name (by order) that contains it, case-insensitively.

    A theta join: the literal pattern list is the bounded side and is broadcast;
    the name table is scanned once (BroadcastNestedLoopJoin, linear in names).
    Patterns with no match are kept with NULL.
    """
    spark = names.sparkSession
    req = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "req_pos INT, pattern STRING")
    b = F.broadcast(req)
    cand = names.select(F.col(name_col).alias("__name"), F.col(order_col).alias("__ord"))
    hits = cand.join(b, contains_ci(F.col("__name"), F.col("pattern")), "inner")
    best = hits.groupBy("req_pos").agg(
        F.min_by(F.col("__name"), F.col("__ord")).alias(out),
        F.count(F.lit(1)).alias("n_candidates"),
    )
    return req.join(best, "req_pos", "left").withColumn("n_candidates", F.coalesce(F.col("n_candidates"), F.lit(0)).cast("long"))


def exact_or_contains(names: DataFrame, patterns: Sequence[str], name_col: str, order_col: str, out: str = "match") -> DataFrame:
    """For each requested name, the exact entry; else the first one that contains it, case-insensitively; else NULL.

    One scan of the name table against the broadcast literal list; an exact
    hit sorts before every containing one.
    """
    spark = names.sparkSession
    req = spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "req_pos INT, pattern STRING")
    cand = names.select(F.col(name_col).alias("__name"), F.col(order_col).alias("__ord"))
    hits = cand.join(F.broadcast(req), contains_ci(F.col("__name"), F.col("pattern")), "inner")
    exact = F.col("__name") == F.col("pattern")
    best = hits.groupBy("req_pos").agg(F.min(F.struct((~exact).alias("loose"), F.col("__ord").alias("o"), F.col("__name").alias("name"))).alias("b"))
    return req.join(best, "req_pos", "left").select("req_pos", "pattern", F.col("b.name").alias(out), (~F.col("b.loose")).alias("exact"))


def resolve_inputs(
    df: DataFrame,
    catalog: DataFrame,
    jars: DataFrame,
    key: str = "project",
    jar_path: str = "path",
    catalog_cols: Sequence[str] = ("root",),
) -> DataFrame:
    """Drop rows whose key is missing from the catalog or has no jar; attach the first jar.

    The jar table is reduced to one row per key before the join: top-level jars
    come before those in a library folder, then by path.
    """
    order = F.struct(depth(jar_path).alias("depth"), F.col(jar_path).alias("path"))
    first_jar = jars.groupBy(key).agg(F.min(order).alias("__first")).select(key, F.col("__first.path").alias("first_jar"))
    # one catalog row per key (deterministic pick), so the join never multiplies rows
    cat = catalog.groupBy(key).agg(*[F.min(c).alias(c) for c in catalog_cols])
    return df.join(cat, key, "inner").join(first_jar, key, "inner")


def companions(files: DataFrame, listing: DataFrame, path: str = "path", suffix: str = "_scaffolding.java",
               out: str = "companion") -> DataFrame:
    """(dir, companion): files ending with ``suffix`` in every directory that holds one of ``files``.

    This is what gets copied next to each rewritten file.  It is a semi-join
    against the distinct directories of ``files`` (de-duplicated map-side), so
    the output is linear in the listing: a directory with many rewritten files
    never multiplies its companions (no all-pairs within a directory).
    """
    from runlens.functions.paths import parent_dir

    dirs = files.select(parent_dir(F.col(path)).alias("dir")).distinct()
    side = listing.where(F.col(path).endswith(suffix)).select(parent_dir(F.col(path)).alias("dir"), F.col(path).alias(out))
    return side.join(dirs, "dir", "left_semi")
