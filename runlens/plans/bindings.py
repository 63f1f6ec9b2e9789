"""Fixture projections: the reference's domain tables derived from the driver tables.

The reference ships no data, so each domain table (manifest, run records,
listings, verdict flags, training pairs, ...) is a pure projection of the
driver's parquet tables.  Every projection is lazy and column-pruned, so its
work grows with the underlying table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import paths as P


class Tables:
    """Lazy parquet readers for ``<sf_dir>/<name>.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))


def _source_no(col: str = "source") -> Column:
    return F.regexp_extract(F.col(col), r"(\d+)$", 1).try_cast("int")


def _class_of_doc() -> Column:
    doc = F.concat(F.lit("Doc"), F.col("doc_id").cast("string"))
    return F.when(F.col("doc_id") % 10 == 0, doc).otherwise(F.concat_ws(".", F.col("lang"), F.col("source"), doc))


def manifest(t: Tables) -> DataFrame:
    """(ordinal, project, class): one row per requested class."""
    return t.documents.select(F.col("doc_id").alias("ordinal"), F.col("source").alias("project"), _class_of_doc().alias("class"))


def requests(t: Tables) -> DataFrame:
    """(project): distinct requested project names."""
    return t.documents.select(F.col("source").alias("project")).distinct()


def _catalog(t: Tables, lo: int, hi: int, name: str) -> DataFrame:
    return (
        t.documents.select(F.col("source").alias("project"))
        .distinct()
        .where(_source_no("project").between(lo, hi))
        .select(
            "project",
            F.concat(F.lit(f"{name}/"), F.col("project")).alias("root"),
            _source_no("project").alias("ordinal"),
        )
    )


def catalog_a(t: Tables) -> DataFrame:
    """First project catalog: projects numbered 0-9."""
    return _catalog(t, 0, 9, "catalog_a")


def catalog_b(t: Tables) -> DataFrame:
    """Second project catalog: projects numbered 5-14."""
    return _catalog(t, 5, 14, "catalog_b")


def artifacts(t: Tables) -> DataFrame:
    """(ordinal, project, class, path, code): one generated test file per manifest class."""
    d = t.documents.select(
        F.col("doc_id").alias("ordinal"), F.col("source").alias("project"), _class_of_doc().alias("class"), F.col("text").alias("code")
    )
    return d.select(
        "ordinal",
        "project",
        "class",
        P.test_file_path(F.lit("generated/baseline"), F.col("project"), F.col("class")).alias("path"),
        "code",
    )


def listing_artifacts(t: Tables) -> DataFrame:
    """(path): artifact files plus a scaffolding sibling for every third artifact."""
    a = artifacts(t).select("ordinal", "path")
    scaff = a.where(F.col("ordinal") % 3 == 0).select(
        F.regexp_replace(F.col("path"), r"\.java$", "_scaffolding.java").alias("path")
    )
    return a.select("path").unionByName(scaff)


def attempts(t: Tables) -> DataFrame:
    """(ordinal, has_project, n_jars, tool_ok, tool_error, n_files): one generation attempt per event."""
    e = t.events
    return e.select(
        F.col("event_id").alias("ordinal"),
        (F.col("event_id") % 13 != 0).alias("has_project"),
        (F.col("event_id") % 11).cast("int").alias("n_jars"),
        (F.col("event_type") != "error").alias("tool_ok"),
        F.when(F.col("value") > 50, F.lit("timeout")).alias("tool_error"),
        (F.col("event_id") % 4).cast("int").alias("n_files"),
    )


def coverage_line(criterion: Column, value: Column) -> Column:
    return F.concat(F.lit("* Coverage of criterion "), criterion, F.lit(": "), value.cast("string"), F.lit("%"))


def run_logs(t: Tables, chunk_rows: int = 4096) -> DataFrame:
    """(key, segment, stdout): the tool log of each user in bounded segments; coverage lines in event order plus noise.

    A segment holds the lines of ``chunk_rows`` consecutive event ids; ids are
    unique, so no row exceeds that many lines, however hot the user.
    """
    e = t.events.select(
        "user_id", "event_id", coverage_line(F.upper(F.col("event_type")), F.col("value")).alias("line")
    )
    pairs = F.array_sort(F.collect_list(F.struct("event_id", "line")))
    body = e.groupBy("user_id", F.floor(F.col("event_id") / chunk_rows).alias("segment")).agg(F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias("body"))
    return body.select(
        F.col("user_id").alias("key"),
        "segment",
        F.concat(F.lit("noise: 3\n"), F.col("body"), F.lit("\nCoverage of criterion BAD: n/a")).alias("stdout"),
    )


def _k_of_props() -> Column:
    return F.get_json_object(F.col("props"), "$.k").try_cast("double")


def baseline_runs(t: Tables) -> DataFrame:
    """(ordinal, project, class, success, cov, mut, test_files): baseline generation records."""
    cls = F.col("user_id").cast("string")
    return t.events.select(
        F.col("event_id").alias("ordinal"),
        F.concat(F.lit("proj"), (F.col("user_id") % 7).cast("string")).alias("project"),
        cls.alias("class"),
        (F.col("event_type") == "click").alias("success"),
        F.col("value").alias("cov"),
        _k_of_props().alias("mut"),
        F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(cls, F.lit("/"), F.col("event_id").cast("string"), F.lit(".java")))
        ).alias("test_files"),
    )


def outcome_records(t: Tables) -> DataFrame:
    """(value): one JSON record per event whose keys depend on its outcome; purchases carry a key that no schema lists."""
    kind = F.col("event_type")
    ok = kind == "click"
    n = (F.col("event_id") % 4).cast("int")
    name = F.col("user_id").cast("string")
    files = F.transform(F.sequence(F.lit(0), n), lambda i: F.concat(name, F.lit("/"), i.cast("string"), F.lit(".java")))
    record = F.struct(
        F.col("event_id").alias("id"), name.alias("class"), ok.alias("success"), F.when(ok, n + 1).alias("num_tests"), F.when(ok, files).alias("test_files"),
        F.when(ok, F.col("value")).alias("time"), F.when(ok, F.struct(F.col("value").alias("LINE"))).alias("coverage"), F.when(~ok, kind).alias("error"),
        F.when(kind == "purchase", F.struct(n.alias("attempt"), F.col("value").alias("cost"))).alias("retry"),
    )
    return t.events.select(F.to_json(record).alias("value"))


def valid_runs(t: Tables) -> DataFrame:
    """(ordinal, class, verified, cov, mut): verified rewrites with their metrics."""
    e = t.events.where(F.col("event_type") == "purchase")
    return e.select(
        F.col("event_id").alias("ordinal"),
        F.col("user_id").cast("string").alias("class"),
        (F.col("value") >= 10).alias("verified"),
        F.col("value").alias("cov"),
        _k_of_props().alias("mut"),
    )


def verdicts(t: Tables) -> DataFrame:
    """(doc_id, refined_ok, original_ok, orig_passed, ref_passed): compile/run flags per rewrite."""
    return t.labels.select(
        "doc_id",
        (F.col("doc_id") % 7 != 0).alias("refined_ok"),
        (F.col("doc_id") % 11 != 0).alias("original_ok"),
        (F.col("quality") == 1).alias("orig_passed"),
        (F.col("toxic") == 0).alias("ref_passed"),
    )


def listing(t: Tables) -> DataFrame:
    """(ordinal, path, dir, bytes): a file listing from the pages table."""
    p = t.pages
    path = F.regexp_replace(F.regexp_replace(F.col("url"), r"^[a-z]+://", ""), r"[?#].*$", "")
    return p.select(F.col("page_id").alias("ordinal"), path.alias("path"), F.octet_length("html").cast("long").alias("bytes")).select(
        "ordinal", "path", P.parent_dir(F.col("path")).alias("dir"), "bytes"
    )


def listing_docs(t: Tables) -> DataFrame:
    """(ordinal, project, path, bytes): jar files of a project, every fourth at its top, the others under lib."""
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".jar"))
    folder = F.when(F.col("doc_id") % 4 == 0, F.col("source")).otherwise(F.concat(F.col("source"), F.lit("/lib")))
    return t.documents.select(
        F.col("doc_id").alias("ordinal"),
        F.col("source").alias("project"),
        F.concat_ws("/", folder, name).alias("path"),
        F.col("n_chars").alias("bytes"),
    )


def some_jars(t: Tables) -> DataFrame:
    """``listing_docs`` of the projects numbered below 15: the others show the zero and drop cases."""
    return listing_docs(t).where(_source_no("project") < 15)


def members(t: Tables) -> DataFrame:
    """(project, archive, member): archive member paths.

    A class is in the library archive ``lib/z.jar`` of its project unless its
    number is a multiple of 3; every fifth also at the top, in ``z.jar``; and a
    class without a package is also in the archive of project src0.
    """
    m = manifest(t).select("ordinal", "project", P.name_to_member("class").alias("member"))
    own = m.where(F.col("ordinal") % 3 != 0)
    rows = own.select("project", F.concat(F.col("project"), F.lit("/lib/z.jar")).alias("archive"), "member")
    top = own.where(F.col("ordinal") % 5 == 0).select("project", F.concat(F.col("project"), F.lit("/z.jar")).alias("archive"), "member")
    other = m.where(F.col("ordinal") % 10 == 0).select(F.lit("src0").alias("project"), F.lit("src0/lib/a.jar").alias("archive"), "member")
    return rows.unionByName(top).unionByName(other)


def requests_member(t: Tables) -> DataFrame:
    """(ordinal, project, class): every manifest class, looked up in its project's archives."""
    return manifest(t)


def name_requests(t: Tables) -> DataFrame:
    """(o_custkey, fragment): what each ordering customer is asked for by: most of its number, two digits of it, or none."""
    key = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    fragment = (
        F.when(F.col("o_custkey") % 10 == 0, F.concat(F.lit("x"), key))
        .when(F.col("o_custkey") % 10 == 1, F.substring(key, 8, 2))
        .otherwise(F.concat(F.lit("MER#"), F.substring(key, 1, 8)))
    )
    return t.orders.select("o_custkey").distinct().select("o_custkey", fragment.alias("fragment"))


def replies(t: Tables) -> DataFrame:
    """(doc_id, reply): model replies; odd ids wrap code in prose and fences."""
    d = t.documents
    wrapped = F.concat_ws("\n", F.lit("Here is the code:"), F.lit("```java"), F.lit("import x;"), F.col("text"), F.lit("```"), F.lit("Done"))
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 1, wrapped).otherwise(F.col("text")).alias("reply"))


def sft_pairs(t: Tables) -> DataFrame:
    """(conv_id, turn, source, target): each user turn with the assistant turn that follows it."""
    c = t.conversations
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("source"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target")
    )
    return u.join(a, ["conv_id", "turn"], "inner").select("conv_id", "turn", "source", "target")


def eval_counts(t: Tables) -> DataFrame:
    """(orderkey, linenumber, killed, total, covered, missed, failed, smells, complexity, readability)."""
    li = t.lineitem
    return li.select(
        F.col("l_orderkey").alias("orderkey"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_quantity").alias("killed"),
        F.lit(50).cast("int").alias("total"),
        F.col("l_linenumber").alias("covered"),
        (7 - F.col("l_linenumber")).alias("missed"),
        (F.col("l_returnflag") == "R").alias("failed"),
        (F.col("l_tax") * 100).alias("smells"),
        F.col("l_linenumber").cast("double").alias("complexity"),
        (1 - F.col("l_discount")).alias("readability"),
    )


def entries(t: Tables) -> DataFrame:
    """(ordinal, name): directory entries; every seventh name is hidden (leading '.')."""
    base = listing(t).select("ordinal", P.last_segment(F.col("path"), "/").alias("leaf"))
    return base.select(
        "ordinal",
        F.when(F.col("ordinal") % 7 == 0, F.concat(F.lit("."), F.col("leaf"))).otherwise(F.col("leaf")).alias("name"),
    )
