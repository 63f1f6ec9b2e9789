"""Registered queries: each callable takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables through the fixture projections in
``bindings`` and applies one or a few library operators over whole tables.
Computed columns are aliased to the names used by the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions import chat as CH
from runlens.functions import coverage as CV
from runlens.functions import fmt as FMT
from runlens.functions import paths as P
from runlens.functions import text as TX
from runlens.operators import checks as QC
from runlens.operators import frequent as FQ
from runlens.operators import generate as GEN
from runlens.operators import groups as G
from runlens.operators import joins as J
from runlens.operators import listing as L
from runlens.operators import markers as MK
from runlens.operators import ordering as O
from runlens.operators import ranks as RK
from runlens.operators import runs as R
from runlens.operators import stats as S
from runlens.operators import substring as SUB
from runlens.operators import summaries as SM
from runlens.plans import bindings as B
from runlens.session import materialize, scratch_path
from runlens.sources import accepted as AC
from runlens.sources import files as SRC
from runlens.sources import sinks as SNK
from runlens.sources import variants as VAR
from runlens.streaming import incremental as INC
from runlens.streaming import running as RUN

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


def _t(spark: SparkSession, sf_dir: str) -> B.Tables:
    return B.Tables(spark, sf_dir)


PAIRED_COLS = ["baseline_cov", "valid_cov", "baseline_mut", "valid_mut"]


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir)
    return S.pair_runs(B.baseline_runs(t), B.valid_runs(t))


# ---------------------------------------------------------------- pairing / stats


@query("paired_metrics")
def q_paired_metrics(spark, sf_dir):
    """Last successful baseline per class joined to each verified row."""
    return paired(spark, sf_dir)


@query("describe_numeric")
def q_describe_numeric(spark, sf_dir):
    """A8 (K3 in tests): count, mean, std, min, quartiles, max of the paired metrics."""
    return S.describe_numeric(paired(spark, sf_dir), PAIRED_COLS)


# ---------------------------------------------------------------- manifest / listing statistics


@query("group_lists")
def q_group_lists(spark, sf_dir):
    """A1: classes per project in input order, as long form."""
    return G.group_lists(B.manifest(_t(spark, sf_dir)), "project", "class", "ordinal")


@query("overview_totals")
def q_overview_totals(spark, sf_dir):
    """A2: number of projects and classes."""
    return G.overview(B.manifest(_t(spark, sf_dir)), "project")


@query("group_size_stats")
def q_group_size_stats(spark, sf_dir):
    """A3: min / max / mean classes per project."""
    return G.group_size_stats(B.manifest(_t(spark, sf_dir)), "project")


@query("top_segments")
def q_top_segments(spark, sf_dir):
    """A4 + T2: ten most common leading name segments, ties by first appearance."""
    m = B.manifest(_t(spark, sf_dir))
    return G.most_common(m, G.leading_segment("class"), 10, "ordinal", name="segment")


@query("size_stats")
def q_size_stats(spark, sf_dir):
    """A5 + F16: listing size statistics in MB."""
    return L.size_stats(B.listing(_t(spark, sf_dir)))


@query("listing_rollup")
def q_listing_rollup(spark, sf_dir):
    """Files, bytes and .html files per directory."""
    return L.listing_rollup(B.listing(_t(spark, sf_dir)))


@query("project_counts")
def q_project_counts(spark, sf_dir):
    """Classes and jars per project (0 when no jar directory)."""
    t = _t(spark, sf_dir)
    return G.group_with_counts(B.manifest(t), B.some_jars(t), "project", "n_classes", "n_jars")


@query("groups_by_size")
def q_groups_by_size(spark, sf_dir):
    """Projects by class count, ties in first-seen order, with rank."""
    return G.groups_by_size(B.manifest(_t(spark, sf_dir)), "project", "ordinal")


@query("largest_files")
def q_largest_files(spark, sf_dir):
    """Ten largest files."""
    return L.largest(B.listing(_t(spark, sf_dir)), 10)


@query("head_groups")
def q_head_groups(spark, sf_dir):
    """T4: first five projects by name plus how many remain."""
    return G.head_groups(B.manifest(_t(spark, sf_dir)), "project", 5)


@query("limit_input")
def q_limit_input(spark, sf_dir):
    """T5: first 25 manifest rows."""
    return G.limit_input(B.manifest(_t(spark, sf_dir)), 25, "ordinal")


@query("limit_large")
def q_limit_large(spark, sf_dir):
    """T5: first 50,000 line items by ship date, order and line, by selection."""
    li = _t(spark, sf_dir).lineitem.select("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    return G.limit_input(li, 50_000, ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("frequent_words")
def q_frequent_words(spark, sf_dir):
    """The 50 most frequent words of all texts, exact counts behind Misra-Gries summaries."""
    words = _t(spark, sf_dir).documents.select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    return FQ.most_frequent(words, "word", 50)


@query("frequent_parts")
def q_frequent_parts(spark, sf_dir):
    """The 20 most ordered parts, a column without a hot value."""
    return FQ.most_frequent(_t(spark, sf_dir).lineitem, "l_partkey", 20)


@query("latest_name")
def q_latest_name(spark, sf_dir):
    """Greatest matching file name, else a fallback."""
    lst = B.listing(_t(spark, sf_dir))
    return lst.agg(
        L.latest_name(r"/en/[0-9]+\.html$", "none").alias("latest"),
        L.latest_name(r"zz-[0-9.]+\.jar$", "none").alias("latest_missing"),
    )


@query("row_at")
def q_row_at(spark, sf_dir):
    """The training pair at position 5."""
    return G.row_at(B.sft_pairs(_t(spark, sf_dir)), ["conv_id", "turn"], 5)


@query("union_listings")
def q_union_listings(spark, sf_dir):
    """Two listings with paths relative to their roots."""
    t = _t(spark, sf_dir)
    pages = B.listing(t).select(F.concat(F.lit("data/pages/"), F.col("path")).alias("path"), "bytes")
    jars = B.listing_docs(t).select(F.concat(F.lit("data/jars/"), F.col("path")).alias("path"), "bytes")
    return L.union_listings([(pages, "pages", "data/pages"), (jars, "jars", "data/jars")])


@query("distinct_projects")
def q_distinct_projects(spark, sf_dir):
    """Distinct projects."""
    return G.distinct_keys(B.manifest(_t(spark, sf_dir)), "project")


@query("first_k_per_group")
def q_first_k_per_group(spark, sf_dir):
    """First three classes per project."""
    return O.first_k(B.manifest(_t(spark, sf_dir)), ["project"], ["ordinal"], 3)


@query("latest_per_key")
def q_latest_per_key(spark, sf_dir):
    """Latest run record per class."""
    b = B.baseline_runs(_t(spark, sf_dir)).drop("test_files")
    return O.latest(b, ["class"], "ordinal")


@query("position_in_group")
def q_position_in_group(spark, sf_dir):
    """[i/n] position of each class inside its project."""
    return G.with_position(B.manifest(_t(spark, sf_dir)), "project", "ordinal")


@query("leading_digit")
def q_leading_digit(spark, sf_dir):
    """Entries whose name starts with a digit."""
    return L.leading_digit(B.entries(_t(spark, sf_dir)), "name")


@query("suffix_count")
def q_suffix_count(spark, sf_dir):
    """Count of .html files."""
    return L.count_suffix(B.listing(_t(spark, sf_dir)), "path", ".html", out="n_html")


@query("visible_entries")
def q_visible_entries(spark, sf_dir):
    """Entries not starting with '.', ranked by name."""
    v = L.visible(B.entries(_t(spark, sf_dir)), "name")
    return O.positions(v, ["name", "ordinal"], out="name_rank")


@query("format_rows")
def q_format_rows(spark, sf_dir):
    """fixed-width report line per project."""
    m = B.manifest(_t(spark, sf_dir))
    counts = m.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("project", FMT.format_row("%-25s - %3d classes", "project", "n").alias("line"))


@query("sample_groups")
def q_sample_groups(spark, sf_dir):
    """First three classes of listed projects, in list order."""
    return G.sample_groups(B.manifest(_t(spark, sf_dir)), ["src3", "src1", "none", "src12"], "project", "ordinal", 3)


# ---------------------------------------------------------------- run records


@query("successful_runs")
def q_successful_runs(spark, sf_dir):
    """Successful baseline runs."""
    return R.successful(B.baseline_runs(_t(spark, sf_dir))).select("ordinal", "class", "cov")


@query("verified_runs")
def q_verified_runs(spark, sf_dir):
    """Verified rewrites."""
    v = R.with_verdict(B.verdicts(_t(spark, sf_dir)))
    return R.verified(v).select("doc_id")


@query("run_outcome")
def q_run_outcome(spark, sf_dir):
    """Outcome taxonomy of generation attempts."""
    return R.classify_runs(B.attempts(_t(spark, sf_dir))).select("ordinal", "outcome", "success")


@query("verdict")
def q_verdict(spark, sf_dir):
    """Validity and reason of each rewrite."""
    valid, reason = R.verdict()
    return B.verdicts(_t(spark, sf_dir)).select("doc_id", valid.alias("valid"), reason.alias("reason"))


@query("verified_records")
def q_verified_records(spark, sf_dir):
    """P5 + M4: records extended with verified / oracle_preserved / error."""
    return R.with_verdict(B.verdicts(_t(spark, sf_dir)))


@query("parse_coverage")
def q_parse_coverage(spark, sf_dir):
    """coverage criteria parsed from tool logs, later line wins."""
    return CV.parse_coverage(B.run_logs(_t(spark, sf_dir)), "stdout", ["key"], "segment")


@query("coverage_lookup")
def q_coverage_lookup(spark, sf_dir):
    """P6 + M3: coverage map per log and lookups with default 0."""
    long = CV.parse_coverage(B.run_logs(_t(spark, sf_dir)), "stdout", ["key"], "segment")
    maps = CV.coverage_map(long, ["key"])
    return maps.select(
        "key",
        CV.map_get("coverage", "CLICK", 0.0).alias("click_cov"),
        CV.map_get("coverage", "Line", 0.0).alias("line_cov"),
        F.size("coverage").alias("n_criteria"),
    )


@query("marker_flag")
def q_marker_flag(spark, sf_dir):
    """P10: success-marker test over log text."""
    logs = B.run_logs(_t(spark, sf_dir))
    return logs.groupBy("key").agg(F.max(R.has_marker(["stdout"], ["criterion PURCHASE:", "criterion ERROR:"])).alias("flagged"))


@query("run_summary")
def q_run_summary(spark, sf_dir):
    """Total, successes and percent per project."""
    return R.run_summary(B.baseline_runs(_t(spark, sf_dir)), ["project"])


@query("estimate_hours")
def q_estimate_hours(spark, sf_dir):
    """Rows x 60 s in whole hours."""
    return R.estimate_hours(_t(spark, sf_dir).lineitem, 60)


@query("ratio_metrics")
def q_ratio_metrics(spark, sf_dir):
    """Mutation score and line coverage per row."""
    e = R.ratio_metrics(B.eval_counts(_t(spark, sf_dir)))
    return e.select(
        "orderkey", "linenumber",
        F.round("mutation_score", 6).alias("mutation_score"),
        F.round("line_coverage", 6).alias("line_coverage"),
    )


@query("ratio_totals")
def q_ratio_totals(spark, sf_dir):
    """Mutation score as a ratio of sums per group."""
    e = R.ratio_totals(B.eval_counts(_t(spark, sf_dir)), ["failed"])
    return e.select("failed", F.round("mutation_score", 6).alias("mutation_score"), "n")


@query("composite_score")
def q_composite_score(spark, sf_dir):
    """Weighted reward with failure penalty."""
    e = R.ratio_metrics(B.eval_counts(_t(spark, sf_dir)))
    metrics = {
        "test_smells": "smells",
        "cyclomatic_complexity": "complexity",
        "readability": "readability",
        "branch_coverage": F.col("line_coverage") / 100.0,
        "mutation_score": F.col("mutation_score") / 100.0,
        "compilation": F.lit(1.0),
    }
    s = R.composite_score(e, metrics, "failed")
    return s.select("orderkey", "linenumber", F.round("score", 6).alias("score"))


@query("priority_lookup")
def q_priority_lookup(spark, sf_dir):
    """Project found in catalog a, else b, else NULL."""
    t = _t(spark, sf_dir)
    return J.lookup_priority(B.requests(t), [("a", B.catalog_a(t)), ("b", B.catalog_b(t))], "project", ["root"])


@query("missing_refs")
def q_missing_refs(spark, sf_dir):
    """Requested projects missing from the catalog."""
    t = _t(spark, sf_dir)
    return J.missing_refs(B.requests(t), B.catalog_a(t), "project")


@query("presence_report")
def q_presence_report(spark, sf_dir):
    """J2 + Q4: presence flag per requested project."""
    t = _t(spark, sf_dir)
    return J.presence_report(B.requests(t), B.catalog_a(t), "project")


@query("resolve_or_drop")
def q_resolve_or_drop(spark, sf_dir):
    """Manifest rows whose project exists and has a jar, with its first jar."""
    t = _t(spark, sf_dir)
    return J.resolve_inputs(B.manifest(t), B.catalog_a(t), B.some_jars(t))


@query("name_paths")
def q_name_paths(spark, sf_dir):
    """Directory, member, test name, segments and output directory of each class."""
    m = B.manifest(_t(spark, sf_dir))
    return m.select(
        "ordinal",
        P.name_to_dir("class").alias("dir_name"),
        P.name_to_member("class").alias("member_path"),
        P.test_name("class").alias("test_name"),
        P.first_segment("class").alias("first_segment"),
        P.last_segment("class").alias("last_segment"),
        P.artifact_path(F.lit("generated/baseline"), "project", "class").alias("output_dir"),
    )


@query("accepted_paths")
def q_accepted_paths(spark, sf_dir):
    """K4 + F9: validated output paths of verified rewrites."""
    t = _t(spark, sf_dir)
    ok = R.verified(R.with_verdict(B.verdicts(t))).select(F.col("doc_id").alias("ordinal")).distinct()
    a = B.artifacts(t).select("ordinal", "project", "path").join(ok, "ordinal", "left_semi")
    refined = P.rebase(F.col("path"), "generated/baseline", "generated/refined")
    return a.select("ordinal", "project", P.rebase(refined, "generated/refined", "generated/validated").alias("accepted_path"))


@query("keys_from_path")
def q_keys_from_path(spark, sf_dir):
    """project and class stem from artifact paths."""
    a = B.artifacts(_t(spark, sf_dir))
    project, stem = P.keys_from_path(F.col("path"), "generated/baseline")
    return a.select("ordinal", project.alias("project"), stem.alias("class_stem"))


@query("joined_paths")
def q_joined_paths(spark, sf_dir):
    """':'-joined jar paths per project, top-level jars first, in chunks of 64 paths."""
    jars = B.listing_docs(_t(spark, sf_dir))
    return O.concat_chunks(jars, ["project"], [P.depth("path"), F.col("path")], "path", ":", "classpath", chunk_rows=64)


@query("explode_artifacts")
def q_explode_artifacts(spark, sf_dir):
    """M1 + M2: one row per test file with list size and first entry."""
    b = R.successful(B.baseline_runs(_t(spark, sf_dir)))
    return R.explode_artifacts(b).select("ordinal", "class", "test_file", "num_tests", "first_file")


@query("json_roundtrip")
def q_json_roundtrip(spark, sf_dir):
    """M5: JSON decode of props and re-encode."""
    e = _t(spark, sf_dir).events.select("event_id", F.from_json("props", "k INT").alias("p"))
    return e.select(
        "event_id",
        F.col("p.k").alias("k"),
        F.to_json(F.struct(F.col("event_id"), F.col("p.k").alias("k"))).alias("json"),
    )


@query("run_name")
def q_run_name(spark, sf_dir):
    """K5: timestamped run names."""
    return _t(spark, sf_dir).events.select("event_id", FMT.run_name("ts").alias("run_name"))


RUN_SCHEMA = "ordinal BIGINT, project STRING, class STRING, success BOOLEAN, cov DOUBLE, mut DOUBLE, test_files ARRAY<STRING>"


@query("runs_json_scan")
def q_runs_json_scan(spark, sf_dir):
    """S3 + K1: run records written as JSON and read back with a fixed schema."""
    path = scratch_path(spark, "baseline_runs_json")
    SNK.write_records(B.baseline_runs(_t(spark, sf_dir)), path, "json")
    back = SRC.read_runs(spark, path, RUN_SCHEMA)
    return back.select(
        "ordinal", "project", "class", "success", "cov", "mut",
        F.array_join("test_files", ",").alias("test_files"),
    )


def _outcome_records(spark, sf_dir):
    path = scratch_path(spark, "outcome_records")
    B.outcome_records(_t(spark, sf_dir)).write.text(path)
    return VAR.read_records(spark, path)


@query("record_keys")
def q_record_keys(spark, sf_dir):
    """S3 + M5: which keys, of which type, records of each outcome have."""
    records = _outcome_records(spark, sf_dir)
    return VAR.key_report(records, F.coalesce(F.try_variant_get("record", "$.error", "string"), F.lit("success")))


# The paths and types that the query reads out of a record.
RECORD_FIELDS = {
    "id": ("$.id", "bigint"), "success": ("$.success", "boolean"), "error": ("$.error", "string"), "num_tests": ("$.num_tests", "int"),
    "last_file": ("$.test_files[3]", "string"), "line_cov": ("$.coverage.LINE", "double"), "attempt": ("$.retry.attempt", "int"),
}


@query("variant_records")
def q_variant_records(spark, sf_dir):
    """S3 + M5: records written again and read back with every key, also those that no schema lists."""
    path = scratch_path(spark, "records_again")
    VAR.write_records(_outcome_records(spark, sf_dir), path)
    back = VAR.read_records(spark, path)
    n_keys = F.size(F.json_object_keys(F.to_json("record")))
    return back.select(*VAR.fields("record", RECORD_FIELDS), n_keys.alias("n_keys"))


# ---------------------------------------------------------------- text, containment, chat


@query("clean_code")
def q_clean_code(spark, sf_dir):
    """code kept from model replies."""
    return B.replies(_t(spark, sf_dir)).select("doc_id", TX.clean_code("reply").alias("cleaned"))


@query("build_prompt")
def q_build_prompt(spark, sf_dir):
    """refinement prompt per document."""
    return _t(spark, sf_dir).documents.select("doc_id", TX.build_prompt("text").alias("prompt"))


@query("truncate_text")
def q_truncate_text(spark, sf_dir):
    """head (with marker) and tail of each text."""
    d = _t(spark, sf_dir).documents
    return d.select("doc_id", TX.head_chars("text", 500).alias("head"), TX.tail_chars("text", 200).alias("tail"))


@query("first_line")
def q_first_line(spark, sf_dir):
    """first line of each text."""
    return _t(spark, sf_dir).documents.select("doc_id", TX.first_line("text").alias("first_line"))


@query("duration_parts")
def q_duration_parts(spark, sf_dir):
    """F17 + F18: elapsed time per user as hours and minutes."""
    e = _t(spark, sf_dir).events
    span = e.groupBy("user_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    secs = FMT.elapsed_seconds("start", "end")
    hours, minutes = FMT.hours_minutes(secs)
    return span.select("user_id", F.round(secs, 3).alias("elapsed_s"), hours.alias("hours"), minutes.alias("minutes"))


@query("find_container")
def q_find_container(spark, sf_dir):
    """First archive of its project that contains each requested class."""
    t = _t(spark, sf_dir)
    req = B.requests_member(t).select("ordinal", "project", "class", P.name_to_member("class").alias("member"))
    return J.find_container(req, B.members(t), keys=["project"])


# The requested name fragments of the fuzzy lookup.
FUZZY_PATTERNS = ["customer#00000001", "CUSTOMER#0000012", "zz"]


@query("fuzzy_match")
def q_fuzzy_match(spark, sf_dir):
    """J5 + F14: first customer name containing each requested fragment."""
    return J.fuzzy_match(_t(spark, sf_dir).customer, FUZZY_PATTERNS, "c_name", "c_custkey")


# An exact name, a fragment of several, and one that is absent.
CATALOG_NAMES = ["Customer#000000012", "customer#00000001", "zz"]


@query("companions")
def q_companions(spark, sf_dir):
    """Scaffolding files next to rewritten files."""
    t = _t(spark, sf_dir)
    return J.companions(B.artifacts(t).select("ordinal", "path"), B.listing_artifacts(t))


@query("sft_pairs")
def q_sft_pairs(spark, sf_dir):
    """User turns with the assistant turn that follows, written as a snapshot and read as pairs."""
    path = scratch_path(spark, "pairs")
    B.sft_pairs(_t(spark, sf_dir)).write.parquet(path)
    return SRC.read_pairs(spark, path, keys=["conv_id", "turn"])


@query("conversation_messages")
def q_conversation_messages(spark, sf_dir):
    """M6 + M7: three-message conversations with mapped roles, long form."""
    p = B.sft_pairs(_t(spark, sf_dir))
    msgs = CH.map_roles(CH.to_conversation("source", "target"))
    return p.select("conv_id", "turn", F.posexplode(msgs).alias("msg_pos", "m")).select(
        "conv_id", "turn", "msg_pos", F.col("m.role").alias("role"), F.col("m.content").alias("content")
    )


@query("render_chat")
def q_render_chat(spark, sf_dir):
    """M8: ChatML training text per pair."""
    p = B.sft_pairs(_t(spark, sf_dir))
    return p.select("conv_id", "turn", CH.render_chat(CH.map_roles(CH.to_conversation("source", "target"))).alias("text"))


@query("render_chat_thread")
def q_render_chat_thread(spark, sf_dir):
    """M8: ChatML text per conversation thread."""
    c = _t(spark, sf_dir).conversations
    frags = c.select("conv_id", "turn", CH.chatml_message(F.col("role"), F.col("text")).alias("frag"))
    return O.ordered_concat(frags, ["conv_id"], ["turn"], "frag", "", "text", chunk_col=F.floor(F.col("turn") / 512))


# ---------------------------------------------------------------- checks


# The languages the corpus must contain.
REQUIRED_LANGS = ["en", "fr", "de", "es", "it"]


def check_results(spark, sf_dir):
    t = _t(spark, sf_dir)
    checks = [
        QC.min_count("documents >= 100", t.documents, 100),
        QC.refs_exist("labels.doc_id in documents", t.labels, "doc_id", t.documents, "doc_id"),
        QC.refs_exist("orders.o_custkey in customer", t.orders, "o_custkey", t.customer, "c_custkey"),
        QC.min_count("events >= 1e9", t.events, 10**9, severity="warning", fail_passes=True),
        QC.required_present("languages present", t.documents, "lang", REQUIRED_LANGS),
    ]
    return QC.run_checks(checks)


@query("run_checks")
def q_run_checks(spark, sf_dir):
    """Q1-Q4: data-quality check suite over the tables."""
    return check_results(spark, sf_dir)


@query("check_tally")
def q_check_tally(spark, sf_dir):
    """Passed / total / all passed of the suite."""
    return R.tally(check_results(spark, sf_dir))


@query("check_status")
def q_check_status(spark, sf_dir):
    """Q5: ready / degraded / failed."""
    return QC.check_status(check_results(spark, sf_dir))


# ---------------------------------------------------------------- more statistics


@query("describe_text")
def q_describe_text(spark, sf_dir):
    """Count, unique, top, freq of conversation roles."""
    return S.describe_text(_t(spark, sf_dir).conversations, ["role"])


@query("column_profile")
def q_column_profile(spark, sf_dir):
    """A10: non-null count and dtype per document column."""
    return S.profile(_t(spark, sf_dir).documents)


@query("box_stats")
def q_box_stats(spark, sf_dir):
    """Quartiles, fences, whiskers and outliers of the paired metrics."""
    return S.box_stats(paired(spark, sf_dir), PAIRED_COLS)


@query("improvement")
def q_improvement(spark, sf_dir):
    """Improved / equal / worse counts and mean delta."""
    return S.improvement(paired(spark, sf_dir), [("cov", "baseline_cov", "valid_cov"), ("mut", "baseline_mut", "valid_mut")])


@query("signed_rank")
def q_signed_rank(spark, sf_dir):
    """G1: signed-rank statistic of coverage deltas."""
    return RK.signed_rank(paired(spark, sf_dir), "baseline_cov", "valid_cov")


@query("rank_sum")
def q_rank_sum(spark, sf_dir):
    """Rank-sum statistic of baseline vs valid coverage."""
    return RK.rank_sum(paired(spark, sf_dir), "baseline_cov", "valid_cov")


@query("signed_rank_by_class")
def q_signed_rank_by_class(spark, sf_dir):
    """G1: signed-rank test of the coverage deltas of each class, exact for few and normal for many."""
    return RK.signed_rank_test(paired(spark, sf_dir), "baseline_cov", "valid_cov", ["class"])


@query("rank_sum_by_class")
def q_rank_sum_by_class(spark, sf_dir):
    """Rank-sum test of a class's click values against its purchase values."""
    e = _t(spark, sf_dir).events
    kind = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    return RK.rank_sum_test(e.select(F.col("user_id").alias("class"), kind("click").alias("x"), kind("purchase").alias("y")), "x", "y", ["class"])


@query("effect_size")
def q_effect_size(spark, sf_dir):
    """A12 effect size and magnitude."""
    return RK.effect_size(paired(spark, sf_dir), "baseline_cov", "valid_cov")


# ---------------------------------------------------------------- sources, sinks, streaming


@query("manifest_scan")
def q_manifest_scan(spark, sf_dir):
    """Manifest written as CSV and read back in file order."""
    path = scratch_path(spark, "manifest_csv")
    m = B.manifest(_t(spark, sf_dir))
    m.orderBy("ordinal").select("class", F.lit(1).alias("id"), "project").write.option("header", True).option("escape", '"').csv(path)
    back = SRC.read_manifest(spark, path)
    return O.positions(back, ["ordinal"], out="pos").select("pos", "project", "class")


@query("file_listing_scan")
def q_file_listing_scan(spark, sf_dir):
    """The files of texts written by source and number range: files, bytes and last range by source."""
    path = scratch_path(spark, "by_source")
    part = F.floor(F.col("doc_id") / 1024).alias("part")
    docs = _t(spark, sf_dir).documents.select("source", part, "text")
    docs.repartition("source", "part").write.partitionBy("source", "part").text(path)
    folder = lambda key: F.regexp_extract("path", f"/{key}=([^/]*)/", 1)
    files = SRC.list_files(spark, path, "*.txt").select(folder("source").alias("source"), folder("part").cast("long").alias("part"), "path", "bytes")
    return files.groupBy("source").agg(F.count_distinct("path").alias("n_files"), F.sum("bytes").alias("n_bytes"), F.max("part").alias("last_part"))


@query("artifact_scan")
def q_artifact_scan(spark, sf_dir):
    """Whole-text artifact files of at most 256 artifacts each; characters (a line feed per artifact) by project."""
    path = scratch_path(spark, "artifacts_text")
    B.artifacts(_t(spark, sf_dir)).select("project", "code").write.option("maxRecordsPerFile", 256).partitionBy("project").text(path)
    back = SRC.read_artifacts(spark, path)
    project = F.regexp_extract("path", r"/project=([^/]*)/", 1).alias("project")
    return back.groupBy(project).agg(F.sum(F.length("text")).alias("n_chars"))


@query("coverage_csv_available")
def q_coverage_csv_available(spark, sf_dir):
    """Coverage report CSV availability."""
    path = scratch_path(spark, "coverage_csv")
    B.eval_counts(_t(spark, sf_dir)).write.option("header", True).csv(path)
    return SRC.report_available(SRC.read_coverage_csv(spark, path))


@query("incremental_append")
def q_incremental_append(spark, sf_dir):
    """K2: events appended once through a checkpointed stream."""
    out = scratch_path(spark, "events_stream_out")
    ckpt = scratch_path(spark, "events_stream_ckpt")
    schema = _t(spark, sf_dir).events.schema  # footer metadata only
    src = INC.stream_source(spark, sf_dir, schema, "parquet", glob="events.parquet")
    INC.stream_records(src, out, ckpt)
    return spark.read.schema(schema).parquet(out)


RUN_COLUMNS = ["ordinal", "project", "class", "success", "cov", "mut"]


def _arrivals(spark, sf_dir, state):
    """The run records in three arrivals, out of order, the third repeating a fifth of the first; the stream restarts for each."""
    runs = B.baseline_runs(_t(spark, sf_dir)).select(*RUN_COLUMNS)
    src, out, ckpt = (scratch_path(spark, n) for n in ("arrivals", "changes", "changes_ckpt"))
    for i in range(3):
        mine = F.col("ordinal") % 3 == 2 - i  # later arrivals hold earlier records of the same keys
        again = (F.col("ordinal") % 15 == 2) if i == 2 else F.lit(False)
        runs.where(mine | again).write.mode("append").parquet(src)
        RUN.write_changes(state(INC.stream_source(spark, src, runs.schema)), out, ckpt)
    return out


@query("stream_latest")
def q_stream_latest(spark, sf_dir):
    """K2 + W2: latest run record per class, kept up as records arrive late and repeated."""
    out = _arrivals(spark, sf_dir, lambda s: RUN.keyed_latest(s, ["class"], "ordinal"))
    schema = B.baseline_runs(_t(spark, sf_dir)).select("class", *[c for c in RUN_COLUMNS if c != "class"]).schema
    return RUN.current(RUN.history(spark, out, schema), ["class"])


@query("running_tally")
def q_running_tally(spark, sf_dir):
    """Total, successes and percent per project after every arrival that touches it."""
    out = _arrivals(spark, sf_dir, lambda s: RUN.running_tally(s, ["project"]))
    return RUN.history(spark, out, "project STRING, total BIGINT, successes BIGINT, percent DOUBLE")


# ---------------------------------------------------------------- generation


@query("refine_prompts")
def q_refine_prompts(spark, sf_dir):
    """P1 + M1 + F3: the prompt of each test file of a successful run, or why there is none."""
    t = _t(spark, sf_dir)
    files = R.explode_artifacts(R.successful(B.baseline_runs(t))).select("ordinal", "class", "test_file")
    texts = t.documents.select(F.col("doc_id").alias("ordinal"), "text")
    return GEN.prompts(files, texts, "ordinal", "text")


@query("refine_job")
def q_refine_job(spark, sf_dir):
    """X3 + F2: refined records of the replies that hold code."""
    t = _t(spark, sf_dir)
    return GEN.refined(B.artifacts(t).join(B.replies(t).withColumnRenamed("doc_id", "ordinal"), "ordinal"))


@query("refine_failures")
def q_refine_failures(spark, sf_dir):
    """Failure records of the replies without code."""
    t = _t(spark, sf_dir)
    return GEN.failed(B.artifacts(t).join(B.replies(t).withColumnRenamed("doc_id", "ordinal"), "ordinal"))


@query("accepted_write")
def q_accepted_write(spark, sf_dir):
    """K4: accepted artifacts written by project and read back; rows per project."""
    t = _t(spark, sf_dir)
    ok = R.verified(R.with_verdict(B.verdicts(t))).select(F.col("doc_id").alias("ordinal")).distinct()
    path = scratch_path(spark, "accepted")
    SNK.write_accepted(B.artifacts(t).join(ok, "ordinal", "left_semi"), path)
    return spark.read.parquet(path).groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("code")).alias("n_chars"))


@query("has_rows")
def q_has_rows(spark, sf_dir):
    """The nonempty guard of several tables and of a filter that nothing passes."""
    t = _t(spark, sf_dir)
    guarded = [("documents", t.documents), ("events", t.events), ("labels", t.labels), ("toxic over 1", t.labels.where("toxic > 1"))]
    return spark.createDataFrame([(name, R.has_rows(df)) for name, df in guarded], "name STRING, has_rows BOOLEAN")


@query("recursive_counts")
def q_recursive_counts(spark, sf_dir):
    """Files and .html files at any depth below each host, and below a host that is absent."""
    lst = B.listing(_t(spark, sf_dir))
    hosts = lst.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("root")).distinct()
    return L.recursive_counts(lst, hosts.unionByName(spark.createDataFrame([("absent.example",)], "root STRING")))


@query("catalog_lookup")
def q_catalog_lookup(spark, sf_dir):
    """J1 + J5: exact catalog entry first, a containing one as fallback."""
    return J.exact_or_contains(_t(spark, sf_dir).customer, CATALOG_NAMES, "c_name", "c_custkey")


@query("archive_substring")
def q_archive_substring(spark, sf_dir):
    """The first archive of its project with a member whose path contains each class's bare file name."""
    t = _t(spark, sf_dir)
    req = B.manifest(t).select("ordinal", "project", F.concat(P.last_segment("class"), F.lit(".class")).alias("wanted"))
    mem = B.members(t).withColumn("depth", P.depth("archive"))
    found = SUB.first_containing(req, mem, "wanted", "member", ["depth", "archive", "member"], ["project"], ignore_case=False)
    archives = mem.groupBy("project", "member").agg(F.min(F.struct("depth", "archive")).alias("a"))
    return found.join(archives.withColumnRenamed("member", "match"), ["project", "match"], "left").select(
        "ordinal", "project", "wanted", F.col("match").alias("member"), F.col("a.archive").alias("archive"), "n_candidates"
    )


@query("name_substring")
def q_name_substring(spark, sf_dir):
    """The first customer name that contains each requested fragment, any case, long and short fragments alike."""
    t = _t(spark, sf_dir)
    return SUB.first_containing(B.name_requests(t), t.customer, "fragment", "c_name", ["c_custkey"], out="match")


@query("marker_hits")
def q_marker_hits(spark, sf_dir):
    """P10 + F14: every three-word phrase of the benchmark that each document holds, and where first."""
    t = _t(spark, sf_dir)
    w = F.split("text", " ")
    phrases = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " "))
    phrases = t.benchmark.where(F.size(w) >= 3).select(F.explode(phrases).alias("marker"))
    return MK.find_markers(t.documents, phrases, "doc_id", "text").select("doc_id", "marker", "first_at")


# ---------------------------------------------------------------- more sources and sinks


#: Batches in which the paired metrics arrive.
STATE_BATCHES = 4


@query("describe_batches")
def q_describe_batches(spark, sf_dir):
    """Describe of the paired metrics from stored states of batches; each quartile's rank held against all rows."""
    df = materialize(paired(spark, sf_dir), "paired")
    path = scratch_path(spark, "describe_states")
    for b in range(STATE_BATCHES):
        SM.store_state(df.where(F.pmod("ordinal", F.lit(STATE_BATCHES)) == b), PAIRED_COLS, path, b)
    merged = materialize(SM.describe_merged(SM.merge_states(SM.stored_states(spark, path))), "described")
    qs = merged.select(F.col("column"), "n", F.posexplode("quantiles").alias("i", "quantile"))
    # three quantiles per column of a literal list
    at = S.stack_long(df, PAIRED_COLS).join(F.broadcast(qs), "column").groupBy("column", "i", "n").agg(
        F.count_if(F.col("value") < F.col("quantile")).alias("below"), F.count_if(F.col("value") <= F.col("quantile")).alias("upto")
    )
    q, off = (F.col("i") + 1) * 0.25, F.lit(SM.rank_error())
    held = at.groupBy("column").agg(F.bool_and((F.col("below") / F.col("n") - off <= q) & (F.col("upto") / F.col("n") + off >= q)).alias("quartiles_hold"))
    return merged.join(held, "column").select("column", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")], "quartiles_hold")


@query("checks_on_write")
def q_checks_on_write(spark, sf_dir):
    """Q1 + Q2 + Q4: counts, languages and ids of the documents, checked by the write that stores them."""
    checks = [
        QC.watch_count("documents >= 100", 100),
        QC.watch_count("documents >= 1e9", 10**9, severity="warning", fail_passes=True),
        QC.watch_required("languages present", "lang", [*REQUIRED_LANGS, "xx"]),
        QC.watch_no_nulls("doc_id set", "doc_id"),
    ]
    path = scratch_path(spark, "documents_checked")
    return QC.checks_while_writing(_t(spark, sf_dir).documents, checks, lambda df: df.write.parquet(path))


@query("accepted_rerun")
def q_accepted_rerun(spark, sf_dir):
    """K4: accepted artifacts of all projects, then a second run of those with a name of odd length; its rows replace theirs."""
    t = _t(spark, sf_dir)
    ok = R.verified(R.with_verdict(B.verdicts(t))).select(F.col("doc_id").alias("ordinal")).distinct()
    first = B.artifacts(t).join(ok, "ordinal", "left_semi").select("ordinal", "project", "code")
    path = scratch_path(spark, "accepted_runs")
    AC.write_run(first, path, 1)
    again = first.where(F.length("project") % 2 == 1).withColumn("code", F.concat("code", F.lit("// 2")))
    AC.write_run(again, path, 2)
    now = AC.read_accepted(spark, path, first.schema)
    return now.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("code")).alias("n_chars"), F.count_if(F.col("code").endswith("// 2")).alias("n_second"))


@query("preview_pairs")
def q_preview_pairs(spark, sf_dir):
    """head() of the training pairs (first five by conversation and turn)."""
    return G.preview(B.sft_pairs(_t(spark, sf_dir)), ["conv_id", "turn"], 5)


@query("manifest_fallback")
def q_manifest_fallback(spark, sf_dir):
    """The manifest read from the first of several candidate paths that exists."""
    written = scratch_path(spark, "manifest_csv")
    B.manifest(_t(spark, sf_dir)).orderBy("ordinal").select("project", "class").write.option("header", True).option("escape", '"').csv(written)
    missing = scratch_path(spark, "manifest_missing")
    back = SRC.read_first_existing(spark, [missing, written], SRC.read_manifest)
    return O.positions(back, ["ordinal"], out="pos").select("pos", "project", "class")


@query("summary_csv")
def q_summary_csv(spark, sf_dir):
    """K3: the describe table written as one header CSV and read back with its schema."""
    desc = S.describe_numeric(paired(spark, sf_dir), PAIRED_COLS)
    path = scratch_path(spark, "summary_csv")
    SNK.write_summary(desc, path)
    return spark.read.option("header", True).schema(desc.schema).csv(path)
