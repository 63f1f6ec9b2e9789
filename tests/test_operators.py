"""Operators on literal edge rows (FIXTURES.md section 3)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from runlens.operators import checks as QC
from runlens.operators import generate as GEN
from runlens.operators import groups as G
from runlens.operators import joins as J
from runlens.operators import listing as L
from runlens.operators import runs as R
from runlens.operators import stats as S
from runlens.session import scratch_path
from runlens.sources import files as SRC
from runlens.sources import sinks as SNK

BASE = "ordinal INT, class STRING, success BOOLEAN, cov DOUBLE, mut DOUBLE"
VALID = "ordinal INT, class STRING, verified BOOLEAN, cov DOUBLE, mut DOUBLE"


def test_pair_runs_edge_rows(spark):
    base = spark.createDataFrame(
        [
            (1, "A", True, 10.0, 1.0),
            (2, "A", True, 20.0, 2.0),  # duplicate baseline class: later wins
            (3, "B", True, 30.0, None),  # missing metric -> 0
            (4, "B", False, 99.0, 9.0),  # later duplicate failed: earlier successful one used
            (5, "C", True, 5.0, 5.0),  # class only on one side
        ],
        BASE,
    )
    valid = spark.createDataFrame(
        [(10, "A", True, 11.0, 1.0), (11, "A", True, 12.0, 2.0), (12, "B", True, 31.0, 3.0), (13, "D", True, 1.0, 1.0), (14, "B", False, 0.0, 0.0)],
        VALID,
    )
    got = sorted(tuple(r) for r in S.pair_runs(base, valid).collect())
    assert got == [
        (10, "A", 20.0, 11.0, 2.0, 1.0),
        (11, "A", 20.0, 12.0, 2.0, 2.0),  # several verified rows per class kept
        (12, "B", 30.0, 31.0, 0.0, 3.0),
    ]


def test_lookup_priority(spark):
    req = spark.createDataFrame([("both",), ("second",), ("neither",), ("first",)], "project STRING")
    a = spark.createDataFrame([("both", "a1", 1), ("first", "a2", 2), ("first", "a3", 3)], "project STRING, root STRING, ordinal INT")
    b = spark.createDataFrame([("both", "b1", 1), ("second", "b2", 2)], "project STRING, root STRING, ordinal INT")
    got = {r.project: (r.root, r.dataset) for r in J.lookup_priority(req, [("a", a), ("b", b)], "project", ["root"]).collect()}
    assert got == {"both": ("a1", "a"), "second": ("b2", "b"), "neither": (None, None), "first": ("a2", "a")}


def test_manifest_csv_edge_rows(spark):
    d = tempfile.mkdtemp(prefix="manifest-")
    p = os.path.join(d, "classes.csv")
    with open(p, "w") as f:
        f.write('project,class\np1,a.B\np1,\n"p,2","x.Y"\np3,NoDot\n')
    m = SRC.read_manifest(spark, p)
    rows = [(r.project, r.class_) for r in m.withColumnRenamed("class", "class_").orderBy("ordinal").collect()]
    assert rows == [("p1", "a.B"), ("p1", ""), ("p,2", "x.Y"), ("p3", "NoDot")]
    seg = {r.segment: r.n for r in G.most_common(m.where(F.col("class") != ""), G.leading_segment("class"), 10, "ordinal", "segment").collect()}
    assert seg == {"a": 1, "x": 1, "default": 1}
    empty = tempfile.mkdtemp(prefix="manifest-empty-")
    with open(os.path.join(empty, "c.csv"), "w") as f:
        f.write("project,class\n")
    assert SRC.read_manifest(spark, empty).count() == 0
    first = SRC.read_first_existing(spark, [os.path.join(d, "missing.csv"), p], SRC.read_manifest)
    assert first.count() == 4


def test_manifest_binds_by_header_name(spark):
    def read(text, **options):
        path = os.path.join(tempfile.mkdtemp(prefix="manifest-"), "c.csv")
        with open(path, "w") as f:
            f.write(text)
        m = SRC.read_manifest(spark, path, **options)
        return [(r["project"], r["class"]) for r in m.orderBy("ordinal").collect()]

    assert read("class,project\na.B,p1\n") == [("p1", "a.B")]
    assert read("id,project,class,note\n7,P1,a.B,x\n") == [("P1", "a.B")]
    assert read('project,class\n"a ""q"" b",c\n') == [('a "q" b', "c")]
    assert read('project,class\n"a\nb",c\nd,e\n', multiline=True) == [("a\nb", "c"), ("d", "e")]
    with pytest.raises(ValueError, match="class"):
        read("project,name\np,a\n")


def test_manifest_files_with_headers_of_their_own(spark):
    d = tempfile.mkdtemp(prefix="manifest-")
    for name, text in (("a.csv", "project,class\nP1,C1\n"), ("b.csv", "id,class,project\n1,C2,P2\n"), ("c.csv", ""), ("d.csv", "project,class\nP3,C3\n"), ("e.csv", "class,note,project\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    rows = [(r["project"], r["class"]) for r in SRC.read_manifest(spark, d).orderBy("ordinal").collect()]
    assert rows == [("P1", "C1"), ("P2", "C2"), ("P3", "C3")]
    with open(os.path.join(d, "f.csv"), "w") as f:
        f.write("project,name\nP,x\n")
    with pytest.raises(ValueError, match="f.csv"):
        SRC.read_manifest(spark, d)


def test_prompts_keep_files_without_a_text(spark):
    files = spark.createDataFrame([(1, "a.java"), (2, "b.java"), (2, "c.java"), (3, "d.java")], "ordinal INT, test_file STRING")
    texts = spark.createDataFrame([(2, "code"), (3, None)], "ordinal INT, text STRING")
    got = {r.test_file: (r.prompt is not None, r.error) for r in GEN.prompts(files, texts, "ordinal", "text").collect()}
    assert got == {"a.java": (False, "no text"), "b.java": (True, None), "c.java": (True, None), "d.java": (False, "no text")}


def test_first_existing_does_not_hide_errors(spark):
    bad = os.path.join(tempfile.mkdtemp(prefix="manifest-"), "bad.csv")
    good = os.path.join(os.path.dirname(bad), "good.csv")
    for path, text in ((bad, "x,y\n1,2\n"), (good, "project,class\np,a\n")):
        with open(path, "w") as f:
            f.write(text)
    with pytest.raises(ValueError):
        SRC.read_first_existing(spark, [bad, good], SRC.read_manifest)


def test_archives_of_the_own_project_top_level_first(spark):
    req = spark.createDataFrame([("p1", "a/B.class"), ("p2", "a/B.class"), ("p1", "x.class")], "project STRING, member STRING")
    rows = [("p1", "p1/lib/a.jar", "a/B.class"), ("p1", "p1/z.jar", "a/B.class"), ("p1", "p1/lib/b.jar", "x.class"), ("p1", "p1/lib/a.jar", "x.class")]
    got = {(r.project, r.member): r.archive for r in J.find_container(req, spark.createDataFrame(rows, "project STRING, archive STRING, member STRING"), keys=["project"]).collect()}
    assert got == {("p1", "a/B.class"): "p1/z.jar", ("p2", "a/B.class"): None, ("p1", "x.class"): "p1/lib/a.jar"}
    jars = spark.createDataFrame([("p", "p/lib/a.jar"), ("p", "p/z.jar"), ("q", "q/lib/b.jar")], "project STRING, path STRING")
    catalog = spark.createDataFrame([("p", "r1"), ("q", "r2")], "project STRING, root STRING")
    ins = spark.createDataFrame([("p",), ("q",), ("none",)], "project STRING")
    assert {r.project: r.first_jar for r in J.resolve_inputs(ins, catalog, jars).collect()} == {"p": "p/z.jar", "q": "q/lib/b.jar"}


def test_each_prompt_is_generated_once(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counting:
        def generate_batch(self, prompts):
            calls.add(len(prompts))
            return [{"success": i % 2 == 0, "code": "import a;", "error": "odd"} for i, _ in enumerate(prompts)]

    arts = spark.createDataFrame([(i, "p", "c", "generated/baseline/p/c", "x") for i in range(10)], "ordinal INT, project STRING, class STRING, path STRING, code STRING").coalesce(1)
    ok, bad = GEN.refine(arts, Counting)
    assert ok.count() == 5 and bad.count() == 5 and calls.value == 10


def test_recursive_counts(spark):
    df = spark.createDataFrame([("a/b/x.html",), ("a/y.jar",), ("a/b/c/z.html",), ("top.html",)], "path STRING")
    roots = spark.createDataFrame([("a",), ("a/b",), ("none",)], "root STRING")
    got = {r.root: (r.n_files, r.n_html) for r in L.recursive_counts(df, roots).collect()}
    assert got == {"a": (3, 2), "a/b": (2, 2), "none": (0, 0)}


def test_scratch_needs_a_shared_folder_on_a_cluster_and_is_released(spark, monkeypatch):
    from runlens import session

    class Far:
        class sparkContext:
            master = "spark://far:7077"
            getCheckpointDir = staticmethod(lambda *a: None)

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Far)
    session.release(spark)
    S.box_stats(spark.createDataFrame([(1.0,), (2.0,)], "x DOUBLE"), ["x"]).collect()
    paths = session.scratch_paths(spark)
    assert paths and all(os.path.isdir(p) for p in paths)
    assert session.release(spark) == len(paths) and not any(os.path.exists(p) for p in paths)


def test_top_k_ties_and_remainder(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", "b", "a", "c"])], "ordinal INT, v STRING")
    top = [(r.value, r.n, r.rank) for r in G.most_common(df, "v", 2, "ordinal").orderBy("rank").collect()]
    assert top == [("b", 2, 1), ("a", 2, 2)]  # tie at the cut-off -> first seen
    many = G.most_common(df, "v", 10, "ordinal").count()
    assert many == 3  # k larger than the group count
    hg = G.head_groups(df.withColumnRenamed("v", "project"), "project", 5).collect()
    assert {r.remaining for r in hg} == {0}  # remainder never negative


def test_checks_suite(spark):
    assert R.tally(spark.createDataFrame([], "passed BOOLEAN")).first().all_passed is True
    docs = spark.createDataFrame([(1, "en"), (2, "fr")], "doc_id INT, lang STRING")
    res = QC.run_checks(
        [
            QC.min_count("n >= 1", docs, 1),
            QC.min_count("n >= 10", docs, 10, severity="warning", fail_passes=True),
            QC.required_present("langs", docs, "lang", ["en", "it", "de"]),
        ]
    )
    rows = {r.check: r for r in res.collect()}
    assert rows["n >= 1"].passed and rows["n >= 1"].severity is None
    assert rows["n >= 10"].passed and rows["n >= 10"].severity == "warning"
    assert not rows["langs"].passed and rows["langs"].detail == "it,de"
    assert QC.check_status(res).first().status == "failed"
    warn_only = QC.run_checks([QC.min_count("n >= 10", docs, 10, severity="warning", fail_passes=True)])
    assert QC.check_status(warn_only).first().status == "degraded"
    ok = QC.run_checks([QC.min_count("n >= 1", docs, 1)])
    assert QC.check_status(ok).first().status == "ready"


def test_summary_zero_rows(spark):
    r = R.run_summary(spark.createDataFrame([], "success BOOLEAN")).first()
    assert (r.total, r.successes, r.percent) == (0, 0, None)


def test_generation_failures_are_rows(spark):
    class Flaky:
        def generate(self, prompt):
            if "boom" in prompt:
                raise RuntimeError("service down")
            return {"success": True, "code": prompt.upper(), "tokens": 1}

    df = spark.createDataFrame([(1, "ok"), (2, "boom")], "id INT, p STRING")
    got = {r.id: (r.success, r.code, r.error) for r in GEN.apply_generator(df, "p", Flaky, ["id"]).collect()}
    assert got == {1: (True, "OK", None), 2: (False, None, "service down")}
    try:
        GEN.get_generator("nope")
        raise AssertionError("unknown generator must raise")
    except ValueError:
        pass


def test_refine_splits_failures(spark):
    arts = spark.createDataFrame(
        [(1, "p", "a.B", "generated/baseline/p/a_B/B_ESTest.java", "x" * 5), (2, "p", "a.C", "generated/baseline/p/a_C/C_ESTest.java", "y")],
        "ordinal INT, project STRING, class STRING, path STRING, code STRING",
    )
    ok, failed = GEN.refine(arts, GEN.get_generator("echo_wrapped", refuse_mod=0))
    rows = ok.collect()
    assert failed.count() == 0 and len(rows) == 2
    assert all(r.refined_code.startswith("import x;") for r in rows)
    assert rows[0].refined_file.startswith("generated/refined/")


def test_sinks_round_trip(spark):
    df = spark.createDataFrame([(1, "p", None), (2, "q", "e")], "ordinal INT, project STRING, error STRING")
    path = scratch_path(spark, "records")
    SNK.write_records(df, path)
    back = SRC.read_runs(spark, path, "ordinal INT, project STRING, error STRING")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "p", None), (2, "q", "e")]
    acc = scratch_path(spark, "accepted")
    SNK.write_accepted(df, acc)
    assert spark.read.parquet(acc).where(F.col("project") == "q").count() == 1  # partition pruning by directory
    summ = scratch_path(spark, "summary")
    SNK.write_summary(df, summ)
    assert spark.read.option("header", True).csv(summ).count() == 2


def test_has_rows_preview_and_row_at(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "ordinal INT, v STRING")
    assert R.has_rows(df) and not R.has_rows(df.where("ordinal < 0"))
    assert [r.ordinal for r in G.preview(df, "ordinal", 3).collect()] == [0, 1, 2]
    assert G.row_at(df, "ordinal", 5).first().v == "v5"
    assert G.limit_input(df, None, "ordinal").count() == 10 and G.limit_input(df, 0, "ordinal").count() == 10
    assert G.limit_input(df, 4, "ordinal").count() == 4


def test_ratio_totals_is_ratio_of_sums(spark):
    df = spark.createDataFrame([("a", 1.0, 10), ("a", 9.0, 10), ("b", 0.0, 0)], "g STRING, killed DOUBLE, total INT")
    got = {r.g: r.mutation_score for r in R.ratio_totals(df, ["g"]).collect()}
    assert got == {"a": 50.0, "b": None}


def test_pair_runs_missing_null_and_latest_struct(spark):
    base = spark.createDataFrame([(1, "A", True, None, 1.0)], BASE)
    valid = spark.createDataFrame([(2, "A", True, 5.0, None)], VALID)
    r = S.pair_runs(base, valid, missing="null").first()
    assert r.baseline_cov is None and r.valid_mut is None
    from runlens.operators.ordering import latest

    df = spark.createDataFrame([("k", 1, "a", 1.0), ("k", 1, "b", 2.0), ("k", 0, "c", 3.0)], "k STRING, o INT, s STRING, v DOUBLE")
    got = latest(df, ["k"], "o", unique_order=False).first()
    assert (got.s, got.v) in {("a", 1.0), ("b", 2.0)}  # both columns from one tied row


def test_describe_approx_option(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x DOUBLE")
    d = {r.statistic: r.x for r in S.describe_numeric(df, ["x"], approx_accuracy=10000).collect()}
    assert d["50%"] == 50.0 and d["count"] == 101


def test_safe_check_turns_errors_into_failures(spark):
    def broken():
        raise RuntimeError("table missing")

    res = QC.run_checks([QC.safe_check("broken", broken, spark), QC.min_count("ok", spark.range(3), 1)]).collect()
    rows = {r.check: r for r in res}
    assert rows["broken"].passed is False and rows["broken"].severity == "error"
    assert "table missing" in rows["broken"].detail
    assert rows["ok"].passed is True


def test_no_tests_label_and_alt_prompt(spark):
    from runlens.functions import text as TX

    df = spark.createDataFrame([(True, 1, True, None, 0)], "has_project BOOLEAN, n_jars INT, tool_ok BOOLEAN, tool_error STRING, n_files INT")
    assert R.classify_runs(df, no_tests_label="no_tests").first().outcome == "no_tests"
    p = spark.range(1).select(TX.build_prompt(F.lit("X"), style="alt").alias("p")).first().p
    assert p.startswith("Refina este test Java") and "\n\nX\n\nInstrucciones:" in p


def test_companions_are_linear_not_pairs(spark):
    files = spark.createDataFrame([("d/A_ESTest.java",), ("d/B_ESTest.java",), ("d/C_ESTest.java",), ("e/X_ESTest.java",)], "path STRING")
    listing = spark.createDataFrame(
        [("d/A_ESTest_scaffolding.java",), ("d/B_ESTest_scaffolding.java",), ("d/readme.txt",), ("f/Z_scaffolding.java",)], "path STRING"
    )
    got = sorted(tuple(r) for r in J.companions(files, listing).collect())
    assert got == [("d", "d/A_ESTest_scaffolding.java"), ("d", "d/B_ESTest_scaffolding.java")]


def test_file_sources(spark):
    root = tempfile.mkdtemp(prefix="sources-")
    os.makedirs(os.path.join(root, "p1", "a_B"))
    with open(os.path.join(root, "p1", "a_B", "B_ESTest.java"), "w") as f:
        f.write("import a;\nclass B {}\n")
    with open(os.path.join(root, "p1", "a_B", "B_ESTest_scaffolding.java"), "w") as f:
        f.write("x")
    with open(os.path.join(root, "p1", "lib.jar"), "wb") as f:
        f.write(b"\0" * 10)
    listing = {os.path.basename(r.path): r.bytes for r in SRC.list_files(spark, root, "*.java").collect()}
    assert listing == {"B_ESTest.java": 21, "B_ESTest_scaffolding.java": 1}
    texts = {os.path.basename(r.path): r.text for r in SRC.read_artifacts(spark, root, "*_ESTest.java").collect()}
    assert texts == {"B_ESTest.java": "import a;\nclass B {}\n"}  # the whole file as one string
    csv_dir = tempfile.mkdtemp(prefix="report-")
    with open(os.path.join(csv_dir, "r.csv"), "w") as f:
        f.write("class,line\n")
    assert SRC.report_available(SRC.read_coverage_csv(spark, csv_dir)).first().available is False
    with open(os.path.join(csv_dir, "r.csv"), "a") as f:
        f.write("a.B,87\n")
    assert SRC.report_available(SRC.read_coverage_csv(spark, csv_dir)).first().available is True


def test_json_records_omit_null_fields(spark):
    import glob
    import json

    df = spark.createDataFrame([(1, None), (2, "timeout")], "ordinal INT, error STRING")
    path = scratch_path(spark, "records-json")
    SNK.write_records(df.coalesce(1), path)
    lines = [json.loads(l) for f in glob.glob(os.path.join(path, "*.json")) for l in open(f)]
    assert sorted(lines, key=lambda d: d["ordinal"]) == [{"ordinal": 1}, {"ordinal": 2, "error": "timeout"}]


def test_join_paths_read_pairs_and_generator_registry(spark):
    from runlens.functions.paths import join_paths

    df = spark.createDataFrame([(["p/a.jar", "p/b.jar"], ["p/lib/c.jar"])], "jars ARRAY<STRING>, lib ARRAY<STRING>")
    assert df.select(join_paths("jars", "lib").alias("cp")).first().cp == "p/a.jar:p/b.jar:p/lib/c.jar"
    snap = scratch_path(spark, "pairs")
    spark.createDataFrame([("s", "t", 1)], "source STRING, target STRING, extra INT").write.parquet(snap)
    pairs = SRC.read_pairs(spark, snap)
    assert pairs.columns == ["source", "target"] and pairs.first().target == "t"

    class Upper:
        def generate(self, prompt):
            return {"success": True, "code": prompt.upper(), "tokens": len(prompt)}

    GEN.register_generator("upper", Upper)
    out = GEN.apply_generator(spark.createDataFrame([(1, "ab")], "id INT, p STRING"), "p", GEN.get_generator("upper"), ["id"])
    assert out.first().code == "AB"
