"""Property checks: column functions on rows worked out by hand, and properties on random inputs."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from runlens.functions import coverage as CV
from runlens.functions import text as TX
from runlens.operators import runs as R
from runlens.operators import stats as S
from runlens.plans import bindings as B

LINE_PARTS = ["import a;", "package p;", "@Test", "```", "```java", "x = 1;", "importantText", "", " ", "\t", " ", "text"]
line = st.lists(st.sampled_from(LINE_PARTS), min_size=1, max_size=3).map("".join)
texts = st.lists(st.lists(line, min_size=0, max_size=8).map("\n".join), min_size=1, max_size=40)


# (reply, kept code), worked out by hand from the rule: from the first import, package or annotation line on, without fence lines
CLEANED = [
    ("", ""),
    ("no code at all", ""),
    ("Sure:\n```java\nimport a;\nx = 1;\n```", "import a;\nx = 1;"),
    ("```\n@Test\nvoid f() {}\n```\nBye", "@Test\nvoid f() {}\nBye"),
    ("  package p;\n\n\ty", "  package p;\n\n\ty"),
    ("importantText\nrest", "importantText\nrest"),
    ("a\n```@Test\nb", ""),
    ("import a;\n ```java\nimport b;", "import a;\nimport b;"),
]


def test_clean_code_worked_rows(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEANED)], "i INT, t STRING")
    assert [r.c for r in df.select("i", TX.clean_code("t").alias("c")).orderBy("i").collect()] == [c for _, c in CLEANED]


@settings(max_examples=12, deadline=None)
@given(texts)
def test_clean_code_properties(spark, batch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "i INT, t STRING")
    got = [r for r in df.select("i", "t", TX.clean_code("t").alias("c"), TX.clean_code(TX.clean_code("t")).alias("again")).orderBy("i").collect()]
    for r in got:
        assert r.again == r.c  # idempotent
        source, kept = r.t.split("\n"), r.c.split("\n") if r.c else []
        rest = iter(source)
        assert all(k in rest for k in kept)  # source lines only, in their order
        assert not any(k.strip().startswith("```") for k in kept)


COV_PARTS = ["Coverage of criterion ", "LINE", "BRANCH", ": ", ":", "87", "5.5", "%", " %", "%%", "n/a", "5d", " ", "\t", "x", "criterion"]
cov_line = st.lists(st.sampled_from(COV_PARTS), min_size=1, max_size=7).map("".join)
logs = st.lists(st.lists(cov_line, min_size=0, max_size=6).map("\n".join), min_size=1, max_size=30)

# (log, criteria), worked out by hand: name between the last "criterion" and the first colon, number before the second colon
PARSED = [
    ("", {}),
    ("Coverage of criterion LINE: 87%", {"LINE": 87.0}),
    ("Coverage of criterion LINE: 87%\nx\nCoverage of criterion LINE: 5.5 %", {"LINE": 5.5}),
    ("Coverage of criterion LINE: 87%\nCoverage of criterion LINE: n/a", {"LINE": 87.0}),
    ("* Coverage of criterion  BRANCH \t: 87%%: 5", {"BRANCH": 87.0}),
    ("Coverage of criterion: 5.5", {"": 5.5}),
    ("criterionCoverage of criterion LINEcriterion BRANCH: 87", {"BRANCH": 87.0}),
    ("Coverage of criterion LINE 87\nCoverage of LINE: 3", {}),
    ("Coverage of criterion A: 5d\nCoverage of criterion B: .5\nCoverage of criterion C: 1e2", {"B": 0.5, "C": 100.0}),
]


def test_parse_coverage_worked_rows(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PARSED)], "key INT, stdout STRING")
    got = {}
    for r in CV.parse_coverage(df, "stdout", ["key"]).collect():
        got.setdefault(r.key, {})[r.criterion] = r.value
    assert got == {i: c for i, (_, c) in enumerate(PARSED) if c}


@settings(max_examples=12, deadline=None)
@given(logs)
def test_a_log_in_segments_parses_like_the_whole(spark, batch):
    whole = spark.createDataFrame([(i, t) for i, t in enumerate(batch)], "key INT, stdout STRING")
    cut = spark.createDataFrame([(i, n, line) for i, t in enumerate(batch) for n, line in enumerate(t.split("\n"))], "key INT, segment INT, stdout STRING")
    rows = lambda df: sorted((r.key, r.criterion, r.value) for r in df.collect())
    assert rows(CV.parse_coverage(cut, "stdout", ["key"], "segment")) == rows(CV.parse_coverage(whole, "stdout", ["key"]))


def test_verdict_counts_sum_to_input(spark):
    t = B.Tables(spark, SF_SMALL)
    v = B.verdicts(t)
    valid, reason = R.verdict()
    by_reason = v.groupBy(reason.alias("r")).count().collect()
    assert sum(r["count"] for r in by_reason) == v.count()


def test_paired_size_is_verified_rows_with_successful_baseline(spark):
    t = B.Tables(spark, SF_SMALL)
    base, valid = B.baseline_runs(t), B.valid_runs(t)
    ok_classes = R.successful(base).select("class").distinct()
    expected = R.verified(valid).join(ok_classes, "class", "left_semi").count()
    assert S.pair_runs(base, valid).count() == expected


def test_fixture_distributions_match_the_blueprint(spark):
    """SURVEY section 2.13 states these counts at sf0.01; the bindings must reproduce them."""
    from conftest import SF_MID

    t = B.Tables(spark, SF_MID)
    valid, reason = R.verdict()
    got = {r.r: r["count"] for r in B.verdicts(t).groupBy(reason.alias("r")).count().collect()}
    assert got == {"Compilation failed": 61, "Original compilation failed": 28, "Preserved (Pass)": 230,
                   "Preserved (Fail)": 7, "Regression": 36, "Fix (Unexpected)": 37}
    out = {r.outcome: r["count"] for r in R.classify_runs(B.attempts(t)).groupBy("outcome").count().collect()}
    assert out == {"no_jar": 1610, "timeout": 618, None: 1062, "no_tests_generated": 1666, "success": 5044}
    assert S.pair_runs(B.baseline_runs(t), B.valid_runs(t)).count() == 1621
    assert B.sft_pairs(t).count() == 233 and B.manifest(t).count() == 1000 and B.baseline_runs(t).count() == 10_000
