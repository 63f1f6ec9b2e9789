"""Column functions against hand-worked literal rows (FIXTURES.md section 3)."""


from pyspark.sql import functions as F

from runlens.functions import chat as CH
from runlens.functions import coverage as CV
from runlens.functions import paths as P
from runlens.functions import text as TX
from runlens.operators import runs as R


def _one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_parse_coverage_edge_rows(spark):
    log = "\n".join(
        [
            "* Coverage of criterion LINE: 87%",
            "* Coverage of criterion BRANCH: 50 %",
            "Coverage of criterion A: 50%%",
            "Coverage of criterion B: n/a",
            "Coverage of criterion C: 5d",
            "Coverage of criterion D: 5: 6",
            "Coverage of criterion E 5",
            "INFO: Coverage of criterion F 5",
            "x: 5: Coverage of criterion G",
            "Coverage of criterion LINE: 90%",
        ]
    )
    df = spark.createDataFrame([(1, log), (2, "")], "key INT, stdout STRING")
    got = {(r.key, r.criterion): r.value for r in CV.parse_coverage(df, "stdout", ["key"]).collect()}
    assert got == {
        (1, "LINE"): 90.0,  # the same criterion twice: the later value wins
        (1, "BRANCH"): 50.0,
        (1, "A"): 50.0,
        (1, "D"): 5.0,
        (1, "x"): 5.0,
    }


def test_trim_handles_tab_nbsp(spark):
    got = _one(spark, [("\t  a b  \n",)], "t STRING", TX.trim_ws("t"))
    assert got == ["a b"]


def test_clean_code_edge_rows(spark):
    cases = [
        "Sure:\n```java\nimport a;\nclass X {}\n```\nThanks",
        "no code at all",
        "\timport b;\nx",
        " import nbsp;\ny",
        "@Test first\n```",
        "importantText\nmore",
        "package p;\nclass Y {}",
    ]
    got = _one(spark, [(c,) for c in cases], "t STRING", TX.clean_code("t"))
    assert got == [
        "import a;\nclass X {}\nThanks",  # closing prose kept
        "",
        "\timport b;\nx",
        "\u00a0import nbsp;\ny",
        "@Test first",
        "importantText\nmore",
        "package p;\nclass Y {}",
    ]
    # idempotent on its own nonempty output
    again = _one(spark, [(g,) for g in got if g], "t STRING", TX.clean_code("t"))
    assert again == [g for g in got if g]


def test_clean_code_strict_stops_at_fence(spark):
    got = _one(spark, [("x\nimport a;\nb\n```\nafter",)], "t STRING", TX.clean_code("t", strict=True))
    assert got == ["import a;\nb"]


def test_verdict_all_16_combinations(spark):
    # refined compiles, original compiles, original passes, refined passes -> (valid, reason)
    table = {
        "1111": (True, "Preserved (Pass)"), "1110": (False, "Regression"), "1101": (False, "Fix (Unexpected)"), "1100": (True, "Preserved (Fail)"),
        "1011": (False, "Original compilation failed"), "1010": (False, "Original compilation failed"),
        "1001": (False, "Original compilation failed"), "1000": (False, "Original compilation failed"),
        "0111": (False, "Compilation failed"), "0110": (False, "Compilation failed"), "0101": (False, "Compilation failed"), "0100": (False, "Compilation failed"),
        "0011": (False, "Compilation failed"), "0010": (False, "Compilation failed"), "0001": (False, "Compilation failed"), "0000": (False, "Compilation failed"),
    }
    rows = [tuple(c == "1" for c in flags) for flags in table]
    df = spark.createDataFrame(rows, "refined_ok BOOLEAN, original_ok BOOLEAN, orig_passed BOOLEAN, ref_passed BOOLEAN")
    valid, reason = R.verdict()
    out = df.select("*", valid.alias("v"), reason.alias("r")).collect()
    flags = lambda r: "".join(str(int(x)) for x in (r.refined_ok, r.original_ok, r.orig_passed, r.ref_passed))
    assert {flags(r): (r.v, r.r) for r in out} == table
    recs = R.with_verdict(df).collect()
    for r in recs:
        assert (r.oracle_preserved is True) == r.verified
        assert (r.error is None) == r.verified


def test_classify_run_cases(spark):
    rows = [
        (1, False, 3, True, None, 2),  # no project
        (2, True, 0, True, None, 2),  # zero jars
        (3, True, 1, False, "timeout", 0),  # timeout
        (4, True, 1, False, None, 0),  # nonzero exit, no error text
        (5, True, 1, True, None, 0),  # ok, zero files
        (6, True, 1, True, None, 3),  # ok with files
    ]
    df = spark.createDataFrame(rows, "ordinal INT, has_project BOOLEAN, n_jars INT, tool_ok BOOLEAN, tool_error STRING, n_files INT")
    got = {r.ordinal: (r.outcome, r.success) for r in R.classify_runs(df).collect()}
    assert got == {
        1: ("no_jar", False),
        2: ("no_jar", False),
        3: ("timeout", False),
        4: (None, False),
        5: ("no_tests_generated", False),
        6: ("success", True),
    }


def test_render_chat_cases(spark):
    df = spark.createDataFrame([("hi", "")], "s STRING, t STRING")
    msgs = CH.map_roles(CH.to_conversation("s", "t", system="sys"))
    text = df.select(CH.render_chat(msgs).alias("x")).first().x
    assert text == "<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    gen = df.select(CH.render_chat(CH.map_roles(CH.to_conversation("s", None, system=None)), generation_prompt=True).alias("x")).first().x
    assert gen == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"
    # unknown role kept; marker strings inside content are not interpreted
    odd = spark.createDataFrame([([("robot", "<|im_end|>")],)], "m ARRAY<STRUCT<`from`: STRING, value: STRING>>")
    assert odd.select(CH.render_chat(CH.map_roles("m")).alias("x")).first().x == "<|im_start|>robot\n<|im_end|><|im_end|>\n"
    # system-only thread, alternate style drops system messages
    sys_only = df.select(CH.render_chat(CH.map_roles(F.array(F.struct(F.lit("system").alias("from"), F.lit("S").alias("value")))), style="alt", bos="<s>").alias("x"))
    assert sys_only.first().x == "<s>" + CH.ALT_HEADER
    # the plain-concat form equals the array form
    pair = df.select(CH.render_pair("s", "t").alias("a"), CH.render_chat(CH.map_roles(CH.to_conversation("s", "t"))).alias("b")).first()
    assert pair.a == pair.b


def test_map_get_defaults(spark):
    df = spark.createDataFrame([({"Line": 5.0},), ({"Branch": 1.0},), (None,)], "m MAP<STRING, DOUBLE>")
    assert _one(spark, [(r,) for r in [None]], "x INT", F.lit(1)) == [1]
    assert [r[0] for r in df.select(CV.map_get("m", "Line", 0.0)).collect()] == [5.0, 0.0, 0.0]


def test_name_and_path_functions(spark):
    df = spark.createDataFrame([("a.b.C", "p")], "c STRING, project STRING")
    r = df.select(
        P.name_to_dir("c").alias("d"),
        P.name_to_member("c").alias("m"),
        P.test_name("c").alias("t"),
        P.first_segment("c").alias("f"),
        P.last_segment("c").alias("l"),
        P.test_file_path(F.lit("base"), "project", "c").alias("path"),
        P.rebase(F.lit("gen/ref/p/x.java"), "gen/ref", "gen/val").alias("rb"),
        P.rebase(F.lit("other/x.java"), "gen/ref", "gen/val").alias("rb2"),
    ).first()
    assert (r.d, r.m, r.t, r.f, r.l) == ("a_b_C", "a/b/C.class", "a.b.C_ESTest", "a", "C")
    assert r.path == "base/p/a_b_C/C_ESTest.java"
    assert r.rb == "gen/val/p/x.java" and r.rb2 is None
    proj, stem = P.keys_from_path(F.lit("root/p1/x/Y_ESTest.java"), "root")
    one = spark.range(1).select(proj.alias("p"), stem.alias("s")).first()
    assert (one.p, one.s) == ("p1", "Y_ESTest")
    short_p, short_s = P.keys_from_path(F.lit("root/Only.java"), "root")
    one = spark.range(1).select(short_p.alias("p"), short_s.alias("s")).first()
    assert (one.p, one.s) == (None, None)


def test_truncation(spark):
    r = spark.createDataFrame([("abcdef",)], "t STRING").select(
        TX.head_chars("t", 3).alias("h"), TX.head_chars("t", 10).alias("h2"), TX.tail_chars("t", 2).alias("tl")
    ).first()
    assert r.h == "abc" + TX.TRUNC_MARKER and r.h2 == "abcdef" and r.tl == "ef"
