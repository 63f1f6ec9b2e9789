"""Chat formatting: exact round trips and digests against plain Python, on awkward turns and split conversations."""

import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from runlens.llm import chatformat as C

T = C.Template()
SCHEMA = "conv_id long, turn long, role string, text string"
CONTROL = re.compile("|".join(re.escape(c) for c in C.CONTROLS))

pieces = st.sampled_from([*C.CONTROLS, "\\", "\\\\", "<", "[", "<\\s>", "[\\\\INST]", "s>", "INST]", "é", "日本", "\n", " ", "a"])
texts = st.lists(pieces, max_size=12).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool\n<s>\\n", "", None]), st.none() | texts), max_size=8))
@settings(max_examples=300, deadline=None)
def test_assembled_bytes_hold_the_turns(turns):
    out, borders, starts, ends = C.assemble(pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string()), T)
    text = out.tobytes().decode()
    expected = [(r or "", t or "") for r, t in turns]
    assert list(C.parse(text, T)) == expected
    assert text == "".join(T.header(r) + T.escape(t) + T.end for r, t in expected)
    raw = out.tobytes()
    assert [T.unescape(raw[a:b].decode()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] == [t for _, t in expected]
    assert borders[-1] == len(raw) and len(borders) == len(turns) + 1
    # only the template's own control strings are left
    assert all(not CONTROL.search(T.escape(t)) for _, t in expected)


def test_templates_that_could_not_be_read_back_are_refused():
    with pytest.raises(ValueError):
        C.Template(controls=(*C.CONTROLS, "<<SYS>>"))
    with pytest.raises(ValueError):
        C.Template(start="### ")
    other = C.Template(start="[INST]", end="[/INST]\n", controls=("[INST]", "[/INST]"))
    assert list(C.parse(other.header("user") + other.escape("a [INST] b") + other.end, other)) == [("user", "a [INST] b")]


def turn_rows():
    rng = random.Random(3)
    word = lambda: rng.choice(["ok", "</s>", "[INST]", "<\\s>", "naïve", "日本", "<", "s>", "\\"])
    rows = []
    for conv in range(40):
        rows += [(conv, t, rng.choice(["system", "user", "assistant", "assistant", None]), " ".join(word() for _ in range(rng.randint(0, 30)))) for t in range(rng.randint(1, 7))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"{t} " + "long text " * rng.randint(0, 60)) for t in range(1500)]  # a long conversation
    rows += [(101, 0, "user", "q"), (101, 1, "assistant", "<|im_end|>" * 40_000)]  # a very long text
    rows += [(102, 0, "user", None), (102, 1, "assistant", None), (103, 0, None, ""), (None, 0, "user", "no id"), (None, None, "assistant", "no turn")]
    rows += [(104, 0, "user", "b"), (104, 0, "user", "a"), (104, 0, "assistant", "tie"), (105, 0, "user", "twice"), (105, 0, "user", "twice")]
    rows += [(106, 0, "user", "ends with <"), (106, 1, "assistant", "s> begins so")]
    return rows


def expected(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest()))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        formatted = sum(len(T.header(r[2])) + len(T.escape(r[3] or "")) + len(T.end) for r in turns)
        out.append((str(conv), len(turns), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), len(loss), sha(loss), formatted))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_digests_match_brute_force(spark, monkeypatch, small):
    if small:  # every slice and part is small, so that conversations come in several parts
        monkeypatch.setattr(C, "SLICE_BYTES", 1 << 12)
        monkeypatch.setattr(C, "PART_BYTES", 1 << 14)
    rows = turn_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("part", "whole", "tie", "row", "loss"):
        df = df.withColumn(name, F.lit(1))
    parts = C.format_conversations(df).cache()
    got = sorted((str(r[0]), *r[1:]) for r in C.read_back(parts).collect())
    assert got == expected(rows)
    per_conv = {r["conv_id"]: r["n"] for r in parts.groupBy("conv_id").agg(F.count("*").alias("n")).collect()}
    assert per_conv[100] > (3 if small else 0)
    assert parts.where("whole").groupBy("conv_id").count().where("count > 1").count() == 0


def test_empty_table(spark):
    parts = C.format_conversations(spark.createDataFrame([], SCHEMA))
    assert parts.count() == 0 and C.read_back(parts).count() == 0
