"""op10: round trip, merging, escaping, masks and odd rows."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import chat_format as C

KIND = "conv_id long, turn long, role string, text string"


def run(spark, rows, kind=KIND):
    out = C.format_chats(spark.createDataFrame(rows, kind))
    return {r["conv_id"]: r for r in out.select("*", C.read_back(F.col("formatted")).alias("turns"), C.masked_text(F.col("segments")).alias("learned")).collect()}


def test_template_and_merging(spark):
    found = run(spark, [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b"), (1, 3, "assistant", "d")])[1]
    assert found["formatted"] == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_sep|>d<|im_end|>\n"
    assert "".join(s["text"] for s in found["segments"]) == found["formatted"]
    assert [s["text"] for s in found["segments"] if s["loss"]] == ["c", "d"]


def test_odd_rows(spark):
    found = run(spark, [(None, 1, None, None), (2, None, "assistant", ""), (2, 0, "a\nb", "x"), (2, 0, "a\nb", "x"), (3, 1, "user", "\n")])
    assert [(t["role"], t["text"]) for t in found[None]["turns"]] == [("", "")]
    assert [(t["role"], t["text"]) for t in found[2]["turns"]] == [("assistant", ""), ("a\nb", "x"), ("a\nb", "x")]
    assert [(t["role"], t["text"]) for t in found[3]["turns"]] == [("user", "\n")]
    assert run(spark, []) == {}
    clash = run(spark, [(1, 0, "user", "x", "f", "s")], KIND + ", formatted string, segments string")
    assert clash[1]["formatted"].startswith("<|im_start|>user")


def test_long_conversation(spark):
    rows = [(1, i, "user" if i // 3 % 2 else "assistant", f"t{i}<|im_end|>\n\\") for i in range(5000)]
    found = run(spark, rows)[1]
    assert [(t["role"], t["text"]) for t in found["turns"]] == [(r, t) for _, _, r, t in rows]
    assert hashlib.sha256(found["learned"].encode()).hexdigest() == hashlib.sha256("".join(t for _, _, r, t in rows if r == "assistant").encode()).hexdigest()


def test_any_text_comes_back(spark):
    piece = st.sampled_from(["<|im_end|>\n", "<|im_start|>", "<|im_sep|>", "<|im_nl|>", "\\", "<", "|", "<|", "\n", "é", "\U0001f600", "a", "N"])
    text = st.lists(piece, max_size=8).map("".join)

    @settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(text, text), min_size=30, max_size=60))
    def check(turns):
        found = run(spark, [(1, i, r, t) for i, (r, t) in enumerate(turns)])[1]
        assert [(t["role"], t["text"]) for t in found["turns"]] == turns

    check()


def test_no_python_in_the_plan(spark):
    out = C.format_chats(spark.range(3).select((F.col("id") % 2).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan
