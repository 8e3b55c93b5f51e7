"""op11 against a plain form of the same rule, and back."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import fim

KIND = "doc_id long, text string, id string, a int, row string, output string, n string, lo int"


def plainly(doc_id, text, percent=50):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    lo, hi = sorted(x % (n + 1) for x in h[:2])
    p, m, s = ("".join(u) for u in (units[:lo], units[lo:hi], units[hi:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def texts():
    draw = random.Random(1)
    odd = ["", None, " ", "\t\n  ", "one", " lead and trail \r\n ", "a<P>b", "x <S>", "<M>", "<P", "S> <S", "é𝄞 ünï\x0b\x0cx\x00y z w", "<<P <S <M M>", "word " * 30_000, " " * 50_000]
    return odd + ["".join(draw.choice(["ab", "<", "S>", " ", "\n", "é", "𝄞", "  "]) for _ in range(draw.randint(0, 40))) for _ in range(150)]


def test_against_plain_form(spark):
    rows = [(i, t, "clash", 1, "r", "o", "n", 3) for i, t in enumerate(texts())]
    rows += rows[:20] + [(None, t, "clash", 1, "r", "o", "n", 3) for t in ("", "some words of no id", "other words of no id")] * 2 + [(7, "another text of one id", "c", 1, "r", "o", "n", 3)]
    found = fim.transform(spark.createDataFrame(rows, KIND).repartition(5), percent=80)
    assert found.columns == ["doc_id", "text", "id", "a", "row", "lo", *fim.RESULTS]
    got = found.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    as_key = lambda x: tuple((v is not None, v) for v in x)
    expected = sorted(((r[0], r[1], *plainly(r[0], r[1], 80)) for r in rows), key=as_key)
    assert sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=as_key) == expected
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all(r["back"] == (r["text"] or "") and r["a"] == 1 and r["lo"] == 3 for r in got)


def test_empty_table_and_other_parameters(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    made = spark.range(200).select(F.col("id").alias("key"), F.lit("a b c d e f").alias("body"))
    forms = {r["form"]: r["count"] for r in fim.transform(made, "body", "key", seed=7, percent=100, spm_percent=0).groupBy("form").count().collect()}
    assert forms == {"psm": 200}


def test_units_are_not_shuffled(spark):
    """One exchange of lengths and one of texts: the running sum, the join of requests and the aggregate move nothing."""
    plan = fim.transform(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    units = plan[plan.index("Window [sum(length") :]
    assert "Exchange" not in units[: units.index("posexplode")]
    assert "Python" not in plan and "Arrow" not in plan


def test_many_copies_of_one_row(spark):
    rows = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("one two three four").alias("text"))
    got = fim.transform(rows, percent=100).groupBy("form", "n", "prefix_chars", "middle_chars", "output").count().collect()
    assert [tuple(r) for r in got] == [(plainly(5, "one two three four", 100)[1], 4, *plainly(5, "one two three four", 100)[2:], 3000)]
