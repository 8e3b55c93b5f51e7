"""op4 against brute force."""

import random

from tidemark.llm.line_dedup import dedup_lines, line_windows


def brute(docs):
    """docs: (id, text) of different ids; text after removal, and the number of lines removed."""
    first, gone = {}, {}
    for i, text in sorted((d for d in docs if d[1] is not None), key=lambda d: (d[0] is not None, d[0])):
        lines = [x.strip(" \t\r\x0b\x0c") for x in text.split("\n")]
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not any(w):
                continue
            if w not in first:
                first[w] = (i, p)
            else:
                lo = max(p, first[w][1] + 3) if first[w][0] == i else p
                gone.setdefault(i, set()).update(range(lo, p + 3))
    return {i: (t if t is None or i not in gone else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]), len(gone.get(i, ()))) for i, t in docs}


def run(spark, rows, kind="doc_id long, text string"):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in dedup_lines(spark.createDataFrame(rows, kind)).collect()), key=str)


def test_against_brute_force(spark):
    draw = random.Random(5)
    docs = [(i, "\n".join(draw.choice(["a", "b", " c", "c\t", "", "d", "\x0bd\r", "e", "f g"]) for _ in range(draw.randint(0, 14)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "x\ny"), (503, "q\n" * 5000), (504, "\n\n\n\n"), (None, "a\nb\nd\ne")]
    expected = brute(docs)
    for i, text, n, removed in run(spark, docs):
        assert (text, removed) == expected[i]
        assert n == (0 if i == 500 else len(dict(docs)[i].split("\n")))


def test_repeated_rows_and_other_columns(spark):
    rows = [(1, "a\nb\nc", 7), (1, "a\nb\nc", 7), (2, "a\nb\nc\nd", 8), (1, "other\na\nb\nc", 9)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed int").withColumnRenamed("n_removed", "n_lines"))
    assert sorted(out.columns) == ["doc_id", "n_lines", "n_removed", "text"]
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) in ([(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "other"), (2, "d")], [(1, ""), (1, ""), (1, "other\na\nb\nc"), (2, "d")])
    assert run(spark, []) == []


def test_line_ends_and_tabs_are_no_difference(spark):
    found = run(spark, [(1, "one\r\ntwo\r\nthree\r\n"), (2, "\tone\ntwo \n three\nfour")])
    assert [r[1] for r in found] == ["one\r\ntwo\r\nthree\r\n", "four"]


def test_each_hash_of_a_window_tells_lines_apart_by_itself(spark):
    """Two windows that agree in one hash by chance must differ in the other: both are made from the text of the lines."""
    rows = line_windows(spark.createDataFrame([(i, f"a{i}\nb\nc") for i in range(50)], "doc_id long, text string"), "doc_id", "text").collect()
    assert len({r["h1"] for r in rows}) == len({r["h2"] for r in rows}) == 50
    line = spark.sql("SELECT xxhash64('a1') a, xxhash64('b') b, xxhash64('c') c").first()
    again = spark.createDataFrame([tuple(line)], "a long, b long, c long").selectExpr("xxhash64('second', a, b, c) h").first()["h"]
    assert again not in {r["h2"] for r in rows}  # not made from the first kind of line hashes
