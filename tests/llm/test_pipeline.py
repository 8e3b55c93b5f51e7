"""The stages in order against brute force, and components."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_line_dedup import brute
from tidemark.llm import components, simhash
from tidemark.llm.components import connected_components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5)] + [(2000, 2000 + i) for i in range(1, 50)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    wanted = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len(wanted) and {r["node"]: r["component"] for r in rows} == wanted
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_settled_components_take_one_round(spark, monkeypatch):
    """Nodes linked to their component's least are a result already; a round costs the driver plans, threads and compiled code."""
    rounds, plain = [], components._star
    monkeypatch.setattr(components, "_star", lambda edges, large: (rounds.append(large), plain(edges, large))[1])
    settled = [(i, i - i % 10) for i in range(100) if i % 10]
    rows = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(settled, "a long, b long")).collect()}
    assert rows == {i: i - i % 10 for i in range(100)} and rounds == [True, False]
    rounds.clear()
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0 and rounds == [True, False]


def test_no_join_of_small_tables_is_broadcast(spark):
    """A broadcast's table is built in the driver and stays there until its garbage is collected."""
    edges = components.checkpointed(spark.createDataFrame([(i + 1, i) for i in range(50)], "a long, b long"))
    marked = components.checkpointed(spark.createDataFrame([(i, 0, i % 7 << 20) for i in range(50)], "id long, word int, fp long"))
    for made in (components._star(edges, large=True), components._star(edges, large=False), simhash.candidate_pairs(marked)):
        assert len(made.collect()) > 0
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(2)
    top = tmp_path_factory.mktemp("corpus")
    vocabulary = ["".join(draw.choice(["ka", "lo", "mi", "ru", "te", "so"]) for _ in range(3)) for _ in range(150)]
    line = lambda: " ".join(draw.choice(vocabulary) for _ in range(12))
    rows, labels = [], []
    for i in range(160):
        text = "\n".join(line() for _ in range(draw.choice([1, 2, 6])))
        toxic = int(i % 8 == 0)
        rows.append((i, text + (" stupid idiot, pathetic moron" if toxic else ""), "xx", f"s{i % 4}", 0))
        labels.append((i, 1, toxic))
    passage = "\n".join(line() for _ in range(5))
    rows += [(200 + k, f"{line()}\n{passage}\n{line()}", "xx", "s1", 0) for k in range(4)]
    rows += [(300, rows[9][1], "xx", "s2", 0), (301, rows[10][1].replace(rows[10][1].split()[-1], "another"), "xx", "s2", 0), (400, None, None, None, None), (401, "", "xx", None, 0), (402, "123", "xx", "s", 3)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert sorted(out.columns) == sorted(docs.columns)
        kept.append([r.asDict() for r in out.collect()])
        docs = out
    first, second, third, fourth, fifth = kept
    assert {400, 401, 402}.isdisjoint(r["doc_id"] for r in first) and len(first) == 166
    assert {r["doc_id"] for r in first} - {r["doc_id"] for r in second} == {i for i in range(0, 160, 8)}
    lines = brute([(r["doc_id"], r["text"]) for r in second])
    assert {r["doc_id"]: r["text"] for r in third} == {i: t for i, (t, _) in lines.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in third)
    by_text = {}
    for r in third:
        by_text.setdefault(r["text"], []).append(r["doc_id"])
    left = {r["doc_id"] for r in fourth}
    assert left <= {min(ids) for ids in by_text.values()} and {min(ids) for ids in by_text.values()} - left <= {301}
    assert {r["doc_id"] for r in fifth} == left
    again = sorted(map(str, (r.asDict() for r in corpus_pipeline.run(spark, folder).collect())))
    assert again == sorted(map(str, fifth))
    assert corpus_pipeline.STAGES[3][1](spark, spark.createDataFrame([(None, "a", "xx", "s", 1), (1, "a", "xx", "s", 1), (1, "a", "xx", "s", 1)], COLUMNS), folder).count() == 1


def test_empty_table_and_clashing_columns(spark, folder):
    """Every stage on no rows; and the extra columns that stages name their results by keep their values."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)
    extra = {c: F.lit(f"own {c}") for c in ("score", "rejected", "predicted", "lang_pred", "n_lines", "n_removed", "fps", "piece")}
    more = docs.withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, more, folder)
        if name != "packing":
            assert out.columns == more.columns
            row = out.where("doc_id = 9").first().asDict()
            assert all(row[c] == f"own {c}" for c in extra)
            assert sorted(r["doc_id"] or -1 for r in out.collect()) == sorted(r["doc_id"] or -1 for r in stage(spark, docs, folder).collect())


def test_near_copies_against_brute_force(spark, folder):
    """Groups by equal sets or an exact Jaccard similarity of 0.8 over five-word shingles; the least id of each stays."""
    draw = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(60):
        text = [draw.choice(words) for _ in range(draw.choice([3, 40, 120]))]
        rows.append(text)
        for _ in range(draw.choice([0, 0, 1, 2])):
            text = list(text)
            for _ in range(draw.choice([0, 1, 3, 6])):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append(text)
    shingles = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    frame = spark.createDataFrame([(i, " ".join(w), "xx", "s", 1) for i, w in enumerate(rows)], COLUMNS)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, frame, folder).collect()}
    assert kept == set(group) and len(kept) < len(rows)
