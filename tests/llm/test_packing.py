"""op9: nothing lost, nothing too full, no conflicts, and always the tightest bin that fits."""

import random

from pyspark.sql import functions as F

from tidemark.llm import packing
from tidemark.llm.packing import cluster_of, pack, place, words


def brute(pieces, capacity):
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [(b["free"], i) for i, b in enumerate(bins) if b["free"] >= length and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"free": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["free"]))
        bins[i]["free"] -= length
        bins[i]["s"] |= {source} - {None}
        bins[i]["c"] |= {cluster} - {None}
    return out


def test_place_is_best_fit():
    draw = random.Random(1)
    for _ in range(30):
        pieces = sorted(((draw.randint(0, 100), draw.choice(["a", "b", "c", None]), draw.choice([1, 2, 3, 4, None])) for _ in range(80)), key=lambda p: -p[0])
        assert place(pieces, 100) == brute(pieces, 100)


def test_pack(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice([draw.randint(0, 60), draw.randint(0, 300)]), draw.choice(["hot", "hot", "x", "y", None]), draw.choice([7, 7, None, i])) for i in range(400)]
    rows += [(1000, None, "x", None), (1001, 0, None, None), (1002, 10_000, "z", 5), (None, 5, "q", 1), (3, 50, "x", 9), (3, 50, "x", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, n int, source string, c long").withColumn("piece", F.lit("clash"))
    out = pack(docs, "doc_id", F.col("n"), F.col("source"), F.col("c"), capacity=100, group_rows=100).collect()
    assert len({r["bin_id"] >> 32 for r in out}) > 3
    total = {}
    for r in out:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    wanted = {}
    for i, n, _, _ in rows:
        wanted[i] = wanted.get(i, 0) + (n or 0)
    assert total == wanted
    bins = {}
    for r in out:
        bins.setdefault(r["bin_id"], []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: (r["bin_offset"], r["length"]))
        assert sum(r["length"] for r in held) <= 100
        ends = 0
        for r in held:
            assert r["bin_offset"] >= ends or r["length"] == 0
            ends = r["bin_offset"] + r["length"]
    unique = {i: (s, c) for i, _, s, c in rows if i not in (3,)}
    for held in bins.values():
        for k in (0, 1):
            seen = [unique[r["doc_id"]][k] for r in held if r["doc_id"] in unique and unique[r["doc_id"]][k] is not None]
            assert len(seen) == len(set(seen))
    assert sum(r["length"] for r in out if r["doc_id"] == 1002) == 10_000


def test_empty_and_words(spark):
    docs = spark.createDataFrame([], "doc_id long, n int, source string")
    assert pack(docs, "doc_id", F.col("n"), F.col("source"), F.lit(None).cast("string")).count() == 0
    counted = spark.createDataFrame([("a  b\nc",), ("",), (None,), ("é \t ü ",)], "t string").select(words(F.col("t")).alias("n"))
    assert [r["n"] for r in counted.collect()] == [3, 0, 0, 2]


def test_groups_are_packed_as_brute_force_packs_them(spark):
    draw = random.Random(4)
    rows = [(i, draw.randint(0, 150), draw.choice(["hot", "x", None]), draw.choice([1, 2, None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, n int, source string, c long")
    out = pack(docs, "doc_id", F.col("n"), F.col("source"), F.col("c"), capacity=100, group_rows=64).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["bin_id"] >> 32, []).append(r)
    assert len(groups) > 4
    for held in groups.values():
        held.sort(key=lambda r: (-r["length"], r["doc_id"], r["piece"]))
        assert brute([(r["length"], *rows[r["doc_id"]][2:]) for r in held], 100) == [(r["bin_id"] & 0xFFFFFFFF, r["bin_offset"]) for r in held]


def test_repeated_and_null_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(packing, "STEP", 7)
    rows = [(None, 30, "s", 1)] * 400 + [(5, 30, "s", 2)] * 400 + [(6, 4000, "t", None)]
    out = pack(spark.createDataFrame(rows, "doc_id long, n int, source string, c long"), "doc_id", F.col("n"), F.col("source"), F.col("c"), capacity=100, group_rows=50).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(["None"] * 400 + ["5"] * 400 + ["6"] * 40)
    assert sorted(r["start"] for r in out if r["doc_id"] == 6) == list(range(0, 4000, 100))
    sizes = {}
    for r in out:
        sizes[r["bin_id"] >> 32] = sizes.get(r["bin_id"] >> 32, 0) + 1
    assert max(sizes.values()) < 110


def test_null_texts_conflict_with_nothing(spark):
    docs = spark.createDataFrame([(i, None, None) for i in range(20)] + [(30 + i, "a", None) for i in range(3)], "doc_id long, text string, source string")
    out = pack(docs, "doc_id", F.lit(10), F.col("source"), cluster_of(F.col("text")), capacity=1000).collect()
    bins = {}
    for r in out:
        bins.setdefault(r["bin_id"], []).append(r["doc_id"])
    assert len(bins) == 3 and max(map(len, bins.values())) == 21


def test_large_ids_beside_null_ids(spark):
    """Ids over 2^53 that differ in their last bits, text ids, and sources that are null or empty, all in one group."""
    big = [(1 << 60) + 1, (1 << 60) + 3, (1 << 53) + 1, -(1 << 62) - 1, None, 0]
    rows = [(i, n, s, c) for i in big for n, s, c in ((10, "s", (1 << 61) + 1), (10, None, None), (10, "", (1 << 61) + 3), (250, "t", None))]
    docs = spark.createDataFrame(rows, "doc_id long, n int, source string, c long")
    out = [tuple(r) for r in pack(docs, "doc_id", F.col("n"), F.col("source"), F.col("c"), capacity=100).collect()]
    found = {}
    for r in out:
        found[r[0]] = found.get(r[0], 0) + r[3]
    assert found == dict.fromkeys(big, 280)
    again = pack(docs.repartition(7), "doc_id", F.col("n"), F.col("source"), F.col("c"), capacity=100).collect()
    assert sorted(map(str, again)) == sorted(map(str, pack(docs.coalesce(1), "doc_id", F.col("n"), F.col("source"), F.col("c"), capacity=100).collect()))
    named = spark.createDataFrame([(None, 5), ("b", 5), ("a", 5)], "name string, n int")
    assert {r["name"] for r in pack(named, "name", F.col("n"), F.lit(None).cast("string"), F.lit(None).cast("string")).collect()} == {None, "a", "b"}
