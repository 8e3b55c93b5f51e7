"""op7 against brute force; splitting of dense keys; near-duplicates of the pipeline's stage."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash as S


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if ones[i] * 2 > len(shingles))


def groups(prints, ids):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        least[root(k)] = min(least.get(root(k), i), i)
    return [least[root(k)] for k in range(len(ids))]


def texts(n=150, seed=3):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6)))
    out = [" ".join(word() for _ in range(draw.choice([1, 2, 5, 60, 200]))) for _ in range(n)]
    for t in out[:40]:
        words = t.split()
        words[draw.randrange(len(words))] = "changed"
        out += [" ".join(words), t.upper()]
    return out


def test_against_brute_force(spark):
    rows = list(enumerate([*texts(), None, "", " \t\n\x0b\x0c\r", "One two", "one\x85two", "w " * 30_000]))
    rows += [rows[0], (999, rows[5][1])]
    out = S.group(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")).select("doc_id", S.as_hex(F.col("fp")).alias("h"), "component_id").collect()
    assert len(out) == len(rows)
    prints = {i: plain(t) for i, t in rows}
    assert {r["doc_id"]: r["h"] for r in out} == {i: f"{p:016x}" for i, p in prints.items()}
    ids = sorted(prints)
    assert {r["doc_id"]: r["component_id"] for r in out} == dict(zip(ids, groups([prints[i] for i in ids], ids), strict=True))
    assert S.group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dense_keys_lose_no_pair(spark):
    draw = random.Random(8)
    base = draw.getrandbits(64)
    near = {base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for _ in range(150)} | {draw.getrandbits(64) for _ in range(60)} | {base ^ x for x in range(40)}
    prints = sorted(near)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    wanted = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & 0xFFFFFFFFFFFFFFFF).count("1") <= 3}
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for dense in (4, 10_000):
        assert {tuple(r) for r in S.linked_pairs(frame, dense).collect()} == wanted


def test_near_duplicates(spark):
    draw = random.Random(6)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(800)]
    own = [[draw.choice(vocabulary) for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(own)]
    for i, w in enumerate(own[:20]):
        changed = list(w)
        changed[50], changed[51] = "new", "words"
        rows += [(100 + i, " ".join(changed)), (200 + i, " ".join(w))]
    far = [[draw.choice(vocabulary) if k % 5 == 0 else x for k, x in enumerate(w)] for w in own[:5]]  # every fifth word differs
    rows += [(300 + i, " ".join(w)) for i, w in enumerate(far)] + [(400, None), (401, ""), (402, "a b")]
    found = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[200 + i] == i for i in range(20))
    assert sum(found[100 + i] == i for i in range(20)) >= 18
    assert all(found[300 + i] == 300 + i for i in range(5)) and found[402] == 402
    assert {i for i in range(30) if found[i] == i} == set(range(30))


def test_rows_that_the_first_comparisons_leave_open(spark):
    draw = random.Random(9)
    base = draw.getrandbits(64)
    prints = [base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for _ in range(120)] + [base] * 9 + [draw.getrandbits(64) for _ in range(20)]
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    rows = [(i, i % 2, p, i if i % 3 == 0 else i % 4) for i, p in enumerate(signed)]
    banded = [(i, band, draw.randrange(12), i if i % 3 == 0 else i % 4) for i in range(60) for band in range(3)]
    close = {(a[0], b[0]) for a in rows for b in rows if a[0] > b[0] and a[1] == b[1] and a[3] != b[3] and bin((a[2] ^ b[2]) & 0xFFFFFFFFFFFFFFFF).count("1") <= 3}
    close |= {(a[0], b[0]) for a in banded for b in banded if a[0] > b[0] and a[1:3] == b[1:3] and a[3] != b[3]}
    marked, bands = spark.createDataFrame(rows, "id long, word int, fp long, component long"), spark.createDataFrame(banded, "id long, band int, h long, component long")
    first = {tuple(r) for r in S.candidate_pairs(marked.drop("component"), few=4).unionByName(S.band_pairs(bands.drop("component"))).collect()}
    left = {r["id"] for r in S.undecided(marked, bands, few=4).collect()}
    assert all({a, b} <= left for a, b in close - first) and close - first


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_prefix_filter_loses_no_pair(spark, least):
    draw = random.Random(10)
    common = [draw.getrandbits(62) for _ in range(60)]
    sets = [set(draw.sample(common, draw.randint(1, 60))) | {draw.getrandbits(62) for _ in range(draw.randint(0, 6))} for _ in range(120)]
    sets += [set(common) - set(draw.sample(common, draw.randint(0, 5))) | {draw.getrandbits(62) for _ in range(draw.randint(0, 6))} for _ in range(60)] + [{common[0]}, {common[0]}, {1}, {2}]
    rows = [(i, i % 3 if i < 100 else i, sorted(s)) for i, s in enumerate(sets)]
    wanted = {(a, b) for a, ca, _ in rows for b, cb, _ in rows if a > b and ca != cb and jaccard(sets[a], sets[b]) >= least}
    frame = spark.createDataFrame(rows, "id long, component long, s array<long>")
    found = S.prefix_pairs(frame, least)
    assert wanted and wanted <= {tuple(r) for r in found.collect()}
    assert {tuple(r) for r in S.similar(found, frame, least).collect()} == wanted


def test_a_common_passage_makes_no_pairs(spark):
    """300 texts that share a passage of half their length, and a group of near copies: candidates stay few."""
    draw = random.Random(11)
    passage, body = [draw.getrandbits(62) for _ in range(50)], [draw.getrandbits(62) for _ in range(100)]
    sets = [passage + [draw.getrandbits(62) for _ in range(50)] for _ in range(300)] + [body[15:] + [draw.getrandbits(62) for _ in range(15)] for _ in range(300)]
    frame = spark.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "id long, component long, s array<long>")
    assert S.prefix_pairs(frame, 0.8).count() == 0


def test_near_duplicates_with_block_edits(spark):
    draw = random.Random(12)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    some = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    edits = {
        "replaced": lambda w: w[: len(w) - len(w) * 9 // 100] + some(len(w) * 9 // 100),
        "middle": lambda w: w[: len(w) // 2] + some(len(w) * 8 // 100) + w[len(w) // 2 + len(w) * 8 // 100 :],
        "appended": lambda w: w + some(len(w) // 5),
        "cut": lambda w: w[: len(w) - len(w) // 6],
    }
    rows, wanted = [], {}
    for n in (60, 200, 1000):
        for kind, edit in edits.items():
            for _ in range(15):
                own = some(n)
                for words in (own, edit(own)):
                    rows.append((len(rows), " ".join(words)))
                a, b = (set(map(tuple, (x[i : i + 5] for i in range(len(x) - 4)))) for x in (rows[-2][1].split(), rows[-1][1].split()))
                if len(a & b) >= 0.8 * len(a | b):
                    wanted.setdefault((kind, n), []).append(rows[-2][0])
    found = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {kind for kind, _ in wanted} == set(edits) and sum(map(len, wanted.values())) > 140
    recall = {k: sum(found[i + 1] == i for i in ids) / len(ids) for k, ids in wanted.items()}
    assert min(recall.values()) >= 0.9 and sum(found[i + 1] == i for ids in wanted.values() for i in ids) >= 0.98 * sum(map(len, wanted.values()))


@pytest.fixture(scope="module")
def odd_rows():
    draw = random.Random(15)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    texts = [" ".join(word() for _ in range(60)) for _ in range(6)]
    near = lambda t: t + " " + word()
    # One id with two texts, null ids (a text of their own and a copy), null, empty and wordless texts, repeated rows.
    return [(1, texts[0], "x"), (1, texts[1], "x"), (2, near(texts[1]), "x"), (None, texts[2], "x"), (None, texts[3], "x"), (3, near(texts[3]), "x"), (4, None, "x"), (5, "", None), (6, " \t", "x"), (7, texts[4], "x"), (7, texts[4], "x"), (None, texts[2], "y")]


def test_ids_and_texts_that_repeat(spark, odd_rows):
    frame = spark.createDataFrame(odd_rows, "doc_id long, text string, fps string")
    kept = S.without_near_duplicates(frame)
    assert kept.columns == frame.columns
    texts = [t for _, t, _ in odd_rows]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(1, texts[0]), (1, texts[1]), (None, texts[3]), (3, texts[5]), (4, None), (7, texts[9])], key=str)
    groups = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(frame).collect()), key=str)
    assert groups == sorted([(1, 1), (1, 1), (2, 1), (None, None), (None, 3), (3, 3), (4, 4), (5, 4), (6, 4), (7, 7), (7, 7), (None, None)], key=str)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.without_near_duplicates(empty).count() == 0 and S.near_duplicates(empty).count() == 0


def test_null_ids_are_linked(spark):
    rows = [(None, "same words here"), (5, "same words here"), (None, "other things there"), (9, None), (None, "")]
    found = sorted(((r["doc_id"], r["component_id"]) for r in S.group(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert found == sorted([(None, 5), (5, 5), (None, None), (9, 9), (None, 9)], key=str)


def test_recall_by_similarity(spark):
    """At least 1,000 pairs of texts with scattered changes, by the band of their exact similarity."""
    draw = random.Random(16)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows, wanted = [], {}
    shingles = lambda w: set(map(tuple, (w[i : i + 5] for i in range(len(w) - 4))))
    while sum(map(len, wanted.values())) < 1000:
        words = [draw.choice(vocabulary) for _ in range(draw.choice([80, 200, 500]))]
        changed = list(words)
        for _ in range(draw.randint(1, len(words) // 40)):
            changed[draw.randrange(len(words))] = draw.choice(vocabulary)
        j = jaccard(shingles(words), shingles(changed))
        if 0.8 <= j < 1:
            wanted.setdefault(int(j * 20) / 20, []).append(len(rows))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(changed))]
    found = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {band: sum(found[i + 1] == i for i in ids) / len(ids) for band, ids in wanted.items()}
    assert min(recall.values()) >= 0.99, {b: (r, len(wanted[b])) for b, r in recall.items()}
