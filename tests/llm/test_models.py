"""op1 and op5: held-out accuracy on made-up languages and insults, and odd rows."""

import itertools
import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id as L
from tidemark.llm import toxicity as X
from tidemark.llm.common import bounded_sample, held_out
from tidemark.llm.queries import toxicity_model

SYLLABLES = {"aa": "ka lo mi ru te".split(), "bb": "sch ein ung ach berg".split(), "cc": "éau oir que ment oui".split()}


def made(draw, lang, n):
    return " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(7)
    rows = []
    for i in range(450):
        lang = ("aa", "bb", "cc")[i % 3]
        toxic = int(draw.random() < 0.25)
        words = made(draw, lang, draw.choice([3, 30, 120])).split()
        if toxic:
            for _ in range(draw.randint(2, 5)):
                words.insert(draw.randrange(len(words) + 1), draw.choice(["idiot", "zurfel", "zurfelig", "grobian"]))
        rows.append((i, " ".join(words), lang, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").persist()


def test_held_out_is_a_fifth_by_crc32(spark):
    found = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in found)


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 2).alias("k"))
    a, b = (sorted(r["id"] for r in bounded_sample(rows.repartition(n), "k", "id", 100).collect()) for n in (2, 5))
    assert a == b and 120 < len(a) < 300


def test_language(spark, docs):
    model = L.fit(docs.where(~held_out(F.col("doc_id"))))
    out = L.predict(docs.where(held_out(F.col("doc_id"))), model).collect()
    assert len(out) > 50 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98
    assert not any(r["rejected"] for r in out) and all(0 < r["score"] <= 1 for r in out)
    again = L.fit(docs.where(~held_out(F.col("doc_id"))).repartition(3))
    assert np.array_equal(model.centroids, again.centroids)
    odd = [(1, None), (2, ""), (3, "123 !? 456"), (4, "中文" * 400), (5, "kalomi " * 200_000), (6, "KALOMI rute"), (6, "KALOMI rute")]
    found = [(r["id"], r["lang_pred"], r["rejected"], r["score"]) for r in L.predict(spark.createDataFrame([(*o, 5) for o in odd], "id long, text string, score int"), model).collect()]
    assert [f[:3] for f in found[:3]] == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert found[3][2] and found[4][1] == "aa" and not found[4][2] and found[5] == found[6] and found[5][1] == "aa"
    assert found[4][3] <= 1.0
    empty = L.fit(docs.limit(0))
    assert [(r["lang_pred"], r["rejected"]) for r in L.predict(docs.limit(2), empty).collect()] == [("und", True)] * 2
    assert L.predict(docs.limit(0), model).count() == 0


def test_unlearned_language_of_the_same_script_is_rejected(spark, docs):
    draw = random.Random(11)
    learn = docs.where(~held_out(F.col("doc_id")))
    for left_out in SYLLABLES:
        model = L.fit(learn.where(F.col("lang") != left_out))
        texts = [(lang, n, made(draw, lang, n)) for lang in SYLLABLES for n in (3, 30, 120, 400) for _ in range(25)]
        texts += [("letters", 120, " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(120))) for _ in range(25)]
        out = L.predict(spark.createDataFrame(texts, "lang string, n int, text string"), model).collect()
        far = [r["rejected"] for r in out if r["lang"] in (left_out, "letters") and r["n"] >= 30]
        known = [r["rejected"] for r in out if r["lang"] not in (left_out, "letters")]
        assert np.mean(far) > 0.95 and np.mean(known) < 0.02


def test_blocks_count_as_one_text(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["kalomi rute éau " * 4000, "", "ab", "éau que " * 900])
    (_, _, whole), = L.vectors(texts)
    monkeypatch.setattr(L, "BLOCK_BYTES", 333)  # a block has 1,332 bytes
    for start, end, counts in L.vectors(texts):
        assert np.array_equal(counts, whole[start:end])


def plain_vector(text, idf):
    """n-grams, counts and weights of one text from the formulas, by dictionaries."""
    data = [b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()]
    counts = {}
    for n in (2, 3):
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if any(x != 32 for x in gram):
                value = sum(x << 8 * (n - 1 - j) for j, x in enumerate(gram)) + n
                bucket = value * 2654435761 % 2**32 >> 19
                counts[bucket] = counts.get(bucket, 0) + 1
    weights = {b: (1 + math.log(c)) * (idf[b] if idf is not None else 1.0) for b, c in counts.items()}
    length = math.sqrt(sum(w * w for w in weights.values()))
    return counts, {b: w / length for b, w in weights.items()}


def test_language_against_brute_force(spark):
    """One centroid a language: mean of the normalised TF-IDF vectors; predictions, scores and limits from the formulas."""
    draw = random.Random(17)
    rows = [(i, made(draw, ("aa", "bb", "cc")[i % 3], draw.choice([5, 20, 60])), ("aa", "bb", "cc")[i % 3]) for i in range(90)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), k=1)
    seen = [plain_vector(t, None)[0] for _, t, _ in rows]
    idf = {b: math.log((1 + len(rows)) / (1 + sum(b in c for c in seen))) + 1 for c in seen for b in c}
    assert all(abs(model.idf[b] - w) < 1e-5 for b, w in idf.items())
    vectors = [plain_vector(t, idf)[1] for _, t, _ in rows]
    share = [math.sqrt(min(len(c) / L.FULL_GRAMS, 1)) for c in seen]
    dot = lambda x, y: sum(w * y.get(b, 0.0) for b, w in x.items())
    centroids = {}
    for lang in ("aa", "bb", "cc"):
        total = {}
        for v, (_, _, own) in zip(vectors, rows, strict=True):
            for b, w in v.items() if own == lang else ():
                total[b] = total.get(b, 0.0) + w
        length = math.sqrt(dot(total, total))
        centroids[lang] = {b: w / length for b, w in total.items()}
    assert model.languages == ["aa", "bb", "cc"]
    for lang, row, least in zip(model.languages, model.centroids, model.least, strict=True):
        assert all(abs(row[b] - w) < 1e-5 for b, w in centroids[lang].items())
        reach = [dot(v, centroids[lang]) / s for v, s in zip(vectors, share, strict=True)]
        near = np.quantile([r for r, (_, _, own) in zip(reach, rows, strict=True) if own == lang], 0.01)
        far = np.quantile([r for r, (_, _, own) in zip(reach, rows, strict=True) if own != lang], 0.99)
        assert abs(least - (far + L.BETWEEN * (near - far))) < 1e-4
    for r in L.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect():
        cosines = {x: dot(vectors[r["doc_id"]], c) for x, c in centroids.items()}
        best = max(cosines, key=cosines.get)
        assert r["lang_pred"] == best and abs(r["score"] - cosines[best]) < 1e-5
        assert r["rejected"] == (r["score"] < model.least[model.languages.index(best)] * share[r["doc_id"]])


def test_junk_labels_and_null_ids_do_not_grow_the_model(spark, docs, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 3)
    junk = spark.range(300).selectExpr("id + 10000 AS doc_id", "concat('junk text ', id) AS text", "concat('j', id) AS lang", "0 AS toxic")
    hot = spark.range(200).selectExpr("CAST(NULL AS long) AS doc_id", "'null ids' AS text", "'zz' AS lang", "0 AS toxic")
    same = spark.range(2000).selectExpr("7L AS doc_id", "'kalomi rute te te lo' AS text", "'aa' AS lang", "0 AS toxic")
    learn = docs.unionByName(junk).unionByName(hot).unionByName(same)
    assert set(L.fit(learn).languages) == {"aa", "bb", "cc"}
    assert L.counted_sample(same, "doc_id", "text", "lang", 400).count() <= 1
    found = spark.createDataFrame([(None,), (3,)], "doc_id long").select(held_out(F.col("doc_id")).alias("h")).collect()
    assert found[0]["h"] is True and found[1]["h"] is not None


def test_toxicity(spark, docs):
    labels = docs.select("doc_id", "toxic")
    model = toxicity_model(docs.select("doc_id", "text"), labels.unionByName(labels.limit(3)))
    out = X.predict(docs.where(held_out(F.col("doc_id"))), model).collect()
    assert np.mean([r["toxic"] == r["predicted"] for r in out]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in out)
    odd = [(1, None), (2, ""), (3, "kalo " * 300_000), (4, "IDIOT zurfel, zurfelig! grobian"), (4, "IDIOT zurfel, zurfelig! grobian")]
    found = X.predict(spark.createDataFrame([(*o, 1) for o in odd], "id long, text string, predicted int"), model).collect()
    assert [r["predicted"] for r in found] == [0, 0, 0, 1, 1] and found[0]["score"] == found[1]["score"]
    assert X.predict(docs.limit(0), model).count() == 0


def test_only_equal_texts_of_one_label_are_merged(spark):
    draw = random.Random(14)
    words = made(draw, "aa", 400).split()
    texts = [" ".join(draw.sample(words, 400)) for _ in range(20)]  # one word set, so one least hash of each kind
    rows = [(f"{i:02}", t, i % 2) for i, t in enumerate(texts)] + [("90", texts[3].upper() + "!", 1), ("91", texts[3], 0)]
    kept = X.without_copies(spark.createDataFrame(rows, "key string, text string, label int")).collect()
    assert sorted(r["key"] for r in kept) == [*(f"{i:02}" for i in range(20)), "91"]


def test_toxicity_without_labels(spark, docs):
    alone = X.fit(docs.where("doc_id < 0"), docs.where("doc_id < 0"))
    out = X.predict(spark.createDataFrame([("you stupid idiot, pathetic loser",), ("kalo mi",)], "text string"), alone).collect()
    assert [r["predicted"] for r in out] == [1, 0]


def test_label_model_finds_the_good_voters():
    draw = np.random.default_rng(0)
    y = draw.random(4000) < 0.3
    right = lambda p: np.where(draw.random(4000) < p, y, ~y)
    good = [np.where(right(0.9), 1, -1) for _ in range(4)]
    poor = np.where(right(0.52), 1, -1)
    v = np.stack([*good, poor, poor, poor], 1)  # three that repeat each other must not outvote the good ones
    model = X.label_model(v, X.by_majority(v))
    assert np.mean((model.posterior(v) > 0.5) == y) > 0.95 and abs(model.prior - 0.3) < 0.03
    for j in range(4):  # the accuracies that are estimated without any label
        found = np.einsum("ac,a->c", model.tables[j][:, 2], np.bincount(v[:, model.parents[j]] + 1, minlength=3) / len(v)) if model.parents[j] >= 0 else model.tables[j][0, 2]
        assert abs(found[1] - 0.9) < 0.06 and abs(found[0] - 0.1) < 0.06
    repeated = {(min(j, k), max(j, k)) for j, k in enumerate(model.parents.tolist()) if j >= 4 and k >= 4}
    assert len(repeated) == 2  # the correlated voters hang together in the tree


def test_label_model_against_brute_force():
    """Tables from weighted counts, the best of all trees, and the posterior by Bayes' rule over all votes."""
    draw = np.random.default_rng(3)
    v = draw.integers(-1, 2, size=(60, 4))
    v[:, 3] = np.where(draw.random(60) < 0.8, v[:, 1], v[:, 3])
    p = draw.random(60)
    pairs = X._pair_counts(v, p)
    assert pairs[1, 2, 3, 0, 1] == pytest.approx(sum(p[i] for i in range(60) if v[i, 1] == 1 and v[i, 3] == -1))

    def information(j, k):
        out = 0.0
        for w in (1 - p, p):
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    both, one, two = w[(v[:, j] == a) & (v[:, k] == b)].sum(), w[v[:, j] == a].sum(), w[v[:, k] == b].sum()
                    out += both * math.log(both * w.sum() / (one * two)) if both else 0.0
        return out

    trees = [t for t in itertools.product(range(4), repeat=3) if all(_rooted(t, j) for j in (1, 2, 3))]
    best = max(sum(information(j + 1, k) for j, k in enumerate(t)) for t in trees)
    parents = X.dependency_tree(pairs)
    assert parents[0] == -1 and sum(information(j, int(parents[j])) for j in (1, 2, 3)) == pytest.approx(best)
    model = X.estimated(pairs, parents, smoothing=2.0)
    for row in itertools.product((-1, 0, 1), repeat=4):
        joint = []
        for c, w in enumerate((1 - p, p)):
            value = (w.sum() + 1) / (60 + 2)
            for j, k in enumerate(parents.tolist()):
                own = (w[v[:, j] == row[j]].sum() + 0.5) / (w.sum() + 1.5)
                given = v[:, k] == row[k] if k >= 0 else np.zeros(60, bool)
                value *= (w[given & (v[:, j] == row[j])].sum() + 2 * own) / (w[given].sum() + 2)
            joint.append(value)
        assert model.posterior(np.array([row]))[0] == pytest.approx(joint[1] / sum(joint))


def _rooted(tree, j):
    seen = set()
    while j and j not in seen:
        seen.add(j)
        j = tree[j - 1]
    return j == 0


def test_likelihood_does_not_fall():
    draw = np.random.default_rng(4)
    y = draw.random(800) < 0.4
    v = np.stack([np.where(draw.random(800) < 0.25, 0, np.where((draw.random(800) < 0.8) == y, 1, -1)) for _ in range(6)], 1)
    p, before = X.by_majority(v), -np.inf
    parents = X.dependency_tree(X._pair_counts(v, p))
    for _ in range(25):
        model = X.estimated(X._pair_counts(v, p), parents, smoothing=1e-6)
        now = np.logaddexp(*model.log_likelihoods(v).T).sum()
        assert now >= before - 1.0  # the half that is added to counts is no part of the likelihood
        before, p = now, model.posterior(v)


def test_every_telling_term_is_a_lexicon_word(spark):
    """More terms than any former limit, and capitals anywhere in a text."""
    rows = [(f"{i}", " ".join(f"bad{k:05}x" for k in range(9000)) if i % 2 else "fine words here", i % 2) for i in range(60)]
    found = X.induced_lexicon(spark.createDataFrame(rows, "key string, text string, label int"))
    assert sum(t.startswith("w:") for t in found) == 9000
    assert X._mean_upper("a" * 5000 + "B" * 6000) > 0.5 and X._mean_upper("1 2") == 0


def test_one_id_counts_once(spark, docs):
    hot = spark.range(3000).selectExpr("7L AS doc_id", "concat('kalo mi ', id) AS text", "'aa' AS lang", "0 AS toxic")
    labels = docs.select("doc_id", "toxic").unionByName(hot.select("doc_id", "toxic"))
    model = toxicity_model(docs.unionByName(hot).select("doc_id", "text"), labels)
    out = X.predict(docs.where(held_out(F.col("doc_id"))), model).collect()
    assert np.mean([r["toxic"] == r["predicted"] for r in out]) > 0.97


def test_word_hashes_do_not_depend_on_the_place():
    import pyarrow as pa

    found = {}
    for texts in (["one two"], ["x one two"], ["zz", "two", "one"]):
        for _, _, row, bucket in X.features(pa.array(texts)):
            for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
                found.setdefault((tuple(texts), r), set()).add(b)
    assert found[("one two",), 0] <= found[("x one two",), 0]
    assert found[("zz", "two", "one"), 1] | found[("zz", "two", "one"), 2] == found[("one two",), 0]


@pytest.mark.parametrize("text", ["kalo" * 1500, "中文字" * 700 + " tail " + "漢" * 900, "ab " * 500 + "x" * 3000 + "!" + "y" * 5, "z" * 1024, "z" * 1025 + " "])
def test_features_do_not_depend_on_blocks(monkeypatch, text):
    """Words longer than a block have the features that they have in one block."""
    of = lambda: [tuple(x.tolist() for x in f[2:]) for f in X.features(pa.array(["before", text, "after"]))]
    whole = set()
    for rows, buckets in of():
        whole |= set(zip(rows, buckets, strict=True))
    for size in (1, 4, 16, 64, 256):
        monkeypatch.setattr(X, "BLOCK_BYTES", size)
        found = set()
        for start, _, row, bucket in X.features(pa.array(["before", text, "after"])):
            found |= {(start + r, b) for r, b in zip(row.tolist(), bucket.tolist(), strict=True)}
        assert found == whole


def test_a_long_word_takes_linear_time(monkeypatch):
    monkeypatch.setattr(X, "BLOCK_BYTES", 1 << 14)
    began = time.perf_counter()
    assert sum(len(f[3]) for f in X.features(pa.array(["漢" * 2_000_000]))) == 4
    assert time.perf_counter() - began < 10
