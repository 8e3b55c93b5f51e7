"""op3 against brute force, with small blocks so that cells are cut."""

import numpy as np
import pytest

from tidemark.llm import embedding_dedup as E


def brute(rows):
    ids = [i for i, _ in rows]
    good = [k for k, (i, v) in enumerate(rows) if i is not None and v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = E.unit(np.array([rows[a][1]]))[0], E.unit(np.array([rows[b][1]]))[0]
                if x @ y >= 0.95:
                    n[a] += 1
                    n[b] += 1
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(ids[k])
    return sorted(((ids[k], n[k], min(groups[root(k)]) if ids[k] is not None else None) for k in range(len(rows))), key=str)


def run(spark, rows, **kw):
    out = E.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), **kw).collect()
    for r in out:
        assert r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"])
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)


@pytest.mark.parametrize("block_bytes", [7 * 32, E.BLOCK_BYTES])
def test_against_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(E, "CELLS_AT_ONCE", 300)  # a batch is looked at in parts
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(120)]  # four dimensions: long chains of links
    centre = draw.normal(size=4)
    rows += [(200 + i, (centre + draw.normal(size=4) * 0.02).tolist()) for i in range(60)]
    rows += [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(5)] + [(310, [2.0, 4.0, 6.0, 8.0]), (311, [1e200, 2e200, 3e200, 4e200])]
    rows += [(400, None), (401, []), (402, [0.0] * 4), (403, [float("nan"), 1.0, 1.0, 1.0]), (404, [float("inf"), 1.0, 1.0, 1.0]), (405, [1.0, None, 1.0, 1.0]), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (None, [1.0, 2.0, 3.0, 4.0])]
    assert run(spark, [(*r, 1) for r in rows], block_bytes=block_bytes) == brute(rows)


def test_repeated_rows_and_empty(spark):
    assert run(spark, [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)]) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]
    assert run(spark, []) == []


def test_clusters_meet_in_few_regions(spark):
    """500 vectors of 64 dimensions in 20 clusters: several cells, most pairs left out, the links those of brute force."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(20, 64))
    rows = [(i, (centres[i % 20] + draw.normal(size=64) * 0.2).tolist(), 1) for i in range(500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = E.pruned(frame).first()
    assert found["classes"] == 500 and found["share"] > 0.5 and found["moved"] < 500 * 2 * E.BLOCKS
    assert run(spark, rows) == brute([r[:2] for r in rows])


def test_rows_moved_grow_as_the_vectors(spark):
    """Without clusters little is pruned: a vector moves to about as many groups as there are blocks, eight for both larger sizes."""
    draw = np.random.default_rng(6)
    moved = {}
    for n in (400, 1000, 5000):
        frame = spark.createDataFrame([(i, x) for i, x in enumerate(draw.normal(size=(n, 64)).tolist())], "vec_id long, embedding array<double>")
        moved[n] = E.pruned(frame).first()["moved"]
        assert moved[n] <= (E.BLOCKS + 2) * n
    assert moved[5000] <= 5.5 * moved[1000]


def test_parts_of_a_batch(monkeypatch):
    """Slices of an Arrow column give their own vectors."""
    x = np.random.default_rng(8).normal(size=(50, 3))
    codes = E._codes(x)
    for lo, n in ((0, 50), (7, 5), (49, 1), (20, 0)):
        assert np.allclose(E._matrix(codes.slice(lo, n), 3), E.unit(x[lo : lo + n]) if n else np.zeros((0, 3)))


def test_a_hot_cluster_is_compared_with_little_else(spark):
    """A third of the vectors in one dense cluster: the rest isn't sent to it, though it is nearest to the cluster's pivots for some."""
    draw = np.random.default_rng(7)
    centre = draw.normal(size=64)
    rows = [(i, (centre + draw.normal(size=64) * 0.1 if i % 3 == 0 else draw.normal(size=64)).tolist(), 1) for i in range(600)]
    found = E.pruned(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).first()
    assert found["share"] > 0.3
    assert run(spark, rows) == brute([r[:2] for r in rows])
