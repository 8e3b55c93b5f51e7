"""op8: span hashes and extensions against the spans, likeness against plain strings, edits, order and ranges."""

import hashlib
import random
import resource

import numpy as np
import pytest

from tidemark.llm import fingerprint as P


def plain_hash(span, prime, base):
    return sum((ord(c) + 1) * pow(base, k, prime) for k, c in enumerate(span)) % prime


def plain_mix(h):
    h = h * 0x9E3779B97F4A7C15 % 2**64
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return h ^ h >> 32


def anchors(text):
    spans = [text[i : i + P.SPAN] for i in range(len(text) - P.SPAN + 1)]
    return [(i, s) for i, s in enumerate(spans) if plain_mix(plain_hash(s, P.PRIMES[0], P.BASES[0])) % P.ONE_IN == 0]


def plain_print(text):
    both = lambda s: plain_hash(s, P.PRIMES[0], P.BASES[0]) << 31 | plain_hash(s, P.PRIMES[1], P.BASES[1])
    sketch = sorted({plain_mix(both(s)) >> 32 for _, s in anchors(text)})[: P.KEPT]
    return f"{len(text):x}-{both(text):016x}-" + "".join(f"{x:08x}" for x in sketch)


def agree(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def common(a, b, b_from=0):
    """Places of a and of b[b_from:] that the anchors' common spans cover."""
    part = b[b_from:]
    of_a, of_b = anchors(a), [(i, s) for i, s in anchors(part)]
    in_a, in_b = set(), set()
    for here, there, own in ((of_a, of_b, True), (of_b, of_a, False)):
        for i, s in here:
            j = next((j for j, t in there if t == s), None)
            if j is not None:
                x, y = (i, j) if own else (j, i)
                back, on = agree(a[:x][::-1], part[:y][::-1]), agree(a[x:], part[y:])
                if own:
                    in_a |= set(range(x - back, x + on))
                else:
                    in_b |= {b_from + k for k in range(y - back, y + on)}
    return in_a, in_b


def plain_next(a, b):
    if a == b:
        return 1.0
    in_a, in_b = common(a, b)
    head, tail = agree(a, b), agree(a[::-1], b[::-1])
    in_a |= set(range(head)) | set(range(len(a) - tail, len(a)))
    in_b |= set(range(head)) | set(range(len(b) - tail, len(b)))
    return (len(in_a) + len(in_b)) / (len(a) + len(b))


def plain_edited(a, b):
    keep = len(a) - len(a) // 2
    edited = a[:keep] + b[: len(a) // 2]
    if a == edited:
        return 1.0
    in_a, in_e = common(a, edited, keep)
    head, tail = agree(a, edited), min(agree(a[::-1], edited[::-1]), len(edited) - keep)
    in_a |= set(range(head)) | set(range(len(a) - tail, len(a)))
    in_e |= set(range(head)) | set(range(len(edited) - tail, len(edited)))
    return (len(in_a) + len(in_e)) / (len(a) + len(edited))


def made(n=60, seed=3):
    draw = random.Random(seed)
    passages = ["".join(draw.choice("abcdeé ") for _ in range(60)) for _ in range(3)]
    out = []
    for _ in range(n):
        text = "".join(draw.choice("abcé \U0001f600") for _ in range(draw.choice([0, 1, 2, 11, 12, 13, 25, 90, 300])))
        for _ in range(draw.choice([0, 0, 1, 3])):
            at = draw.randrange(len(text) + 1)
            text = text[:at] + draw.choice(passages) + text[at:]
        out.append(draw.choice([text, text, text * 2, out[-1] if out else text, (out[-1] if out else text) + " end"]))
    return [*out, "a" * 500, "a" * 333, "ab" * 200]


def test_spans_and_extensions(monkeypatch):
    draw = random.Random(1)
    text = "".join(draw.choice("abé\U0001f600") for _ in range(300))
    text += text[100:200] + "".join(draw.choice("ab") for _ in range(100))
    x, n = P.PrefixHash(text), len(text)
    a = np.array([draw.randrange(n) for _ in range(400)])
    b = np.array([draw.randrange(i, n) for i in a.tolist()])
    length = np.array([draw.randrange(1 + min(6, n - j)) for j in b.tolist()])
    assert x.equal(a, b, length).tolist() == [text[i : i + k] == text[j : j + k] for i, j, k in zip(a, b, length, strict=True)]
    assert x.common_extension(a, b, n - b).tolist() == [agree(text[i:], text[j:]) for i, j in zip(a, b, strict=True)]
    assert x.common_extension(a, b, a, backwards=True).tolist() == [agree(text[:i][::-1], text[:j][::-1]) for i, j in zip(a, b, strict=True)]
    assert x.common_extension(np.array([100]), np.array([300]), np.array([70])).tolist() == [70]
    assert x.span(100, 180) == x.span(300, 380) == P.PrefixHash(text[100:180]).span(0, 80)
    long = "é" + "abc" * 60_000  # more than one step of the power table
    y = P.PrefixHash(long)
    assert y.span(1, 70_000) == y.span(90_001, 160_000) == P.PrefixHash(long[1:70_000]).span(0, 69_999)
    assert y.common_extension(np.array([1]), np.array([7]), np.array([len(long) - 7])).tolist() == [len(long) - 7]


def test_likeness_and_prints_against_plain_strings():
    texts = made()
    run = P.Run(texts)
    near_edited, near_next = run.nearness()
    for d, (a, b) in enumerate(zip(texts, texts[1:], strict=False)):
        assert near_next[d] == plain_next(a, b), (a, b)
        assert near_edited[d] == plain_edited(a, b), (a, b)
        assert run.fingerprint(d) == plain_print(a)
        assert run.edited(d) == ((e := a[: len(a) - len(a) // 2] + b[: len(a) // 2]), plain_print(e))
    assert near_next.max() == 1 and ((near_next > 0.2) & (near_next < 0.9)).any()


def test_likeness_of_fingerprints():
    draw = random.Random(2)
    long = "".join(draw.choice("abcdefgh ") for _ in range(20_000))
    half = long[:10_000] + "".join(draw.choice("ijklmnop ") for _ in range(10_000))
    prints = [P.Run([t]).fingerprint(0) for t in (long, half, "", "short", long)]
    assert prints[0] == prints[4] and P.likeness(prints[0], prints[4]) == 1 and P.likeness(prints[0], prints[2]) == 0
    assert abs(P.likeness(prints[0], prints[1]) - 1 / 3) < 0.2


@pytest.mark.parametrize("small", [True, False])
def test_query_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("ROWS_IN_BIN", 2), ("LEAST_BYTES", 100), ("MOST_BYTES", 300), ("CHUNK_BYTES", 200)):
            monkeypatch.setattr(P, name, value)
    docs = [(i * 3, t) for i, t in enumerate(made(30))] + [(1, None), (501, "é"), (None, "null id")] + [(60, f"one id, text {k}") for k in range(25)]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, range string").repartition(5)
    found = P.fingerprint_edits(frame).collect()
    h = {r["text"]: r["h"] for r in frame.selectExpr("coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()}
    ordered = sorted(((i, t or "") for i, t in docs), key=lambda r: (-1 if r[0] is None else r[0], h[r[1]]))
    wanted = []
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        wanted.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_print(t), plain_print(edited), plain_edited(t, n), plain_next(t, n)))
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, wanted))


def test_ranges_are_even_and_in_order(spark, monkeypatch):
    """A third of the rows with one id, and ten texts of a hundred times the usual length."""
    for name, value in (("ROWS_IN_BIN", 8), ("LEAST_BYTES", 1000), ("MOST_BYTES", 4000)):
        monkeypatch.setattr(P, name, value)
    draw = random.Random(4)
    rows = [(7_000 if i % 3 == 0 else i, "x" * (5000 if i % 60 == 1 else 50) + str(draw.random())) for i in range(600)]
    frame = P.ordered_with_successor(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    parts = [p for p in frame.rdd.glom().collect() if p]
    own = [[r for r in p if not r["sent"]] for p in parts]
    assert all(len({r["range"] for r in p}) == 1 and [r["sent"] for r in p] == [False] * (len(p) - 1) + [True] for p in parts)
    flat = [(r["id"], r["h"]) for p in own for r in p]
    assert flat == sorted(flat) and len(flat) == 600
    assert [p[-1]["h"] for p in parts] == [p[0]["h"] for p in own[1:] + own[:1]]
    assert len(parts) > 10 and max(sum(len(r["text"]) for r in p) for p in own) < 4000 + 8 * 2 * 5100 / 2


def test_few_rows(spark):
    run = lambda rows: P.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert run([]) == []
    alone = run([(5, "abcd")])
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0 and alone[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert sorted(str(r["doc_id"]) for r in run([(5, "ab"), (5, "ab"), (None, "x"), (7, "")])) == ["5", "5", "7", "None"]


def test_memory_of_a_long_text():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    text = "".join(random.Random(5).choices("abcdefgh ", k=1_000_000)) * 10
    run = P.Run([text, "short"])
    run.nearness(), run.edited(0), run.fingerprint(0)
    # ru_maxrss is in KB; the text itself and its UTF-32 form are 50 bytes of these for every ten code points.
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 < 45 * len(text)
