"""op6 against the tiktoken library, and back."""

import base64
import random
import time

import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import byte_bpe as B

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = ["Hello  world, it's\n\n\t 12345 tokens<|endoftext|>!", "", None, " ", "a" * 5000, "ab" * 700, "x" * 70 + "é" * 90, "中文\U0001f600" * 60, "aXq9/+=" * 80, "\x00\x01\u0085  \r\n", "Donaudampfschifffahrtsgesellschaftskapitän" * 9, "the the the"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def test_round_trip(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, TEXTS[0]])]
    out = B.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH, PATTERN).collect()
    assert len(out) == len(rows)
    for r in out:
        text = rows[r["doc_id"]][1] or ""
        assert list(r["ids"]) == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()


def test_encode_and_decode_apart(spark, library):
    docs = B.encode(spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string"), PATH, PATTERN)
    assert docs.columns == ["doc_id", "text", "ids"]
    back = {r["doc_id"]: r for r in B.decode(docs, PATH, PATTERN).collect()}
    assert bytes(back[1]["decoded"]) == b"one two" and bytes(back[2]["decoded"]) == b""
    some = spark.createDataFrame([(1, [220, 220]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert [bytes(r["decoded"]) for r in B.decode(some, PATH, PATTERN).orderBy("doc_id").collect()] == [library.decode_bytes([220, 220]), b"", b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        B.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), PATH, PATTERN).collect()
    assert B.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, PATTERN).count() == 0


def test_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(B, "CACHED_WORDS", 3)
    coder = B.Coder(PATH, PATTERN)
    for t in ("a b c d e", "f g h", "a b c"):
        assert coder.encode([t]).to_pylist() == [library.encode_ordinary(t)]
    assert len(coder.known) <= 8


def test_both_queries_agree(library):
    coder = B.Coder(PATH, PATTERN)
    words = [w.encode() for w in ("hello", "aaaaaaa", "mississippi", "abababab", "zzzz")]
    for sql in (B.ENCODE_SHORT, B.ENCODE_LONG):
        word, tok = coder._query(words, sql)
        assert [tok[word == i].tolist() for i in range(len(words))] == [library._core_bpe.encode_single_piece(w) for w in words]


def test_many_long_pieces_in_one_query(library):
    """Words of 90 bytes and runs without a blank: equal to the library, and in seconds."""
    draw = random.Random(3)
    coder = B.Coder(PATH, PATTERN)
    words = " ".join("".join(draw.choice("абвгдежзиклмнопрстуфхцчшщыэюя") for _ in range(45)) for _ in range(2000))
    runs = "。".join("".join(chr(draw.randint(0x4E00, 0x9FA5)) for _ in range(draw.choice([25, 400]))) for _ in range(60))
    began = time.perf_counter()
    for text in (words, runs, "=" * 50_001, "aab" * 9000):
        assert coder.encode([text]).to_pylist() == [library.encode_ordinary(text)]
    assert time.perf_counter() - began < 20


def test_other_vocabularies_are_refused(tmp_path):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258}
    for extra, good in (({}, True), ({b"abcd": 260, b"abcde": 259}, False), ({b"xyz": 259}, False)):
        path = tmp_path / f"{len(extra)}{good}.tiktoken"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in (ranks | extra).items()))
        if good:
            assert B.Coder(str(path), PATTERN).encode(["abc bc"]).to_pylist() == [[257, 32, 258]]
        else:
            with pytest.raises(ValueError, match="not the ranks"):
                B.Coder(str(path), PATTERN)
