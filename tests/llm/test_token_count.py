"""op13 against the library."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import token_count as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello  world, it's\n\n\t 12345 tokens<|endoftext|>!", "", None, " ", "  ", "a  b", "a \n b", "\n\n", "tail  \n", "<|endoftext|>", "a <|endoftext|>", "  <|endoftext|>  <|endoftext|><|endoftext|>x", "<|endoftext", "we'll they've I'm he'd 'tis ''s !'s '' 's's 're're 'l 'LL x'S '", " 's \n's \t'll", "'", "'s<|endoftext|>'t", "'<|endoftext|>s", "'l<|endoftext|>l",
    "中文 \U0001f600\U0001f600 ½ ²3  x　y \u0085z", "x́y 𝄞𝄞 \U00011de0 ꟎", "e" * 5000, " " * 3000 + "x", "!" * 70 + "é" * 90, "a1b2 3c", "\x00\x01\r\n\x0b", "a" * 64 + " " + "b",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def made(n, seed=2):
    draw = random.Random(seed)
    bits = ["a", "bc", " ", "  ", "\n", "'", "'s", "'ll", "1", "!", "é", "ж", "中", " ", " ", "<|endoftext|>", "<|", "|>", "½", "\U0001f600", "the", ".", "\t", "́", "Ⅷ", "٣"]
    return ["".join(draw.choice(bits) for _ in range(draw.randint(0, 30))) for _ in range(n)]


def test_counts(spark, library):
    texts = TEXTS + made(3000) + TEXTS[:5]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "clash")]
    found = C.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, limit=20)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = {r["doc_id"]: tuple(r)[1:] for r in found.collect()}
    for i, t, _ in rows:
        n = library(t)
        assert got[i] == (len((t or "").encode()), n, n > 20), repr(t)
    assert len(got) == len(rows)
    assert C.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_pretokens_are_the_librarys():
    """The places themselves, with many texts in one chunk."""
    counter = C.Counter(PATH)
    texts = [t.replace("<|endoftext|>", "#") for t in made(2000, 5)]
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts = counter.starts(np.frombuffer("".join(texts).encode(), np.uint8), at)
    expected = []
    for t, lo in zip(texts, at.tolist(), strict=False):
        expected += [lo + len(t[:a].encode()) for _, (a, _) in counter.tokenizer.pre_tokenizer.pre_tokenize_str(t)]
    # Characters that the byte-level tokenizer splits in bytes share an offset there.
    assert starts.tolist() == sorted(set(expected))


@pytest.mark.parametrize("block", [40, 64, 1000])
def test_blocks_and_chunks_change_nothing(library, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    monkeypatch.setattr(C, "CHUNK_BYTES", 2 * block)
    monkeypatch.setattr(C, "CACHED", 50)
    texts = ["it's a long text of many words, we'll see  <|endoftext|> and  more " * 40, "中文" * 200, "x" * 500, "", "a b" * 100, *made(200, 9)]
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    assert C.Counter(PATH).count(np.frombuffer("".join(texts).encode(), np.uint8), at).tolist() == [library(t) for t in texts]


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError, match="only byte-level"):
        C.Counter(public_tokenizers.path("word_bpe_49k.json"))
    told = json.load(open(PATH))
    told["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(told))
    with pytest.raises(ValueError, match="only byte-level"):
        C.Counter(str(tmp_path / "t.json"))
