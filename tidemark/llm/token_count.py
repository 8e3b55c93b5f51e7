"""Numbers of tokens of whole texts, for budgets and limits, without their ids.

A text's pre-tokens cover its bytes, so their starts alone say where they are. A task finds the starts of all pre-tokens of a chunk
of texts at once by comparing neighbouring characters' kinds, makes the table of the chunk's distinct pre-tokens, has the library count the tokens
of those it hasn't counted yet, and joins the counts to the documents' frequencies (document, pre-token, times), summed by document.
No id of a text is kept anywhere.

Nothing is shuffled: a pre-token is counted once in every task that meets it. Sending each (pre-token, document) pair to where that
pre-token is counted would move more bytes than the texts have.

Kinds of characters (letter, number, white space, other) are asked of the library itself, for ASCII when it is loaded and for every other
character when it is first met; no table of another Unicode version is used. Texts of over ``BLOCK_BYTES`` are taken in blocks cut before a
blank that always starts a pre-token.

Defined results: a null text is empty and has no tokens; strings of added tokens inside a text are one token each, as is the library's
default; repeated rows are counted each; an empty table stays empty; other columns are kept, but for those that are named as a result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import runs, utf8

CHUNK_BYTES = 2 << 20
BLOCK_BYTES = 2 << 20
CACHED = 500_000
AT_ONCE = 8192

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
#: Between two of these a character of the kind makes one pre-token of all three.
_PROBES = ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"))
#: What may follow an apostrophe that starts a pre-token, and then ends it.
SHORTENED = ("s", "t", "re", "ve", "m", "ll", "d")


class Counter:
    """The library's tokenizer of this process, the kinds of the characters met so far and the pre-tokens counted so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        told = json.loads(self.tokenizer.to_str())
        before = told["pre_tokenizer"] or {}
        plain = not any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        if told["normalizer"] or told["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex") or not plain:
            raise ValueError("only byte-level BPE without a normalizer, added blanks or added tokens with rules of their own is counted")
        added = sorted((t["content"].encode() for t in told["added_tokens"]), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, added))) if added else None
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.learn_kinds(np.arange(128))
        self.known: dict[str, int] = {}

    def learn_kinds(self, points: np.ndarray) -> None:
        """A character is of the first kind whose representatives it joins to one pre-token, else white space."""
        for c in np.unique(points[self.kind[points] == UNKNOWN]).tolist():
            joins = (kind for kind, x in _PROBES if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(x + chr(c) + x)) == 1)
            self.kind[c] = next(joins, SPACE)

    def starts(self, data: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of ``data`` (UTF-8) begin. ``spans``: where texts, or parts that are read alone, begin, and the end of all."""
        at = np.flatnonzero((data & 0xC0) != 0x80)
        n = len(at)
        if n == 0:
            return at
        point = data[at].astype(np.int32)
        wide = np.flatnonzero(point >= 0x80)
        if len(wide):
            point[wide] = _decoded(data, at[wide])
            self.learn_kinds(point[wide])
        kind = self.kind[point]
        first = np.zeros(n + 3, bool)
        first[np.searchsorted(at, spans[:-1][np.diff(spans) > 0])] = True
        inside = np.zeros(n, bool)
        if self.added is not None:
            text = data.tobytes()
            for lo, hi in zip(spans[:-1].tolist(), spans[1:].tolist(), strict=True):
                for found in self.added.finditer(text, lo, hi):
                    a, b = np.searchsorted(at, found.span())
                    first[a] = first[b] = True
                    inside[a:b] = True
        first[n:] = True
        after = np.concatenate([[SPACE], kind[:-1]])  # the kind before
        blank = np.concatenate([[False], point[:-1] == 0x20])
        # White space starts where it begins, and its last character starts anew if something else follows.
        ahead = np.concatenate([kind[1:] != SPACE, [False]]) & ~first[1 : n + 1]
        start = np.where(kind == SPACE, (after != SPACE) | ahead, np.where(after == SPACE, ~blank, after != kind)) | first[:n]
        # An apostrophe that starts a pre-token and what it shortens.
        point_ = np.concatenate([point, [0, 0, 0]])
        marks = np.flatnonzero((point == 0x27) & start & ~inside)
        for ending in SHORTENED:
            hit = marks
            for k, c in enumerate(ending, 1):
                hit = hit[(point_[hit + k] == ord(c)) & ~first[hit + k]]
            start[hit + 1] = False
            over = hit + 1 + len(ending)
            start[over[over < n]] = True
        return at[(start & ~inside) | first[:n]]

    def counts(self, pieces: list[str]) -> np.ndarray:
        """The number of tokens of each of the distinct pre-tokens."""
        if len(self.known) > CACHED:
            self.known = {}
        known = self.known
        new = [p for p in pieces if p not in known]
        for lo in range(0, len(new), AT_ONCE):
            part = new[lo : lo + AT_ONCE]
            known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def count(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of tokens of each text; text i is ``data[at[i]:at[i + 1]]``."""
        total = np.zeros(len(at) - 1, np.int64)
        spans = np.unique(np.concatenate([at, *(_cuts(data, lo, hi) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if hi - lo > BLOCK_BYTES)]))
        for lo, hi in runs(spans, CHUNK_BYTES, 1 << 30):
            base, end = spans[lo], spans[hi]
            part = data[base:end]
            starts = self.starts(part, spans[lo : hi + 1] - base)
            if len(starts) == 0:
                continue
            offsets = np.append(starts, end - base)
            pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(part)).dictionary_encode()
            distinct, piece = pieces.dictionary, np.asarray(pieces.indices).astype(np.int64)
            doc = np.searchsorted(at, starts + base, side="right") - 1
            # Frequencies by document and pre-token, joined with the counts by pre-token.
            pair, times = np.unique(doc * len(distinct) + piece, return_counts=True)
            n = self.counts(distinct.to_pylist())[pair % len(distinct)] * times
            np.add.at(total, pair // len(distinct), n)
        return total


def _decoded(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the characters of two or more bytes that begin at ``at``."""
    lead = data[at].astype(np.int32)
    tail = [data[np.minimum(at + k, len(data) - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
    two = (lead & 0x1F) << 6 | tail[0]
    three = (lead & 0x0F) << 12 | tail[0] << 6 | tail[1]
    four = (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    return np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))


def _cuts(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Places in a long text before a blank between two ASCII letters, about ``BLOCK_BYTES`` apart; further apart where there is none."""
    out, size = [], BLOCK_BYTES
    while lo + size < hi:
        part = data[lo : lo + size]
        lower = part | 0x20
        letter = (lower >= 0x61) & (lower <= 0x7A)
        found = np.flatnonzero((part[1:-1] == 0x20) & letter[:-2] & letter[2:])
        if len(found):
            lo += int(found[-1]) + 1
            out.append(lo)
            size = BLOCK_BYTES
        else:
            size *= 2
    return np.array(out, np.int64)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` without the text, with n_bytes, n_tokens and over_limit (n_tokens > limit). ``path``: the tokenizer's file, on every machine."""
    named = ("n_bytes", "n_tokens", "over_limit")
    keep = [f for f in docs.schema if f.name not in (*named, text)]
    kind = T.StructType([*keep, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column(text))
            n = counter(path).count(data, at)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], [f.name for f in kind])

    return docs.mapInArrow(run, kind)
