"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database for each task.

A partition's texts are cut into pieces by the pattern; each different piece becomes rows of (word, position, token), at first one
for each byte. A recursive query joins neighbouring tokens with the merge table and contracts each word's leftmost pair of
minimum rank, until no pair is left; words that are finished leave the recursion. Decoding joins token ids with the vocabulary
and concatenates by an ordered aggregate.

The merge table holds every way to split a token in two tokens, so a pair has the rank of its joined bytes, as in tiktoken.
A vocabulary is only taken if each of its tokens, contracted by pairs of lower rank alone, ends as two tokens (``Coder.checked``,
by the same recursive query). Then no contraction makes a pair of a lower rank than its own: say the pair z, w became possible by
making z with rank r, and the token zw has rank q < r. All pairs of rank q or less had been contracted before, and by them alone the
bytes of zw, between whose ends and the rest nothing was contracted, become zw.

So all places of a word's minimum-rank pair can be contracted one after another from the left before anything else is. Pieces of
over ``LONG`` bytes do that in one round, by windows; for shorter ones, a round for each contraction takes less time. Both are the
same rule and give the same tokens. Long pieces are first cut between bytes that are neighbours in no token, as no token can span such
a place; all long pieces of a chunk are rows of one query.

A task holds the pieces of ``CHUNK_BYTES`` of text and a bounded cache of pieces already encoded. Nothing is shuffled. What a
database can't hold in ``MEMORY`` goes to the folder that Spark itself spills to on that machine (Spark names it to its workers).

Defined results: a null text is empty and has no tokens; null ids decode to no bytes; an id outside the vocabulary is an error;
repeated rows are encoded each; other columns are kept, but for those that are named as a result.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import runs, utf8

CHUNK_BYTES = 2 << 20
CHUNK_TOKENS = 1 << 20
WORDS_AT_ONCE = 20_000
CACHED_WORDS = 800_000
LONG = 64
MEMORY = "300MB"

# A row of state is a token of a word: its place (the word's number shifted by 32 bits, plus the position), the next token's place, and whether the word
# is finished. ``best`` is a word's minimum rank, then the leftmost place of that, then the places of the right half and of its end.
_SHORT = """
WITH RECURSIVE state AS (
  SELECT place, place + 1 AS till, tok, false AS finished FROM bytes_
  UNION ALL
  (WITH pair AS (
     SELECT s.place >> 32 AS word, min(m.id * 2097152 + (s.place & 127) * 16384 + (n.place & 127) * 128 + (n.till & 127)) AS best
     FROM state s JOIN state n ON n.place = s.till JOIN merges m ON m.pair = s.tok * 1048576 + n.tok
     WHERE NOT s.finished {only} GROUP BY 1)
   SELECT s.place, CASE WHEN hit THEN s.place - (s.place & 127) + (best & 127) ELSE till END, CASE WHEN hit THEN best >> 21 ELSE tok END, best IS NULL
   FROM (SELECT s.*, p.best, (s.place & 127) = (p.best >> 14) & 127 AS hit FROM state s LEFT JOIN pair p ON p.word = s.place >> 32 WHERE NOT s.finished) s
   WHERE best IS NULL OR (place & 127) <> (best >> 7) & 127)
)
SELECT place >> 32 AS word, tok FROM state WHERE finished ORDER BY place
"""
ENCODE_SHORT = _SHORT.format(only="")
#: The word with a token's id as number is that token's bytes; only pairs of lower rank are contracted.
ENCODE_BELOW = _SHORT.format(only="AND m.id < s.place >> 32")
# Here all pairs of minimum rank become tokens, in a run of overlapping ones every second; ``best`` is the rank alone. A row's pair is
# with the next row of its word.
_LONG_STATE = """
  SELECT *, min(id) OVER (PARTITION BY word) AS best FROM (
    SELECT s.word, s.place, s.tok, m.id
    FROM (SELECT place >> 32 AS word, place, tok, lead(tok) OVER (PARTITION BY place >> 32 ORDER BY place) AS next_tok FROM {rows}) s
    LEFT JOIN merges m ON m.pair = s.tok * 1048576 + s.next_tok)
"""
_LEFT_TO_RIGHT = """
    (SELECT place, CASE WHEN taken THEN best ELSE tok END AS tok FROM (
       SELECT *, lag(taken, 1, false) OVER (PARTITION BY word ORDER BY place) AS gone FROM (
         SELECT *, coalesce(id = best, false) AND (n - coalesce(max(CASE WHEN id = best THEN NULL ELSE n END) OVER (PARTITION BY word ORDER BY place), 0)) % 2 = 1 AS taken
         FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY place) AS n FROM state WHERE best IS NOT NULL)
       )) WHERE NOT gone)
"""
ENCODE_LONG = f"WITH RECURSIVE state AS ({_LONG_STATE.format(rows='bytes_')} UNION ALL {_LONG_STATE.format(rows=_LEFT_TO_RIGHT)}) SELECT word, tok FROM state WHERE best IS NULL ORDER BY place"
DECODE = "SELECT t.doc, string_agg(v.piece, '' ORDER BY t.pos) AS text, count(*) AS n FROM tokens t JOIN vocabulary v ON v.id = t.tok GROUP BY t.doc ORDER BY t.doc"

# In the database a byte is the character 256 above it, as not all bytes make a string there.
_SHIFT = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Coder:
    """The tables of one vocabulary in a database of this process, and the pieces encoded so far."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            for a, b in zip(token, token[1:], strict=False):
                self.joined[a, b] = True
        splits = np.array([(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks], dtype=np.int32).reshape(-1, 3)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute(f"SET memory_limit = '{MEMORY}'")
        spill = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.db.execute(f"SET temp_directory = '{spill}/duckdb-{os.getpid()}'" if spill else "SET temp_directory = ''")
        wide = splits.astype(np.int64)
        self._give("merges_", pair=wide[:, 0] << 20 | wide[:, 1], id=wide[:, 2])
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_")
        self._give("vocabulary_", id=np.fromiter(ranks.values(), np.int32), piece=["".join(chr(_SHIFT + x) for x in t) for t in ranks])
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_")
        self._forget()
        self.checked()

    def checked(self) -> None:
        """Whether every token is what pairs of lower rank make of its bytes, but for a last contraction."""
        tokens = [t for t in self.ranks if 1 < len(t) <= LONG]
        word, _ = self._query(tokens, ENCODE_BELOW, [self.ranks[t] for t in tokens])
        wrong = np.flatnonzero(np.bincount(word, minlength=1)[[self.ranks[t] for t in tokens]] != 2) if tokens else []
        # Longer tokens by the windows, which take the rule for granted up to their rank: the whole bytes must become the token.
        longer = [t for t in self.ranks if len(t) > LONG]
        found = dict(zip(*self._query(longer, ENCODE_LONG), strict=True)) if longer else {}
        if len(wrong) or any(found[i] != self.ranks[t] for i, t in enumerate(longer)):
            raise ValueError("not the ranks of a byte-pair vocabulary: a token is not made by pairs of lower rank")

    def _give(self, name: str, **columns: object) -> None:
        self.db.register(name, pa.table(columns))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _query(self, words: list[bytes], sql: str, numbers: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number of the word, token) of each token of the words, in order."""
        sizes = np.array([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        first = (np.array(numbers if numbers is not None else range(len(words)), dtype=np.int64) << 32) - (np.cumsum(sizes) - sizes)
        self._give("bytes_", place=np.arange(len(data)) + np.repeat(first, sizes), tok=self.byte[data].astype(np.int64))
        found = self.db.execute(sql).fetchnumpy()
        return np.asarray(found["word"]), np.asarray(found["tok"])

    def _learn(self, new: list[str]) -> None:
        encoded = [w.encode() for w in new]
        whole = {i: self.ranks[w] for i, w in enumerate(encoded) if w in self.ranks}
        parts = [(np.fromiter(whole, np.int64), np.fromiter(whole.values(), np.int64))]
        short = [i for i, w in enumerate(encoded) if len(w) <= LONG and i not in whole]
        for lo in range(0, len(short), WORDS_AT_ONCE):
            own = np.array(short[lo : lo + WORDS_AT_ONCE])
            word, tok = self._query([encoded[i] for i in own], ENCODE_SHORT)
            parts.append((own[word], tok))
        pieces, owners = [], []
        for i, w in enumerate(encoded):
            if len(w) > LONG and i not in whole:
                data = np.frombuffer(w, dtype=np.uint8)
                cuts = np.flatnonzero(~self.joined[data[:-1], data[1:]]) + 1
                pieces += [w[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(w)], strict=True)]
                owners += [i] * (len(cuts) + 1)
        if pieces:
            word, tok = self._query(pieces, ENCODE_LONG)
            parts.append((np.array(owners)[word], tok))
        word, tok = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(word, kind="stable")
        sizes = np.bincount(word, minlength=len(new))
        for i, w in enumerate(new):
            self.known[w] = len(self.starts) + i
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, tok[order].astype(np.int32)])

    def encode(self, texts: list[str]) -> pa.Array:
        """list<int32> of the token ids of each text."""
        if len(self.known) > CACHED_WORDS:
            self._forget()
        pieces = [self.pattern.findall(t) for t in texts]
        if new := [w for w in dict.fromkeys(chain.from_iterable(pieces)) if w not in self.known]:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(pieces)), np.int64)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        flat = self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        n_pieces = np.cumsum([0, *map(len, pieces)])
        offsets = np.concatenate([[0], ends])[n_pieces].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))

    def decode(self, ids: pa.Array) -> list[bytes]:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(ids), 0)).astype(np.int64)
        out = [b""] * len(ids)
        flat = np.asarray(ids.flatten(), dtype=np.int32)
        ends = np.cumsum(sizes)
        for lo, hi in runs(np.concatenate([[0], ends]), CHUNK_TOKENS, 1 << 30):
            n = sizes[lo:hi]
            first = ends[lo] - sizes[lo]
            total = int(n.sum())
            self._give("tokens", doc=np.repeat(np.arange(lo, hi, dtype=np.int32), n), pos=np.arange(total, dtype=np.int32), tok=flat[first : first + total])
            found = self.db.execute(DECODE).fetchnumpy()
            if int(np.sum(found["n"])) != total:
                raise ValueError("a token id is not in the vocabulary")
            for doc, text in zip(found["doc"].tolist(), found["text"], strict=True):
                out[doc] = (np.frombuffer(text.encode("utf-16-le"), np.uint16) - _SHIFT).astype(np.uint8).tobytes()
        return out


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(path, pattern)


def _encoded(path: str, pattern: str, text: str, ids: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, at = utf8(b.column(text))
            for lo, hi in runs(at, CHUNK_BYTES, 1 << 30):
                part = b.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(text).to_pylist()]
                keep = [c for c in part.schema.names if c != ids]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), coder(path, pattern).encode(texts)], [*keep, ids])

    return run


def _decoded(path: str, pattern: str, ids: str, data: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [c for c in b.schema.names if c != data]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(coder(path, pattern).decode(b.column(ids)), pa.binary())], [*keep, data])

    return run


def _with(schema: T.StructType, name: str, kind: T.DataType, without: tuple[str, ...] = ()) -> T.StructType:
    return T.StructType([*(f for f in schema if f.name != name and f.name not in without), T.StructField(name, kind)])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text."""
    return docs.mapInArrow(_encoded(path, pattern, text, ids), _with(docs.schema, ids, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the token ids stand for."""
    return docs.mapInArrow(_decoded(path, pattern, ids, data), _with(docs.schema, data, T.BinaryType()))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` from the ids, in one pass; the text is left out of the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        without_text = (b.select([c for c in b.schema.names if c != text]) for b in _encoded(path, pattern, text, ids)(batches))
        return _decoded(path, pattern, ids, data)(without_text)

    return docs.mapInArrow(run, _with(_with(docs.schema, ids, T.ArrayType(T.IntegerType()), (text,)), data, T.BinaryType()))
