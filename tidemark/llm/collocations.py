"""Phrases whose words stand together more often than their parts would by chance.

Texts become shards of bounded size, each of one language. In a shard every word has a bitmap of its positions; a piece's end leaves a
position free, so that nothing reaches over it. Bitmaps are kept as blocks of eight positions, empty ones left out, and stored
compressed. A phrase's bitmap (where it ends), shifted by one and ANDed with a word's bitmap, is the bitmap of the longer phrase, and
its popcount the number of occurrences. All words that can follow are ANDed at once, as rows of the same block.

Counts are summed over the shards in three rounds: words; pairs of frequent words; and, depth-first from the pairs that are frequent
over all shards and along such pairs and frequent triples only, phrases of three words and more. A phrase is no more frequent than any
part of it, so no frequent one is missed. What is frequent is told to the shards by a Bloom filter of at most ``MOST_BITS``, whatever the
input: a phrase that it lets pass by mistake is counted for nothing and goes when counts are summed. Most pairs are rare, and so are most
triples along frequent pairs; so both are first summed under short numbers, sorted, as compressed steps, which are a few bytes each, and
only those whose number is frequent are summed as phrases. The shards themselves are never shuffled.

Scores are exact: products in decimals, an integral division at the end.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows count each; equal scores are told apart
by count and phrase; an empty table gives no phrases; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, runs, utf8

#: Bytes of text of a shard, about half a million positions; a shard is larger only where a single piece is.
SHARD_BYTES = 3 << 20
#: Rows of bitmaps that are extended at once.
ROWS_AT_ONCE = 1 << 16
#: Pairs or triples that are added up at once in a task, and at most about in a range of their numbers.
PAIRS_AT_ONCE, RANGE_PAIRS = 1 << 19, 1 << 21
#: Packs of numbers that are added up at once, about.
PACKS_AT_ONCE = 1 << 12
#: Parts that a language's phrases are dealt to before they are ranked.
PARTS = 64
#: Phrases whose counts a task adds up before they leave it.
PHRASES_HELD = 1 << 17
#: Bits of a filter for each phrase in it, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 26

_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def positions(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, word of each occurrence, position of each occurrence) of texts ``data[at[i]:at[i + 1]]`` in UTF-8."""
    kind = _CLASS[data]
    inside = kind == 0
    before = np.concatenate([[False], inside[:-1]])
    before[at[:-1][np.diff(at) > 0]] = False
    start = np.flatnonzero(inside & ~before)
    if len(start) == 0:
        return pa.array([], pa.large_string()), start, start
    kept = np.ascontiguousarray(_LOWER[data[inside]])
    offsets = np.append(np.cumsum(inside)[start] - 1, len(kept)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(kept)).dictionary_encode()
    piece = np.cumsum(kind == 2)[start] + np.searchsorted(at, start, side="right")
    position = np.arange(len(start)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), position


class Bitmaps:
    """Rows (owner, block, bits), by owner and block: bit i of a block is position 8 * block + i. Empty blocks have no row."""

    def __init__(self, owner: np.ndarray, block: np.ndarray, bits: np.ndarray):
        self.owner, self.block, self.bits = owner, block, bits

    @classmethod
    def merged(cls, owner: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Bitmaps:
        """Of rows in any order; those of one owner and block are ORed."""
        key = owner << 40 | block
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
        return cls(key[first] >> 40, key[first] & (1 << 40) - 1, np.bitwise_or.reduceat(bits[order], first) if len(key) else bits)

    @classmethod
    def of_positions(cls, owner: np.ndarray, position: np.ndarray) -> Bitmaps:
        return cls.merged(owner, position >> 3, (1 << (position & 7)).astype(np.uint8))

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.owner, weights=np.bitwise_count(self.bits), minlength=n).astype(np.int64)

    def of(self, keep: np.ndarray) -> Bitmaps:
        """Those of the owners with a True, numbered anew."""
        rows = keep[self.owner]
        return Bitmaps((np.cumsum(keep) - 1)[self.owner[rows]], self.block[rows], self.bits[rows])

    def shifted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the bitmaps moved on by one position; what leaves a block is a row of the next."""
        on, over = self.bits << 1, self.bits >> 7
        stay, leave = np.flatnonzero(on), np.flatnonzero(over)
        return np.concatenate([self.owner[stay], self.owner[leave]]), np.concatenate([self.block[stay], self.block[leave] + 1]), np.concatenate([on[stay], over[leave]])

    def parts(self) -> Iterator[Bitmaps]:
        """By whole owners, of about so many rows at most."""
        ends = np.append(np.flatnonzero(self.owner[1:] != self.owner[:-1]) + 1, len(self.owner)) if len(self.owner) else []
        lo = 0
        while lo < len(self.owner):
            hi = int(ends[max(np.searchsorted(ends, lo + ROWS_AT_ONCE, side="right") - 1, np.searchsorted(ends, lo, side="right"))])
            yield Bitmaps(self.owner[lo:hi], self.block[lo:hi], self.bits[lo:hi])
            lo = hi


def extended(phrases: Bitmaps, group: np.ndarray, index: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, Bitmaps]:
    """(phrase, item, bitmaps) of every phrase followed by an item. ``group``: in which group of items a phrase's followers are.

    ``index``: rows of the items' bitmaps as (group << 40 | block, item, bits), sorted by the first.
    """
    key, item, item_bits = index
    owner, block, bits = phrases.shifted()
    wanted = group[owner] << 40 | block
    lo = np.searchsorted(key, wanted, side="left")
    n = np.searchsorted(key, wanted, side="right") - lo
    row = np.repeat(np.arange(len(owner)), n)
    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n - lo, n)
    both = bits[row] & item_bits[other]
    hit = np.flatnonzero(both)
    row, other = row[hit], other[hit]
    pair = owner[row] << 32 | item[other]
    found, own = np.unique(pair, return_inverse=True)
    return found >> 32, found & (1 << 32) - 1, Bitmaps.merged(own, block[row], both[hit])


def by_block(bitmaps: Bitmaps, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = group[bitmaps.owner] << 40 | bitmaps.block
    order = np.argsort(key, kind="stable")
    return key[order], bitmaps.owner[order], bitmaps.bits[order]


class Shard:
    """Words of one language's texts, their bitmaps, and the pairs of neighbours with their counts."""

    NAMES = ("block", "bits", "sizes", "a", "b", "n")

    def __init__(self, words: pa.Array, bitmaps: Bitmaps, pairs: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.words, self.bitmaps, self.pairs = words, bitmaps, pairs

    @classmethod
    def of_texts(cls, data: np.ndarray, at: np.ndarray) -> Shard:
        words, word, position = positions(data, at)
        bitmaps = Bitmaps.of_positions(word, position)
        one = np.zeros(len(words), np.int64)
        index, parts = by_block(bitmaps, one), []
        for part in bitmaps.parts():
            a, b, made = extended(part, one, index)
            parts.append((a, b, made.counts(len(a))))
        none = np.zeros(0, np.int64)
        return cls(words, bitmaps, tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (none, none, none))

    def to_bytes(self) -> bytes:
        """Compressed; blocks as steps from one to the next."""
        bm = self.bitmaps
        step = np.diff(bm.block, prepend=0).astype(np.int32)
        sizes = np.bincount(bm.owner, minlength=len(self.words))
        sink = pa.BufferOutputStream()
        tables = [pa.table({"block": step, "bits": bm.bits}), pa.table({"words": self.words, "sizes": sizes.astype(np.int32)}), pa.table({k: v.astype(np.int32) for k, v in zip("abn", self.pairs, strict=True)})]
        for t in tables:
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(t)
        return sink.getvalue().to_pybytes()

    @classmethod
    def from_bytes(cls, data: pa.Buffer) -> Shard:
        source = pa.BufferReader(data)
        rows, words, pairs = (pa.ipc.open_stream(source).read_all() for _ in range(3))
        owner = np.repeat(np.arange(len(words)), words["sizes"].to_numpy())
        bitmaps = Bitmaps(owner, np.cumsum(rows["block"].to_numpy().astype(np.int64)), rows["bits"].to_numpy())
        return cls(words["words"].combine_chunks(), bitmaps, tuple(pairs[k].to_numpy().astype(np.int64) for k in "abn"))

    def phrase(self, *words: np.ndarray) -> pa.Array:
        columns = [self.words.take(pa.array(w)) for w in words]
        return columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))

    def longer(self, a: np.ndarray, b: np.ndarray, most_words: int, known: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """(phrases, counts) of ``paths``."""
        for words, n in self.paths(a, b, most_words, known):
            yield self.phrase(*words.T), n

    def paths(self, a: np.ndarray, b: np.ndarray, most_words: int, known: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words of each phrase, counts) of three words and more all whose pairs are among (a, b): depth-first, some phrases at a time.

        ``known`` tells which triples may go on; a phrase with another one is left out.
        """
        one = np.zeros(len(self.words), np.int64)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        used = np.zeros(len(self.words), bool)
        used[b] = True
        second = used[self.bitmaps.owner]
        index = by_block(Bitmaps(self.bitmaps.owner[second], self.bitmaps.block[second], self.bitmaps.bits[second]), one)
        used[:] = False
        used[a] = True
        first = used[self.bitmaps.owner]
        wanted, rows = a << 32 | b, []
        for part in Bitmaps(self.bitmaps.owner[first], self.bitmaps.block[first], self.bitmaps.bits[first]).parts():
            x, y, made = extended(part, one, index)
            pair = x << 32 | y
            at = np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)
            keep = (wanted[at] == pair)[made.owner]
            rows.append((at[made.owner[keep]], made.block[keep], made.bits[keep]))
        if not rows:
            return
        pairs = Bitmaps.merged(*(np.concatenate(x) for x in zip(*rows, strict=True)))
        # A phrase's followers are the pairs that begin with its last word.
        index = by_block(pairs, a)

        def descend(phrases: Bitmaps, path: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for part in phrases.parts():
                parent, pair, made = extended(part, path[:, -1], index)
                longer = np.concatenate([path[parent], b[pair][:, None]], axis=1)
                if known is not None:
                    keep = known(longer[:, -3:])
                    longer, made = longer[keep], made.of(keep)
                if len(longer) == 0:
                    continue
                yield longer, made.counts(len(longer))
                if longer.shape[1] < most_words:
                    yield from descend(made, longer)

        yield from descend(pairs, np.stack([a, b], axis=1))


def _cuts(data: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Places in a long text behind a separator, about ``SHARD_BYTES`` apart; further apart where there is none."""
    out, size = [], SHARD_BYTES
    while lo + size < hi:
        found = np.flatnonzero(_CLASS[data[lo : lo + size]] == 2)
        if len(found):
            lo += int(found[-1]) + 1
            out.append(lo)
            size = SHARD_BYTES
        else:
            size *= 2
    return np.array(out, np.int64)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, data): texts are held by language until there are ``SHARD_BYTES`` of all."""
    held: dict[str, list[pa.Array]] = {}
    size = 0

    def flushed() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            data, at = utf8(pa.concat_arrays(parts))
            spans = np.unique(np.concatenate([at, *(_cuts(data, lo, hi) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if hi - lo > SHARD_BYTES)]))
            for lo, hi in runs(spans, SHARD_BYTES, 1 << 30):
                shard = Shard.of_texts(data[spans[lo] : spans[hi]], spans[lo : hi + 1] - spans[lo])
                if len(shard.words):
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "data": pa.array([shard.to_bytes()], pa.binary())})

    for b in batches:
        _, at = utf8(b.column("text"))
        for lo, hi in runs(at, SHARD_BYTES, 1 << 30):
            part = b.slice(lo, hi - lo)
            coded = part.column("lang").dictionary_encode()
            for i, lang in enumerate(coded.dictionary.to_pylist()):
                held.setdefault(lang, []).append(part.column("text").filter(pc.equal(coded.indices, i)).cast(pa.large_string()))
            size += int(at[hi] - at[lo])
            if size >= SHARD_BYTES:
                yield from flushed()
                held, size = {}, 0
    yield from flushed()


class Filter:
    """A Bloom filter with two places for each key; ``bits`` in words of 64."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, size: int) -> np.ndarray:
        return np.concatenate([keys, keys >> np.uint64(32)]) & np.uint64(size - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys, len(self.bits) * 64)
        set_ = self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
        return (set_[: len(keys)] & set_[len(keys) :]).astype(bool)

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """Of all numbers in column ``key``: each task sets bits, and the words of bits are ORed by Spark."""
        size = 1 << 6
        while size < MOST_BITS and size < BITS_EACH * keys.count():
            size *= 2

        def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = np.unique(cls.places(b.column("key").to_numpy(zero_copy_only=False).view(np.uint64), size))
                first = np.flatnonzero(np.concatenate([[True], at[1:] >> np.uint64(6) != at[:-1] >> np.uint64(6)])) if len(at) else at.astype(np.int64)
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
                yield pa.RecordBatch.from_pydict({"slot": (at[first] >> np.uint64(6)).astype(np.int64), "bits": bits.view(np.int64)})

        rows = keys.mapInArrow(set_bits, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
        bits = np.zeros(size // 64, np.uint64)
        bits[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        return cls(bits)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [int(_key(lang, *(_hash([w]) for w in phrase.split(" ")))[0]) for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"key": _spread(np.array(keys, np.uint64)).view(np.int64)})


def _hash(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def _key(lang: str, *words: np.ndarray) -> np.ndarray:
    """A number for phrases of one language, from the numbers of their words."""
    out = np.full(len(words[0]), xxhash.xxh64_intdigest(lang, len(words)), np.uint64)
    for w in words:
        out = (out ^ w) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9) ^ out >> np.uint64(32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Shard]]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.column("lang")[i].as_py(), Shard.from_bytes(b.column("data")[i].as_buffer())


def _counted(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.repeat(lang, len(n)), "phrase": phrases.cast(pa.string()), "n": n})


def _summed(counted: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same counts, those of one phrase in several shards added up as far as ``PHRASES_HELD`` rows allow."""
    held, size = [], 0

    def added() -> pa.Table:
        out = pa.Table.from_batches(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
        return out.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])

    for b in counted:
        held.append(b)
        size += b.num_rows
        if size >= PHRASES_HELD:
            t = added()
            held, size = (t.to_batches(), t.num_rows) if t.num_rows <= PHRASES_HELD // 2 else ([], 0)
            if not size:
                yield from t.to_batches(ROWS_AT_ONCE)
    if size:
        yield from added().to_batches(ROWS_AT_ONCE)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, shard in _rows(batches):
        yield _counted(lang, shard.words, shard.bitmaps.counts(len(shard.words)))


def _cut(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits)


def _spread(keys: np.ndarray) -> np.ndarray:
    """For a filter, which takes its places from the lower bits of both halves."""
    keys = keys * np.uint64(0x9E3779B97F4A7C15)
    return keys ^ keys >> np.uint64(29)


def _packed(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> Iterator[pa.RecordBatch]:
    """(range, rows, data): numbers and their counts, added up, in steps from one number to the next and compressed: first the lowest bytes of
    all, then the next. A row takes little more than its numbers do, however many ranges there are."""
    key, n = _added(rows)
    range_ = key // np.uint64(width)
    ends = np.append(np.flatnonzero(range_[1:] != range_[:-1]) + 1, len(key)) if len(key) else []
    lo = 0
    for hi in ends:
        both = np.concatenate([np.diff(key[lo:hi], prepend=range_[lo] * np.uint64(width)), n[lo:hi].astype(np.uint64)])
        data = pa.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)
        yield pa.RecordBatch.from_pydict({"range": pa.array([int(range_[lo])], pa.int64()), "rows": pa.array([int(hi - lo)], pa.int64()), "data": pa.array([data], pa.binary())})
        lo = hi


def _added(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    return key[first], np.add.reduceat(n[order], first) if len(key) else n


def _numbered(batches: Iterator[pa.RecordBatch], counts: Callable[[str, Shard], Iterator[tuple[np.ndarray, np.ndarray]]], width: int) -> Iterator[pa.RecordBatch]:
    """The (numbers, counts) that ``counts`` makes of each shard, packed some at a time."""
    held, size = [], 0
    for lang, shard in _rows(batches):
        for key, n in counts(lang, shard):
            held.append((key, n))
            size += len(key)
            if size >= PAIRS_AT_ONCE:
                yield from _packed(held, width)
                held, size = [], 0
    if held:
        yield from _packed(held, width)


def _of_pairs(lang: str, shard: Shard, words: Broadcast, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    a, b, n = shard.pairs
    word = _hash(shard.words.to_pylist())
    good = words.value.has(_spread(_key(lang, word)))
    keep = np.flatnonzero(good[a] & good[b])
    yield _cut(_key(lang, word[a[keep]], word[b[keep]]), bits), n[keep]


def _of_triples(lang: str, shard: Shard, pairs: Broadcast, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    a, b, word = _frequent_pairs(lang, shard, pairs)
    for triples, n in shard.paths(a, b, 3):
        yield _cut(_key(lang, *word[triples.T]), bits), n


def _frequent_pairs(lang: str, shard: Shard, pairs: Broadcast) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, second words) of a shard's frequent pairs, and the number of each of its words."""
    a, b, _ = shard.pairs
    word = _hash(shard.words.to_pylist())
    keep = pairs.value.has(_spread(_key(lang, word[a], word[b])))
    return a[keep], b[keep], word


def _unpacked(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of packs, added up."""
    held = []
    for range_, size, data in zip(*(rows[c].to_pylist() for c in ("range", "rows", "data")), strict=True):
        both = np.frombuffer(pa.decompress(data, 16 * size, "zstd"), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()
        held.append((np.cumsum(both[:size], dtype=np.uint64) + np.uint64(range_ * width), both[size:].astype(np.int64)))
    return _added(held)


def _often(rows: pa.Table, width: int, least: int) -> pa.Table:
    """The numbers of one range whose counts add up to ``least``."""
    key, n = _unpacked(rows, width)
    return pa.table({"key": _spread(key[n >= least]).view(np.int64)})


def _pairs(batches: Iterator[pa.RecordBatch], pairs: Broadcast, bits: int) -> Iterator[pa.RecordBatch]:
    for lang, shard in _rows(batches):
        a, b, n = shard.pairs
        word = _hash(shard.words.to_pylist())
        keep = np.flatnonzero(pairs.value.has(_spread(_cut(_key(lang, word[a], word[b]), bits))))
        for lo in range(0, len(keep), ROWS_AT_ONCE):
            k = keep[lo : lo + ROWS_AT_ONCE]
            yield _counted(lang, shard.phrase(a[k], b[k]), n[k])


def _longer(batches: Iterator[pa.RecordBatch], pairs: Broadcast, triples: Broadcast, bits: int, most_words: int) -> Iterator[pa.RecordBatch]:
    for lang, shard in _rows(batches):
        a, b, word = _frequent_pairs(lang, shard, pairs)

        def known(three: np.ndarray, lang: str = lang, word: np.ndarray = word) -> np.ndarray:
            return triples.value.has(_spread(_cut(_key(lang, *word[three.T]), bits)))

        for phrases, n in shard.longer(a, b, most_words, known):
            yield _counted(lang, phrases, n)


def frequent(docs: DataFrame, least: int, most_words: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of every phrase that occurs ``least`` times or more in its language, (lang, n) of all words)."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shards = checkpointed(texts.mapInArrow(_shards, "lang string, data binary"))
    send, kind = docs.sparkSession.sparkContext.broadcast, "lang string, phrase string, n long"
    summed = lambda rows: checkpointed(rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    counted = lambda count: shards.mapInArrow(lambda batches: _summed(count(batches)), kind)
    words = counted(_words)
    totals = checkpointed(words.groupBy("lang").agg(F.sum("n").alias("n")))
    found = [summed(words)]
    # Pairs and triples are first added up under numbers of a few bits more than there are of them at most; numbers that several share only count too much.
    most = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(max(20, (16 * most).bit_length()), 60)
    width = max(1, (1 << bits) // (16 + most // RANGE_PAIRS))
    some = -(-most // (PAIRS_AT_ONCE * PACKS_AT_ONCE))

    def one_pack(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_packed([_unpacked(rows, width)], width))

    def reached(rows: pa.Table) -> pa.Table:
        return _often(rows, width, least)

    def often(counts: Callable[[str, Shard], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Broadcast:
        packs = "range long, rows long, data binary"
        numbers = shards.mapInArrow(partial(_numbered, counts=counts, width=width), packs)
        if some > 1:  # A frequent number is in nearly every pack of its range; so packs are added up in several groups before those meet.
            numbers = numbers.groupBy("range", F.pmod(F.xxhash64("data"), F.lit(some)).alias("some")).applyInArrow(one_pack, packs)
        return send(Filter.of(checkpointed(numbers.groupBy("range").applyInArrow(reached, "key long"))))

    if most_words > 1:
        words_often = send(Filter.of(found[0].mapInArrow(_keys, "key long")))
        found.append(summed(counted(partial(_pairs, pairs=often(partial(_of_pairs, words=words_often, bits=bits)), bits=bits))))
    if most_words > 2:
        pairs = send(Filter.of(found[1].mapInArrow(_keys, "key long")))
        triples = often(partial(_of_triples, pairs=pairs, bits=bits))
        found.append(summed(counted(partial(_longer, pairs=pairs, triples=triples, bits=bits, most_words=most_words))))
    return reduce(DataFrame.unionByName, found), totals


def dealt(phrase: str = "phrase") -> Column:
    return F.pmod(F.xxhash64(phrase), F.lit(PARTS)).cast("int")


def part(words: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): each phrase by its worst cut in two, the earliest of equal ones."""
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = found.where(F.col("phrase").contains(" ")).withColumnRenamed("n", "a").withColumn("w", F.split("phrase", " "))
    cuts = cuts.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.col("w"), F.lit(1), F.col("k")).alias("head"), part(F.col("w"), F.col("k") + 1, F.size("w")).alias("tail"))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    # Most phrases may be of one language; its number is sent to each of its parts.
    cuts = cuts.withColumn("dealt", dealt()).join(totals.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["lang", "dealt"])
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n"), exact("l") * exact("r"))
    worst = cuts.select("lang", "phrase", "a", "k", "l", "r", "n", score.cast("long").alias("score"))
    worst = worst.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c"))
    return worst.select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")


def mine(docs: DataFrame, least: int = 100, most_words: int = 5, swallowed: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``most_words`` words.

    A phrase inside a longer one that has at least ``swallowed`` percent of its occurrences is left out.
    """
    found, totals = frequent(docs, least, most_words, text, lang)
    long_ = found.withColumn("w", F.split("phrase", " ")).where(F.size("w") > 2)
    lengths = F.sequence(F.lit(2), F.size("w") - 1)
    inner = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.size("w") - m + 1), lambda i: part(F.col("w"), i, m))))
    around = long_.select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("around"))
    kept = scored(found, totals).join(around, ["lang", "phrase"], "left").where(~F.coalesce(100 * F.col("around") >= swallowed * F.col("a"), F.lit(False)))
    # The first of each part of a language, then the first of those: no task sorts more than ``PARTS`` times ``top`` of a language at last.
    place = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = kept.withColumn("dealt", dealt()).withColumn("place", place("lang", "dealt")).where(F.col("place") <= top)
    ranked = first.withColumn("rank", place("lang").cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
