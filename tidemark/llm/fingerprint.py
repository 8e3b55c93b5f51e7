"""Document fingerprints from prefix polynomial hashes.

Code points c_i give prefix sums S_j = sum of c_i * B^i (i < j) modulo a prime, for two primes. The hash of any span is
(S_j - S_i) * B^-i, so spans are compared in constant time, and the longest common extension of two positions, onwards or
backwards, is found by binary search over span equality. One pair of prefix arrays covers a run of consecutive documents.

Likeness of two texts: of all spans of ``SPAN`` code points, those whose hash is 0 modulo ``ONE_IN`` are anchors. Each anchor of one
text that is also one of the other (there: the first place of it) is extended both ways as far as the texts agree; so are the
common beginning and end. The likeness is the share of both texts' code points that these common spans cover: 1 for equal texts, 0
where nothing is common. A common passage of 100 code points is missed with a chance of 7e-6, one of 50 with 0.6 in a hundred.

The edited text joins the head of one document to the head of the next. It is never hashed anew: its common spans are the common
beginning, which runs on over the joint as far as the texts agree, and those of the next document's anchors within the part
taken, not beyond the joint.

The fingerprint that is returned is a text's length, whole hash and the ``KEPT`` smallest anchor hashes, from which ``likeness``
estimates the Jaccard similarity of two texts' spans when the texts themselves are gone.

Order over all documents without one task for all: ranges of the id hold about equal bytes, a range is a partition of its own,
sorted inside and read as a stream; the first document of each range is sent to the range before it as well, so every document
meets its successor. The ranges' bounds come from quantiles of quantiles; the driver holds 36 bytes for each ``ROWS_IN_BIN``
documents. Rows that share one id are dealt by a hash of their text, so that they may fill several ranges.

Memory: about 14 bytes for each code point of the texts in hand, which are ``CHUNK_BYTES`` or two texts.

Defined results: a null text counts as empty; two empty texts have likeness 1, an empty and another 0; rows with the same id
are ordered by a hash of the text, each the successor of the one before; the last document's successor is the first (itself
if alone); a null id comes first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import runs, utf8

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (1_000_003, 911_382_323)
SPAN, ONE_IN, KEPT = 12, 8, 64
CHUNK_BYTES = 2 << 20
#: Documents in a bin of ids, and bytes in a range of bins at most and at least (between them a ``RANGES``th of all); but
#: ranges grow beyond ``MOST_BYTES`` rather than be more than ``MOST_RANGES``, as each is sorted by Spark, and read as a stream.
ROWS_IN_BIN, MOST_BYTES, LEAST_BYTES, RANGES, MOST_RANGES = 2048, 64 << 20, 1 << 20, 96, 40_000
_STEP = 1 << 16


def _table(base: int, prime: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < _STEP:
        out = np.concatenate([out, out * (int(out[-1]) * base % prime) % prime])
    return out[:_STEP]


_UP = [_table(b, p) for b, p in zip(BASES, PRIMES, strict=True)]
_DOWN = [_table(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES, strict=True)]


def _power(table: np.ndarray, prime: int, k: np.ndarray) -> np.ndarray:
    """base^k modulo prime, from the table of its first ``_STEP`` powers."""
    out = table[k % _STEP]
    if len(k) and int(k.max()) >= _STEP:
        high, where = np.unique(k // _STEP, return_inverse=True)
        leap = int(table[-1]) * int(table[1]) % prime
        out = out * np.array([pow(leap, int(h), prime) for h in high.tolist()], dtype=np.int64)[where] % prime
    return out


def scrambled(h: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each hash."""
    h = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class PrefixHash:
    """The prefix arrays of one text, or of several put together."""

    def __init__(self, points: np.ndarray | str):
        if isinstance(points, str):
            points = np.frombuffer(points.encode("utf-32-le"), dtype=np.uint32)
        self.n = len(points)
        self.prefix = [np.zeros(self.n + 1, np.uint32) for _ in PRIMES]
        for s, up, p in zip(self.prefix, _UP, PRIMES, strict=True):
            leap, scale, total = int(up[-1]) * int(up[1]) % p, 1, 0
            for lo in range(0, self.n, _STEP):
                terms = (points[lo : lo + _STEP].astype(np.int64) + 1) * up[: min(_STEP, self.n - lo)] % p
                sums = (np.cumsum(terms * scale % p if scale > 1 else terms) + total) % p
                s[lo + 1 : lo + 1 + len(sums)] = sums
                total, scale = int(sums[-1]), scale * leap % p

    def __len__(self) -> int:
        return self.n

    def hashes(self, start: np.ndarray, end: np.ndarray, primes: int = 2) -> np.ndarray:
        """The 62-bit hashes of spans, the same wherever they stand; 31 bits with one prime."""
        out = np.zeros(len(start), np.int64)
        for s, down, p in list(zip(self.prefix, _DOWN, PRIMES, strict=True))[:primes]:
            out = out << 31 | (s[end].astype(np.int64) - s[start]) % p * _power(down, p, start) % p
        return out

    def span(self, start: int, end: int) -> int:
        return int(self.hashes(np.array([start]), np.array([end]))[0])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of that length at places a and b (a <= b) are equal."""
        same = np.ones(len(a), dtype=bool)
        for s, up, p in zip(self.prefix, _UP, PRIMES, strict=True):
            one, two = (s[x + length].astype(np.int64) - s[x] for x in (a, b))
            same &= one % p * _power(up, p, b - a) % p == two % p
        return same

    def common_extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, backwards: bool = False) -> np.ndarray:
        """How many code points from places a and b (a <= b) on, or before them, are equal: at most ``most``.

        Lengths are doubled until they don't fit, then halved between.
        """
        at = (lambda some, length: self.equal(a[some] - length, b[some] - length, length)) if backwards else (lambda some, length: self.equal(a[some], b[some], length))
        least, above = np.zeros(len(a), np.int64), most + 1  # ``least`` fits, ``above`` doesn't
        open_, step = np.flatnonzero(most > 0), 1
        while len(open_):
            length = np.minimum(step, most[open_])
            fits = at(open_, length)
            least[open_[fits]], above[open_[~fits]] = length[fits], length[~fits]
            open_ = open_[fits & (length < most[open_])]
            step *= 2
        open_ = np.flatnonzero(above - least > 1)
        while len(open_):
            length = (least[open_] + above[open_]) // 2
            fits = at(open_, length)
            least[open_[fits]], above[open_[~fits]] = length[fits], length[~fits]
            open_ = open_[above[open_] - least[open_] > 1]
        return least


def is_anchor(h: np.ndarray) -> np.ndarray:
    """By a span's hash for the first prime."""
    return scrambled(h) % ONE_IN == 0


def span_hashes(points: np.ndarray) -> np.ndarray:
    """Hashes of all spans of ``SPAN`` code points of a short text."""
    n = len(points) - SPAN + 1
    out = np.zeros(max(n, 0), np.int64)
    for up, p in zip(_UP, PRIMES, strict=True):
        total = np.zeros(len(out), np.int64)
        for k in range(SPAN if n > 0 else 0):
            total += (points[k : k + n].astype(np.int64) + 1) * up[k] % p
        out = out << 31 | total % p
    return out


def sketch_hex(length: int, whole: int, sketch: np.ndarray) -> str:
    return f"{length:x}-{whole:016x}-" + sketch.astype(">u4").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of the spans of two fingerprints' texts, 0 to 1."""
    if a == b:
        return 1.0
    x, y = ({f[i : i + 8] for i in range(0, len(f), 8)} for f in (a.rpartition("-")[2], b.rpartition("-")[2]))
    union = sorted(x | y)
    # Beyond the end of a full sketch nothing is known of its text.
    union = union[:KEPT] if max(len(x), len(y)) >= KEPT else union
    return len(x & y & set(union)) / len(union) if union else 0.0


def covered(start: np.ndarray, end: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """How many places the spans of each owner cover together. Owners' spans lie in stretches that don't overlap."""
    order = np.argsort(start, kind="stable")
    start, end, owner = start[order], end[order], owner[order]
    before = np.concatenate([[0], np.maximum.accumulate(end)[:-1]]) if len(end) else end
    return np.bincount(owner, weights=np.maximum(end - np.maximum(start, before), 0), minlength=owners).astype(np.int64)


class Run:
    """Consecutive documents: fingerprints, and the likeness of each to the next and to its edited text."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        self.points, self.hash = points, PrefixHash(points)
        self.whole = self.hash.hashes(self.first[:-1], self.first[1:])
        places, keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo in range(0, max(len(points) - SPAN + 1, 0), _STEP):
            at = np.arange(lo, min(lo + _STEP, len(points) - SPAN + 1))
            at = at[is_anchor(self.hash.hashes(at, at + SPAN, primes=1))]
            doc = np.searchsorted(self.first, at, side="right") - 1
            inside = at + SPAN <= self.first[doc + 1]
            places.append(at[inside])
            values.append(scrambled(self.hash.hashes(at[inside], at[inside] + SPAN)))
            keys.append(doc[inside] << 44 | (values[-1] >> np.uint64(20)).astype(np.int64))
        place, value, key = (np.concatenate(x) for x in (places, values, keys))
        order = np.argsort(key, kind="stable")  # by document and hash, then by place
        self.place, self.value, self.key = place[order], value[order], key[order]
        self.of_doc = np.searchsorted(self.key, np.arange(len(texts) + 1) << 44)
        self.half = np.minimum(self.sizes // 2, np.append(self.sizes[1:], 0))  # code points that an edited text takes from the next
        self.keep = self.sizes - self.sizes // 2

    def _sketch(self, values: np.ndarray) -> np.ndarray:
        return np.unique((values >> np.uint64(32)).astype(np.uint32))[:KEPT]

    def fingerprint(self, d: int) -> str:
        # Values are in order by all but their last bits.
        own = self.value[self.of_doc[d] : self.of_doc[d + 1]]
        some = own[: 2 * KEPT]
        sketch = self._sketch(some)
        return sketch_hex(int(self.sizes[d]), int(self.whole[d]), sketch if len(sketch) == KEPT or len(some) == len(own) else self._sketch(own))

    def edited(self, d: int) -> tuple[str, str]:
        """The edited text of document d, and its fingerprint."""
        keep, taken = int(self.keep[d]), int(self.half[d])
        text = self.texts[d][:keep] + self.texts[d + 1][:taken]
        joint = self.first[d] + np.arange(max(0, keep - SPAN + 1), keep), self.first[d + 1] + np.arange(min(taken, SPAN - 1))
        across = span_hashes(self.points[np.concatenate(joint)])
        values = [scrambled(across[is_anchor(across >> 31)])]
        for doc, most in ((d, keep), (d + 1, taken)):
            own = slice(self.of_doc[doc], self.of_doc[doc + 1])
            values.append(self.value[own][self.place[own] - self.first[doc] + SPAN <= most])
        whole = 0
        for s, up, down, p in zip(self.hash.prefix, _UP, _DOWN, PRIMES, strict=True):
            a, b = int(self.first[d]), int(self.first[d + 1])
            head = (int(s[a + keep]) - int(s[a])) * pow(int(down[1]), a, p)
            tail = (int(s[b + taken]) - int(s[b])) * pow(int(down[1]), b, p) * pow(int(up[1]), keep, p)
            whole = whole << 31 | (head + tail) % p
        return text, sketch_hex(keep + taken, whole, self._sketch(np.concatenate(values)))

    def _anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, place in it, place in the next, whether the first place is the one that was searched for)."""
        found = []
        doc = self.key >> 44
        for step in (1, -1):
            key = self.key + (step << 44)
            at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
            hit = np.flatnonzero(self.key[at] == key) if len(self.key) else at
            here, there = self.place[hit], self.place[at[hit]]
            pair = (doc[hit], here, there) if step == 1 else (doc[hit] - 1, there, here)
            found.append((*pair, np.full(len(hit), step == 1)))
        doc, a, b, own = (np.concatenate(x) for x in zip(*found, strict=True))
        same = self.hash.equal(a, b, np.full(len(a), SPAN))
        return doc[same], a[same], b[same], own[same]

    def nearness(self) -> tuple[np.ndarray, np.ndarray]:
        """Likeness of each document but the last to its edited text and to the next document."""
        n = len(self.texts) - 1
        docs = np.arange(n)
        start, end, after, keep, half = self.first[:-2], self.first[1:-1], self.first[2:], self.keep[:-1], self.half[:-1]
        shorter = np.minimum(self.sizes[:-1], self.sizes[1:])
        grow = self.hash.common_extension
        doc, a, b, own = self._anchors()
        back = grow(a, b, np.minimum(a - start[doc], b - end[doc]), backwards=True)
        on = grow(a, b, np.minimum(end[doc] - a, after[doc] - b))
        head, tail = grow(start, end, shorter), grow(end, after, shorter, backwards=True)
        covers = lambda where, low, high, whose: covered(np.concatenate([*where, low]), np.concatenate([*(w + x for w, x in zip(where, (head, tail), strict=True)), high]), np.concatenate([docs, docs, whose]), n)
        one = covers((start, end - tail), (a - back)[own], (a + on)[own], doc[own])
        two = covers((end, after - tail), (b - back)[~own], (b + on)[~own], doc[~own])
        near_next = (one + two) / np.maximum(self.sizes[:-1] + self.sizes[1:], 1)
        near_next[(self.sizes[:-1] == self.sizes[1:]) & (self.whole[:-1] == self.whole[1:])] = 1.0

        # The edited text: places in its second part are places in the next document up to ``half``.
        joint, till = start + keep, end + half
        run_on = grow(joint, end, np.minimum(end - joint, half))
        last = grow(end, till, np.minimum(end - joint, half), backwards=True)
        inside = b + SPAN <= till[doc]
        doc, a, b, own, back, on = (x[inside] for x in (doc, a, b, own, back, on))
        on = np.minimum(on, till[doc] - b)
        spans = lambda where, low, high, whose: covered(np.concatenate([*where[:2], low]), np.concatenate([*where[2:], high]), np.concatenate([docs, docs, whose]), n)
        one = spans((start, end - last, joint + run_on, end), (a - back)[own], (a + on)[own], doc[own])
        two = keep + spans((end, till - last, end + run_on, till), (b - back)[~own], (b + on)[~own], doc[~own])
        near_edited = (one + two) / np.maximum(self.sizes[:-1] + keep + half, 1)
        same = (run_on == end - joint) & (half == end - joint)
        near_edited[same] = 1.0
        return near_edited, near_next


def _bins(rows: DataFrame) -> np.ndarray:
    """Bounds between bins of about ``ROWS_IN_BIN`` rows of (id): quantiles of ids, then within each part again."""
    n = rows.count()
    parts = int(np.ceil(np.sqrt(max(1, -(-n // ROWS_IN_BIN)))))
    if parts == 1:
        return np.zeros(0, np.int64)
    quantiles = F.percentile_approx("id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts))
    coarse = np.array(rows.agg(quantiles.alias("b")).first()["b"], dtype=np.int64)
    split = rows.withColumn("part", _bin_of(coarse)(F.col("id"), F.col("h"))).groupBy("part").agg(quantiles.alias("b"))
    fine = [np.array(b, dtype=np.int64) for b in split.toArrow().column("b").to_pylist() if b]
    return np.sort(np.concatenate([coarse, *fine]))


def _bin_of(bounds: np.ndarray):  # noqa: ANN202
    """Column function (id, h) to the number of the bin. An id that is the bound k times is dealt to k + 1 bins in the order of h."""

    @F.pandas_udf("int")
    def number(ids: pd.Series, h: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(bounds, ids.to_numpy(), side=s) for s in ("left", "right"))
        share = (h.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        return pd.Series((low + np.minimum((share * (high - low + 1)).astype(np.int64), high - low)).astype(np.int32))

    return number


def ordered_with_successor(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text, range, sent): sent rows are the first of the next range. A range is a partition, sorted inside."""
    least = -(1 << 63)
    own = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = own.select("doc", F.coalesce("doc", F.lit(least)).alias("id"), F.xxhash64("text").alias("h"), "text")
    bounds = _bins(rows.select("id", "h"))
    binned = rows.withColumn("bin", _bin_of(bounds)(F.col("id"), F.col("h")))
    stats = binned.groupBy("bin").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min(F.struct("id", "h")).alias("head")).orderBy("bin").toArrow()
    if not stats.num_rows:
        return rows.select("doc", "id", "h", "text", F.lit(0).alias("range"), F.lit(False).alias("sent"))
    number, size = (np.asarray(stats.column(c).combine_chunks()).astype(np.int64) for c in ("bin", "bytes"))
    full = max(LEAST_BYTES, min(MOST_BYTES, int(size.sum()) // RANGES), int(size.sum()) // MOST_RANGES)
    # A range ends with the bin that fills it.
    of_bin, ranges, filled = np.zeros(len(bounds) + 1, dtype=np.int32), 0, 0
    firsts = [0]
    for k, (b, s) in enumerate(zip(number.tolist(), size.tolist(), strict=True)):
        if filled >= full:
            ranges, filled = ranges + 1, 0
            firsts.append(k)
        of_bin[b], filled = ranges, filled + s
    ranges += 1

    @F.pandas_udf("int")
    def range_of(bins: pd.Series) -> pd.Series:
        return pd.Series(of_bin[bins.to_numpy()])

    heads = stats.column("head").combine_chunks().take(pa.array(firsts))
    head_rows = pa.table({"head_id": heads.field("id"), "head_h": heads.field("h"), "before": pa.array([(r - 1) % ranges for r in range(ranges)], pa.int32()), "n": pa.array(range(ranges), pa.int32())})
    ranged = binned.withColumn("range", range_of("bin")).drop("bin")
    # Four numbers for each of at most about ``MOST_RANGES`` ranges, so that the texts needn't be shuffled for the join.
    heads = F.broadcast(docs.sparkSession.createDataFrame(head_rows))
    sent = ranged.join(heads, (F.col("range") == F.col("n")) & (F.col("id") == F.col("head_id")) & (F.col("h") == F.col("head_h"))).dropDuplicates(["n"])
    both = ranged.withColumn("sent", F.lit(False)).unionByName(sent.select("doc", "id", "h", "text", F.col("before").alias("range"), F.lit(True).alias("sent")))
    return both.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "sent", "id", "h")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    fields = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str, int, bool]] = []
        for batch in batches:
            _, at = utf8(batch.column("text"))
            for lo, hi in runs(at, CHUNK_BYTES, 1 << 14):
                rows = held + list(zip(*(batch.column(c).slice(lo, hi - lo).to_pylist() for c in ("doc", "text", "range", "sent")), strict=True))
                held = rows[-1:]
                if len(rows) < 2:
                    continue
                of = Run([r[1] for r in rows])
                near_edited, near_next = of.nearness()
                # A sent row has no successor here, nor has the last of another range.
                some = [d for d in range(len(rows) - 1) if not rows[d][3] and rows[d][2] == rows[d + 1][2]]
                made = [of.edited(d) for d in some]
                columns = [[len(rows[d][1]) for d in some], [hashlib.sha256(t.encode()).hexdigest() for t, _ in made], [of.fingerprint(d) for d in some], [f for _, f in made], near_edited[some], near_next[some]]
                yield pa.RecordBatch.from_arrays([pa.array([rows[d][0] for d in some], pa.int64()), *(pa.array(c, k) for c, k in zip(columns, fields.values(), strict=True))], ["doc", *fields])

    schema = "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered_with_successor(docs, key, text).select("doc", "text", "range", "sent").mapInArrow(run, schema).withColumnRenamed("doc", key)
