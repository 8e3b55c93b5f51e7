"""Toxicity by weak supervision.

Many voters, lexicons and patterns, each say toxic (1), clean (-1) or nothing (0) about a text. A generative label model explains
their votes: each row has a hidden class; a voter's vote depends on the class and on the vote of one other voter, its parent in a
tree. The tables P(vote | class, parent's vote) are the voters' accuracies and the correlations of pairs; the tree holds the pairs
that are most correlated within the classes (largest sum of mutual information, as in Chow and Liu), so voters that repeat each
other don't count twice. Tables, tree and class share are estimated together by expectation maximisation from the votes alone: labels
are no votes and no start of it. A linear classifier over hashed words and word beginnings is then trained on the posterior
labels, and scores every whole text.

Lexicons come from two places: fixed lists, and all words and word beginnings that are significantly more frequent in texts labelled
toxic. That is the only use of labels.

Everything is fitted on a bounded sample of the rows that may be learned from: about ``SAMPLE_PER_LABEL`` for each label value and
``SAMPLE_UNLABELLED`` without a label. The model holds ``BUCKETS`` weights, whatever the input's size. Scoring is one pass over
whole texts without a shuffle.

Defined results: null and empty texts get the score of a text without any known word; with no rows to learn from, the fixed
lexicons alone decide; sampled rows of one id count as one, by the text with the least hash; sampled rows of one label with the same
words count once; an id with several labels has the largest; rows without an id are scored, but nothing is learned from them; repeated
rows are scored each; an empty table gives no rows; other columns are kept, but for ``score`` and ``predicted``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_sample, checkpointed, runs, utf8

SAMPLE_PER_LABEL, SAMPLE_UNLABELLED = 3000, 2000
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Lengths, in bytes, of the word beginnings that are features beside the whole word (0).
BEGINNINGS = (0, 4, 5, 6)
LEXICON_VOTERS = 24
BLOCK_BYTES = 1 << 21

# Insults by language, as lexicon voters to begin with.
INSULTS = {
    "en": "idiot idiots moron morons stupid dumb clown scum trash loser losers pathetic worthless disgusting fool garbage jerk",
    "de": "idiot idioten dumm dummkopf trottel abschaum müll versager erbärmlich wertlos ekelhaft depp blödmann",
    "fr": "idiot idiote imbécile stupide débile ordure minable dégoûtant crétin abruti pathétique",
    "es": "idiota imbécil estúpido estúpida basura patético inútil asqueroso payaso tonto escoria",
}


def _mean_upper(text: str) -> float:
    letters = sum(map(str.isalpha, text))
    return sum(map(str.isupper, text)) / letters if letters else 0.0


#: Pattern voters: each gives its vote on a text, from the text, its words, and how many different lexicon words it has.
PATTERNS: list[Callable[[str, list[str], int], int]] = [
    lambda text, words, hits: 1 if hits >= 2 else 0,
    lambda text, words, hits: 1 if hits >= 4 else 0,
    lambda text, words, hits: 1 if words and hits / len(set(words)) > 0.02 else 0,
    lambda text, words, hits: -1 if hits == 0 else 0,
    lambda text, words, hits: -1 if hits == 0 and len(words) >= 30 else 0,
    lambda text, words, hits: 1 if hits and text.count("!") > 3 else 0,
    lambda text, words, hits: 1 if hits and _mean_upper(text) > 0.5 else 0,
    lambda text, words, hits: 1 if hits and re.search(r"\b(you|du|tu|vous|usted)\b", text, re.IGNORECASE) else 0,
]

_WORD = re.compile(r"[^\W_]+")
_CHAR = np.zeros(256, dtype=bool)
_CHAR[ord("a") : ord("z") + 1] = True
_CHAR[ord("0") : ord("9") + 1] = True
_CHAR[128:] = True
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _hashed(data: np.ndarray, lo: int, hi: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word feature in bytes lo..hi; ``rows`` tells the text of each byte. Words end at a text's end."""
    b = data[lo:hi]
    inside = np.concatenate([[False], _CHAR[b], [False]])
    new_row = np.concatenate([[True], rows[1:] != rows[:-1], [True]]) if len(rows) else np.ones(1, bool)
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | new_row[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | new_row[1:])) + 1
    # Prefix sums of b_i * BASE^i modulo 2^64: the hash of any stretch is a difference, moved back to position 0.
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(b)), dtype=np.uint64)])
    back = _powers(_BACK, len(b) + 1)
    out_rows, out = [], []
    for kind in BEGINNINGS:
        own = slice(None) if kind == 0 else ends - starts > kind
        s = starts[own]
        e = ends if kind == 0 else s + kind
        out.append(_bucket((prefix[e] - prefix[s]) * back[s] + np.uint64(kind)))
        out_rows.append(rows[s])
    return np.concatenate(out_rows), np.concatenate(out)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _long_word(data: np.ndarray, lo: int, end: int, block: int) -> tuple[int, np.ndarray]:
    """(end, buckets) of a word that begins at ``lo`` and fills the next block: its hash is carried from block to block."""
    h, at = np.zeros(1, np.uint64), lo
    while at < end:
        part = data[at : min(at + block, end)]
        out = np.flatnonzero(~_CHAR[part])
        part = part[: out[0]] if len(out) else part
        h += np.sum((part.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(part)), dtype=np.uint64) * np.uint64(pow(_BASE, at - lo, 1 << 64))
        at += len(part)
        if len(out):
            break
    # Its beginnings are those of its first bytes, that is all but the whole word of them.
    first = data[lo : min(lo + max(BEGINNINGS) + 1, at)]
    _, begun = _hashed(first, 0, len(first), np.zeros(len(first), np.int64))
    return at, np.concatenate([_bucket(h), begun[1:]])


def features(texts: pa.Array, weights: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, row, bucket): the different features of each text, over runs of texts; with ``weights``, only weighted ones."""
    data, at = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    for start, end in runs(at, BLOCK_BYTES, 1 << 30):
        found = [np.zeros(0, np.int64)]
        lo = int(at[start])
        while lo < at[end]:
            hi = min(lo + 4 * BLOCK_BYTES, int(at[end]))
            between = np.flatnonzero(~_CHAR[data[lo:hi]]) if hi < at[end] else None
            if between is not None and len(between) == 0:
                hi, bucket = _long_word(data, lo, int(at[end]), hi - lo)
                row = np.zeros(len(bucket), np.int64)  # a text that is cut is a run of its own
            else:
                if between is not None:  # a block ends where a word does
                    hi = lo + int(between[-1]) + 1
                rows = np.repeat(np.arange(end - start), np.diff(np.clip(at[start : end + 1], lo, hi)))
                row, bucket = _hashed(data, lo, hi, rows)
            if weights is not None:
                some = weights[bucket] != 0
                row, bucket = row[some], bucket[some]
            found.append(np.unique(row << BUCKET_BITS | bucket))
            lo = hi
        both = np.unique(np.concatenate(found))
        yield start, end, both >> BUCKET_BITS, both & (BUCKETS - 1)


def telling(size: np.ndarray, ones: np.ndarray, share: float, looked_at: int) -> np.ndarray:
    """Whether so many of the texts with a feature are of class 1 that chance doesn't explain it, over all features looked at.

    By Chernoff's bound on the binomial tail, with a hundredth as the chance of one wrong feature among all.
    """
    rate = ones / np.maximum(size, 1)
    up = np.where(rate > 0, rate * np.log(np.maximum(rate, 1e-12) / share), 0) + np.where(rate < 1, (1 - rate) * np.log(np.maximum(1 - rate, 1e-12) / (1 - share)), 0)
    return (size >= 3) & (rate > share) & (size * up > np.log(max(looked_at, 1)) + np.log(100))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def terms_of(text: str | None) -> set[str]:
    """Words (``w:``) and beginnings of words (``b:``)."""
    words = set(words_of(text))
    return {f"w:{w}" for w in words} | {f"b:{w[:k]}" for w in words for k in BEGINNINGS[1:] if len(w) > k}


def without_copies(sample: DataFrame) -> DataFrame:
    """Of sampled texts of one label with the same words in the same order the row with the least key."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [hashlib.blake2b(" ".join(words_of(t.as_py())).encode(), digest_size=16).digest() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(same, pa.binary())], [*b.schema.names, "same"])

    marked = sample.select("key", "text", "label").mapInArrow(signed, "key string, text string, label int, same binary")
    return marked.groupBy("same", "label").agg(F.min(F.struct("key", "text")).alias("r")).select("r.key", "r.text", "label")


def induced_lexicon(sample: DataFrame) -> list[str]:
    """All terms that are ``telling`` and mostly in texts labelled 1, most frequent first; counted and chosen by Spark over the sample."""

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, label in zip(b.column("text"), b.column("label").to_pylist(), strict=True):
                terms = sorted(terms_of(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([label] * len(terms), pa.int32())], ["term", "label"])

    labelled = sample.where("label >= 0")
    share = labelled.agg(F.avg("label")).first()[0]
    if not share:
        return []
    share = float(np.clip(share, 0.01, 0.99))
    counted = checkpointed(labelled.select("text", "label").mapInArrow(emitted, "term string, label int").groupBy("term").agg(F.count("*").alias("size"), F.sum("label").alias("ones")).where("size >= 3"))
    looked_at = counted.count()
    # The bound of ``telling``, for terms with a rate over 0.9.
    rate = F.col("ones") / F.col("size")
    up = rate * F.log(rate / share) + F.when(rate < 1, (1 - rate) * F.log((1 - rate) / (1 - share))).otherwise(0.0)
    chosen = counted.where((rate > 0.9) & (rate > share) & (F.col("size") * up > float(np.log(max(looked_at, 1)) + np.log(100))))
    rows = chosen.select("term", "ones").collect()
    return [r["term"] for r in sorted(rows, key=lambda r: (-r["ones"], r["term"]))]


def votes(texts: list[str | None], lexicons: list[set[str]]) -> np.ndarray:
    """One row of votes for each text: of every lexicon, then of every pattern."""
    out = np.zeros((len(texts), len(lexicons) + len(PATTERNS)), dtype=np.int8)
    everything = set().union(*lexicons) if lexicons else set()
    for row, text in zip(out, texts, strict=True):
        words = words_of(text)
        mine = terms_of(text) & everything
        row[: len(lexicons)] = [1 if mine & x else 0 for x in lexicons]
        hits = len({w for w in set(words) if f"w:{w}" in mine or any(f"b:{w[:k]}" in mine for k in (4, 5, 6))})
        row[len(lexicons) :] = [p(text or "", words, hits) for p in PATTERNS]
    return out


@dataclass
class LabelModel:
    """Class share, and for each voter its parent (-1: none) and P(vote | class, parent's vote), votes as -1, 0, 1."""

    prior: float
    parents: np.ndarray
    tables: np.ndarray  # voter, parent's vote, vote, class

    def log_likelihoods(self, v: np.ndarray) -> np.ndarray:
        """log P(votes, class) of each row for both classes."""
        logs = np.log(self.tables)
        out = np.tile(np.log([1 - self.prior, self.prior]), (len(v), 1))
        for j, parent in enumerate(self.parents.tolist()):
            out += logs[j, v[:, parent] + 1 if parent >= 0 else np.zeros(len(v), np.int64), v[:, j] + 1]
        return out

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(class 1 | votes) of each row."""
        both = self.log_likelihoods(v)
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))


def _pair_counts(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected number of rows with votes a of voter j and b of voter k, by class: (j, a, k, b, class)."""
    n, m = v.shape
    hot = (v[:, :, None] == np.array([-1, 0, 1])).reshape(n, 3 * m).astype(np.float64)
    return np.stack([(hot * w[:, None]).T @ hot for w in (1 - p, p)], -1).reshape(m, 3, m, 3, 2)


def dependency_tree(pairs: np.ndarray) -> np.ndarray:
    """Each voter's parent in the tree with the largest mutual information within classes, from ``_pair_counts``; the first has none."""
    m = len(pairs)
    single = np.einsum("jajac->jac", pairs)
    total = single.sum(1)[:1]
    with np.errstate(divide="ignore", invalid="ignore"):
        information = pairs * np.log(pairs * total / (single[:, :, None, None] * single[None, None]))
    weight = np.nan_to_num(information).sum((1, 3, 4))
    parents, best = np.full(m, -1), np.zeros(m, dtype=np.int64)
    reach = weight[0].copy() if m else np.zeros(0)
    left = np.arange(m) > 0
    while left.any():
        j = int(np.argmax(np.where(left, reach, -np.inf)))
        parents[j], left[j] = best[j], False
        closer = left & (weight[j] > reach)
        reach[closer], best[closer] = weight[j][closer], j
    return parents


def estimated(pairs: np.ndarray, parents: np.ndarray, smoothing: float = 2.0) -> LabelModel:
    """Tables from expected counts; a vote of the parent that is rarely seen leaves the voter's own share."""
    single = np.einsum("jajac->jac", pairs) + 0.5
    own = single / single.sum(1, keepdims=True)
    tables = np.empty((len(parents), 3, 3, 2))
    for j, parent in enumerate(parents.tolist()):
        counts = pairs[parent, :, j] if parent >= 0 else np.zeros((3, 3, 2))
        with_own = counts + smoothing * own[j][None]
        tables[j] = with_own / with_own.sum(1, keepdims=True)
    size = np.einsum("jajac->jac", pairs)[0].sum(0)
    return LabelModel(float(np.clip((size[1] + 1) / (size.sum() + 2), 0.005, 0.6)), parents, tables)


def label_model(v: np.ndarray, first: np.ndarray, rounds: int = 60, trees: int = 12) -> LabelModel:
    """Fitted to votes by expectation maximisation; ``first`` is the posterior to begin with. The tree follows the first rounds."""
    p, parents = first.astype(float), np.full(v.shape[1], -1)
    model = None
    for k in range(rounds):
        pairs = _pair_counts(v, p)
        if 0 < k <= trees:
            parents = dependency_tree(pairs)
        model = estimated(pairs, parents)
        new = model.posterior(v)
        if k > trees and np.abs(new - p).max() < 1e-4:
            break
        p = new
    return model


def by_majority(v: np.ndarray) -> np.ndarray:
    """The posterior to begin with: sure where votes agree, the less the more they differ; unsure leans to clean."""
    up, down = (v == 1).sum(1), (v == -1).sum(1)
    return np.clip((up + 0.1) / (up + down + 1), 0.02, 0.98)


def train(rows: np.ndarray, buckets: np.ndarray, p: np.ndarray, rounds: int = 600, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Logistic regression on posterior labels, over the buckets that tell the classes apart."""
    n = len(p)
    size = np.bincount(buckets, minlength=BUCKETS)
    ones = np.bincount(buckets, weights=p[rows], minlength=BUCKETS)
    used = np.flatnonzero(telling(size, ones, float(np.clip(p.sum() / max(n, 1), 0.01, 0.99)), int((size >= 3).sum())) & (ones > 0.8 * size))
    weights = np.zeros(BUCKETS, dtype=np.float32)
    if not n:
        return Model(weights, -4.0)
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))
    own = place[buckets] >= 0
    r, c = rows[own], place[buckets[own]]
    w, bias, grad_w, grad_b = np.zeros(len(used)), -1.0, np.zeros(len(used)), 0.0
    importance = np.where(p > 0.5, 0.5 / max(p.sum(), 1), 0.5 / max(n - p.sum(), 1))
    for _ in range(rounds):
        z = bias + np.bincount(r, weights=w[c], minlength=n)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - p) * importance
        g = np.bincount(c, weights=error[r], minlength=len(used)) + decay / max(len(used), 1) * w
        grad_w, grad_b = grad_w + g * g, grad_b + error.sum() ** 2
        w = np.maximum(w - rate * g / np.sqrt(grad_w + 1e-12), 0)
        bias -= rate * error.sum() / np.sqrt(grad_b + 1e-12)
    weights[used] = w
    return Model(weights, float(bias))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample of ``docs`` (key, text) with ``labels`` (key, label), all of which may be learned from.

    Rows are drawn by key and label alone, so only the sample's texts are ever moved; its keys are few enough to broadcast.
    """
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).groupBy("_k").agg(F.max("_y").alias("label"))
    marked = docs.select(F.col(key).alias("_k")).join(known, "_k", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    labelled = bounded_sample(marked.where("label >= 0"), "label", "_k", SAMPLE_PER_LABEL)
    rest = bounded_sample(marked.where("label < 0"), "label", "_k", SAMPLE_UNLABELLED)
    drawn_keys = F.broadcast(labelled.unionByName(rest).distinct())
    texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("text")).join(drawn_keys, "_k").groupBy("_k", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = checkpointed(without_copies(texts.select(F.col("_k").cast("string").alias("key"), "text", "label")))
    learned = induced_lexicon(sample)
    # Terms are dealt to the induced lexicons in turn, so each has frequent and rare ones.
    lexicons = [{f"w:{w}" for w in x.split()} for x in INSULTS.values()] + [set(learned[i::LEXICON_VOTERS]) for i in range(min(LEXICON_VOTERS, len(learned)))]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [x.tobytes() for x in votes([t.as_py() for t in b.column("text")], lexicons)]
            buckets: list[bytes] = [b""] * len(b)
            for start, end, row, bucket in features(b.column("text")):
                for i, part in enumerate(np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, end - start)))):
                    buckets[start + i] = part.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), pa.array(v, pa.binary()), pa.array(buckets, pa.binary())], ["key", "label", "votes", "buckets"])

    # A few thousand rows of a few kilobytes: the sample's bound holds here too.
    drawn = sample.mapInArrow(seen, "key string, label int, votes binary, buckets binary").collect()
    drawn.sort(key=lambda r: r["key"])
    v = np.frombuffer(b"".join(r["votes"] for r in drawn), dtype=np.int8).reshape(len(drawn), len(lexicons) + len(PATTERNS)).astype(np.int64)
    p = label_model(v, by_majority(v)).posterior(v) if len(drawn) else np.zeros(0)
    sizes = [len(r["buckets"]) // 4 for r in drawn]
    model = train(np.repeat(np.arange(len(drawn), dtype=np.int32), sizes), np.frombuffer(b"".join(r["buckets"] for r in drawn), dtype=np.int32), p)
    if not (p > 0.5).any():  # nothing learned: the fixed lexicons decide
        fixed = sorted({w for x in INSULTS.values() for w in x.split()})
        for _, _, _, b in features(pa.array(fixed, pa.string())):
            model.weights[b] = 2.0
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if the score is 0.5 or more)."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.full(len(b), model.bias)
            for start, end, row, bucket in features(b.column(text), model.weights):
                z[start:end] += np.bincount(row, weights=model.weights[bucket], minlength=end - start)
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return docs.select(*names).mapInArrow(run, schema)
