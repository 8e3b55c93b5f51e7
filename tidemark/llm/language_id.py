"""Language identification by nearest centroid.

A text becomes a vector of hashed byte n-grams (two and three bytes of its lower-cased letters, other characters as one blank
kind), weighted by 1 + log(count) times the inverse document frequency and scaled to length 1. Each language has several
centroids, found by spherical k-means over a sample of its labelled texts; a text gets the language of the centroid with the
largest cosine. It is rejected if it lies about as far from that centroid as texts of other languages do: the limit is ``BETWEEN``
of the way from the cosine that all but a hundredth of the other languages' sample texts stay under to the one that all but a
hundredth of the language's own reach. As a short or monotonous text has few n-grams and so a small cosine with any centroid, the
least cosine asked for grows with the square root of the number of different n-grams up to ``FULL_GRAMS``.

The model is fitted on a sample of at most about ``SAMPLE_PER_LANGUAGE`` labelled texts for each of the ``MOST_LANGUAGES`` labels
with the most texts, and holds ``CENTROIDS`` vectors of ``DIMENSIONS`` numbers a language. Each language's centroids are found in
a task of its own; only they, a mean for each language and a document frequency for each dimension come to the driver (at most
64 MB, whatever the input's size and however many labels it has). Scoring is one pass over whole texts without a shuffle; a task
holds one Arrow batch, and a very long text is counted in blocks, which give the counts of the whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; with no labelled text at all every
text is; equal cosines give the language that is first in alphabetical order; rows of one label, id and text count once in the
sample; rows without an id are scored, but nothing is learned from them; repeated rows are scored each; an empty table gives no
rows; other columns are kept, but for those that are named as a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_sample, checkpointed, runs, utf8

DIMENSIONS = 1 << 13
CENTROIDS = 3
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 400, 200
#: Where the limit lies between the other languages' texts (0) and the language's own (1).
BETWEEN = 0.2
#: With no other language to compare with: the limit as a share of what all but a hundredth of the own texts reach.
REJECT_SHARE = 0.6
FULL_GRAMS = 600
BLOCK_BYTES = 1 << 20
UNKNOWN = "und"

# Letters stay as they are (bytes of other scripts too), all else is one blank kind.
_KIND = np.full(256, 32, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KIND[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # one row each, of length 1
    idf: np.ndarray
    least: np.ndarray  # the cosine below which a text is rejected, for each centroid


def _count_into(counts: np.ndarray, kinds: np.ndarray, row: np.ndarray, begin: int) -> None:
    """Add the n-grams that begin in the first ``begin`` bytes of a block; ``row`` tells which text a byte belongs to, and n-grams
    across texts don't count."""
    k = kinds.astype(np.uint32)
    for n in (2, 3):
        m = min(len(k) - n + 1, begin)
        if m <= 0:
            return
        gram = k[:m].copy()
        blank = kinds[:m] == 32
        for i in range(1, n):
            gram = (gram << np.uint32(8)) | k[i : m + i]
            blank = blank & (kinds[i : m + i] == 32)
        bucket = ((gram + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - 13)
        own = (row[:m] == row[n - 1 : m + n - 1]) & ~blank
        counts += np.bincount(row[:m][own] * DIMENSIONS + bucket[own], minlength=counts.size)


def vectors(texts: pa.Array, rows_at_once: int = 64) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, counts of n-grams by row) over runs of lower-cased texts."""
    data, at = utf8(texts)
    for start, end in runs(at, BLOCK_BYTES, rows_at_once):
        counts = np.zeros((end - start) * DIMENSIONS)
        # A long text takes more than one block; each sees two bytes of the next, where n-grams that begin in it may end.
        for lo in range(int(at[start]), int(at[end]), 4 * BLOCK_BYTES):
            hi = min(lo + 4 * BLOCK_BYTES + 2, int(at[end]))
            row = np.repeat(np.arange(end - start), np.diff(np.clip(at[start : end + 1], lo, hi)))
            _count_into(counts, _KIND[data[lo:hi]], row, 4 * BLOCK_BYTES)
        yield start, end, counts.reshape(end - start, DIMENSIONS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log(np.maximum(counts, 1), dtype=np.float32)
    v += counts > 0
    v *= idf
    length = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    v /= np.where(length > 0, length, 1)
    return v


def expected(counts: np.ndarray) -> np.ndarray:
    """By what share a text's number of different n-grams lowers the cosine to expect."""
    return np.sqrt(np.minimum((counts > 0).sum(1) / FULL_GRAMS, 1))


def spherical_means(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres of unit vectors; begins with the texts that are farthest from those taken so far."""
    centres = [v.mean(0)]
    while len(centres) < min(k, len(v)):
        centres.append(v[np.argmin(np.max(np.stack([v @ c / max(np.linalg.norm(c), 1e-12) for c in centres]), 0))])
    c = np.stack(centres)
    for _ in range(rounds):
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        near = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def limit(near: float, far: float | None) -> float:
    """The least cosine of a full-length text: from what all but a hundredth of the language's own sample texts reach, and what all but
    a hundredth of other languages' texts stay under (None: there are none)."""
    far = near if far is None else far
    return far + BETWEEN * (near - far) if far < near else REJECT_SHARE * near


def _dense(where: list[bytes], values: list[bytes]) -> np.ndarray:
    counts = np.zeros((len(where), DIMENSIONS), dtype=np.float32)
    for out, i, n in zip(counts, where, values, strict=True):
        out[np.frombuffer(i, np.int32)] = np.frombuffer(n, np.float32)
    return counts


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32)


def counted_sample(labelled: DataFrame, key: str, text: str, lang: str, sample: int) -> DataFrame:
    """(lang, i, n): the n-grams and their counts of a bounded sample of texts, chosen by a hash of id and text."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).withColumn("h", F.xxhash64("key", "text"))
    chosen = bounded_sample(usable, "lang", "h", sample, MOST_LANGUAGES).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where, values = [], []
            for _, _, counts in vectors(pc.utf8_lower(pc.fill_null(b.column("text"), ""))):
                for c in counts:
                    w = np.flatnonzero(c)
                    where.append(w.astype(np.int32).tobytes())
                    values.append(c[w].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(where, pa.binary()), pa.array(values, pa.binary())], ["lang", "i", "n"])

    return checkpointed(chosen.select("lang", "text").mapInArrow(sparse, "lang string, i binary, n binary"))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS) -> Model:
    """Fit on a bounded sample of the labelled texts."""
    rows = counted_sample(labelled, key, text, lang, sample)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMENSIONS, dtype=np.int64)
        for b in batches:
            df += np.bincount(np.frombuffer(b"".join(b.column("i").to_pylist()), np.int32), minlength=DIMENSIONS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(df)], ["bucket", "df"])

    texts, df = rows.count(), np.zeros(DIMENSIONS, dtype=np.int64)
    for r in rows.mapInArrow(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect():
        df[r["bucket"]] = r["df"]
    idf = (np.log((1 + texts) / (1 + df)) + 1).astype(np.float32)

    def of_frame(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """A language's vectors in an order of their own, and by what share each one's cosines are lowered."""
        counts = _dense(*zip(*sorted(zip(frame["i"], frame["n"], strict=True)), strict=True))
        return weighted(counts, idf), np.maximum(expected(counts), 1e-6)

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "mean": [of_frame(frame)[0].mean(0).astype(np.float32).tobytes()]})

    means = {r["lang"]: _array(r["mean"]) for r in rows.groupBy("lang").applyInPandas(mean, "lang string, mean binary").collect()}
    languages = sorted(means)
    if not languages:
        return Model([], np.zeros((0, DIMENSIONS)), idf, np.zeros(0))
    directions = np.stack([means[x] / max(np.linalg.norm(means[x]), 1e-12) for x in languages])

    def centroids(frame: pd.DataFrame) -> pd.DataFrame:
        own, share = of_frame(frame)
        c = spherical_means(own, k)
        # A cluster that lies nearer to another language's mean holds mislabelled texts.
        good = np.flatnonzero(np.argmax(directions @ c.T, 0) == languages.index(frame["lang"].iloc[0]))
        good = good if len(good) else np.zeros(1, dtype=np.int64)
        near = float(np.quantile((own @ c.T).max(1) / share, 0.01))
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "number": good, "centroid": [c[i].astype(np.float32).tobytes() for i in good], "near": near})

    found = rows.groupBy("lang").applyInPandas(centroids, "lang string, number int, centroid binary, near double").collect()
    found.sort(key=lambda r: (r["lang"], r["number"]))
    of = np.array([languages.index(r["lang"]) for r in found])
    table = np.stack([_array(r["centroid"]) for r in found])

    def to_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                counts = _dense(part.column("i").to_pylist(), part.column("n").to_pylist())
                v, share = weighted(counts, idf), np.maximum(expected(counts), 1e-6)
                label = np.array([languages.index(x) for x in part.column("lang").to_pylist()])
                # Texts that lie nearer to another language's mean than to their own's may be mislabelled; they tell nothing of distances.
                typical = np.argmax(v @ directions.T, 1) == label
                cosines = v @ table.T / share[:, None]
                best = np.stack([cosines[:, of == x].max(1) for x in range(len(languages))], 1)
                some = typical[:, None] & (np.arange(len(languages)) != label[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(some)[1].astype(np.int32)), pa.array(best[some].astype(np.float64))], ["lang", "cosine"])

    far = {r["lang"]: r["far"] for r in rows.mapInArrow(to_others, "lang int, cosine double").groupBy("lang").agg(F.percentile("cosine", 0.99).alias("far")).collect()}
    return Model([r["lang"] for r in found], table, idf, np.array([limit(r["near"], far.get(x)) for r, x in zip(found, of.tolist(), strict=True)]))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(text), "")
            letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
            best = np.full(len(texts), -1)
            score, share = np.zeros(len(texts)), np.ones(len(texts))
            if model.languages:
                for start, end, counts in vectors(pc.utf8_lower(texts)):
                    cosines = weighted(counts, model.idf) @ model.centroids.T
                    best[start:end] = np.argmax(cosines, 1)
                    score[start:end] = np.clip(np.max(cosines, 1), 0, 1)
                    share[start:end] = expected(counts)
            known = letters & (best >= 0)
            score = np.where(known, score, 0.0)
            rejected = ~known | (score < np.append(model.least, 0.0)[best] * share)
            lang = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*names, "lang_pred", "score", "rejected"])

    return docs.select(*names).mapInArrow(scored, schema)
