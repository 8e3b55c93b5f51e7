"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has a bit set where more than half of a text's word shingles have it in their XXH64 (seed 42). Two fingerprints
are linked if at most ``RADIUS`` = 3 of 64 bits differ. Equal fingerprints are one class, so copies cost one row.

Candidates: the 64 bits are a ring of four segments of 16. Among all ring positions there is one from which every chain of
consecutive segments keeps to its share of the three differences: 0 in the first segment, at most 1 in the first two, 2 in
the first three, 3 in all. As the second segment then has at most one difference, one of its halves has none: a class has
eight keys of 24 bits (position, segment, half of the next), and a pair that fits meets at one of them. What meets must pass
the chain's budgets before the full comparison.

A key that many classes share (over ``DENSE``) is not joined; it is split: of its remaining bits, cut in four parts, one part has
no difference, so the key with each part added finds every pair again. This goes on until no key is dense, or so few bits remain
that the number of classes with the key is bounded by them. Nothing is capped or dropped.

Defined results: fingerprint 0 for null and empty texts, linked like any other; repeated rows get the same result each; rows with
a null id are linked like others and get the least id there is; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpointed
from tidemark.llm.components import connected_components

RADIUS, SEGMENTS, SEGMENT_BITS = 3, 4, 16
DENSE = 256
#: Splitting ends here: classes that share a key with so few bits left are at most 2 ** FREE_BITS.
FREE_BITS = 12
SHINGLES_AT_ONCE = 1 << 16
#: Two shingle sets of Jaccard similarity J share a band with a chance of 1 - (1 - J ** BAND_ROWS) ** BANDS: 0.9993 at 0.8.
BANDS, BAND_ROWS = 24, 6
SALTS = 8


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 independent bits from each hash; the hash itself for word 0."""
    if word == 0:
        return h
    h = h + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _add_ones(ones: np.ndarray, h: np.ndarray) -> None:
    for w in range(len(ones)):
        ones[w] += np.unpackbits(_mixed(h, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> list[int]:
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view(np.uint64)[:, 0].tolist()


def vocabulary_fingerprint(text: str | None, n_words: int) -> list[int]:
    """``n_words`` independent 64-bit fingerprints of the set of a text's words."""
    words = list(set((text or "").encode().lower().split()))
    if not words:
        return [0] * n_words
    ones = np.zeros((n_words, 64), dtype=np.int64)
    for lo in range(0, len(words), SHINGLES_AT_ONCE):
        _add_ones(ones, np.array([xxhash.xxh64_intdigest(w, 42) for w in words[lo : lo + SHINGLES_AT_ONCE]], dtype=np.uint64))
    return _majority(ones, len(words))


def fingerprint(text: str | None, width: int = 3) -> list[int]:
    """The 64-bit fingerprint (unsigned) of the whole text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return [0]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends[width - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((1, 64), dtype=np.int64)
    for lo in range(0, len(ends), SHINGLES_AT_ONCE):
        own = ends[lo : lo + SHINGLES_AT_ONCE]
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[lo : lo + len(own)], own, strict=True)], dtype=np.uint64)
        _add_ones(ones, h)
    return _majority(ones, len(ends))


def fingerprints(docs: DataFrame, text: str, one: Callable[[str | None], list[int]]) -> DataFrame:
    """``docs`` without ``text``, with ``fps``: the fingerprints that ``one`` makes of the text, as signed longs."""
    names = [c for c in docs.columns if c not in (text, "fps")]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("fps", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.array(one(t.as_py()), dtype=np.uint64).view(np.int64) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, pa.list_(pa.int64()))], [*names, "fps"])

    return docs.select(*names, text).mapInArrow(run, schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _segment(i: int) -> int:
    return ((1 << SEGMENT_BITS) - 1) << (SEGMENT_BITS * (i % SEGMENTS))


def _first_masks() -> list[tuple[int, int]]:
    """(ring position, mask of the 24 bits) of the eight keys."""
    half = (1 << SEGMENT_BITS // 2) - 1
    return [(i, _segment(i) | half << (SEGMENT_BITS * ((i + 1) % SEGMENTS) + shift)) for i in range(SEGMENTS) for shift in (0, SEGMENT_BITS // 2)]


def _split(mask: int) -> list[int]:
    """The mask with each of four parts of its remaining bits added."""
    left = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in part.tolist()) for part in np.array_split(np.array(left), RADIUS + 1)]


def _keys(classes: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """Each row of ``classes`` once for each key: its columns with start, mask and bits."""
    keys = F.array(*[F.struct(F.lit(i).alias("start"), F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in masks])
    return classes.select("*", F.explode(keys).alias("k")).select(*classes.columns, "k.*")


def _close(a: Column, b: Column, start: Column) -> Column:
    """Fingerprints whose chain from ``start`` keeps to its budgets, and that differ in at most RADIUS bits."""
    difference = a.bitwiseXOR(b)
    return _chain(difference, start) & (F.bit_count(difference) <= RADIUS)


def _chain(difference: Column, start: Column) -> Column:
    """Whether the chain of segments from ``start`` keeps to its budgets."""
    found = None
    for i in range(SEGMENTS):
        ok, mask = F.lit(True), 0
        for length in range(1, SEGMENTS + 1):
            mask |= _segment(i + length - 1)
            ok = ok & (F.bit_count(difference.bitwiseAND(F.lit(_signed(mask)))) <= length * RADIUS // SEGMENTS)
        found = F.when(start == i, ok) if found is None else found.when(start == i, ok)
    return found


def linked_pairs(classes: DataFrame, dense: int = DENSE) -> DataFrame:
    """(a, b), a < b: all pairs of different fingerprints in column ``fp`` that differ in at most three bits."""
    keys = _keys(classes, _first_masks())
    free = 64 - bin(_first_masks()[0][1]).count("1")
    pairs = None
    while True:
        crowded, masks = None, []
        if free > FREE_BITS:
            crowded = checkpointed(keys.groupBy("start", "mask", "bits").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("start", "mask", "bits"))
            # The masks that dense keys have: a few hundred at most, whatever the data.
            masks = [r["mask"] % (1 << 64) for r in crowded.select("mask").distinct().collect()]
        here = keys.join(crowded, ["start", "mask", "bits"], "left_anti") if masks else keys
        left, right = here.select("start", "mask", "bits", F.col("fp").alias("a")), here.select("start", "mask", "bits", F.col("fp").alias("b"))
        found = left.join(right, ["start", "mask", "bits"]).where((F.col("a") < F.col("b")) & _close(F.col("a"), F.col("b"), F.col("start"))).select("a", "b")
        pairs = found if pairs is None else pairs.unionByName(found)
        if not masks:
            return pairs.distinct()
        finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in _split(m)]))])
        rows = keys.join(crowded, ["start", "mask", "bits"], "left_semi").select("fp", "start", F.explode(finer[F.col("mask")]).alias("mask"))
        keys = checkpointed(rows.select("fp", "start", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bits")))
        free = max(64 - bin(c).count("1") for m in masks for c in _split(m))


def group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): component_id is the least key reachable by links, itself included (null if no row has a key)."""
    rows = checkpointed(fingerprints(docs.select(key, text), text, fingerprint).select(key, F.get("fps", F.lit(0)).alias("fp")))
    classes = rows.groupBy("fp").agg(F.min(key).alias("rep"))
    components = connected_components(linked_pairs(classes.select("fp")))
    named = classes.join(components, classes["fp"] == components["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows.join(named.join(least, "component").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the different word shingles of a text, in order."""
    words = (text or "").encode().lower().split()
    shingles = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}
    return np.array(sorted(xxhash.xxh64_intdigest(x) for x in shingles), dtype=np.uint64)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, text) to (id, s): hashes of the different word shingles of each text (of all its words if it has fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_shingles(t.as_py(), width).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.list_(pa.int64()))], ["id", "s"])

    return docs.select("id", "text").mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("s", T.ArrayType(T.LongType()))]))


def marks(texts: DataFrame, n_words: int, width: int, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """``texts`` without ``text``, with fps (fingerprints of the word set) and bands (for each band a hash of the least values that
    ``rows`` orders give of the text's shingles)."""
    orders = np.random.default_rng(42).integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    names = [c for c in texts.columns if c != "text"]
    longs = T.ArrayType(T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [np.array(vocabulary_fingerprint(t.as_py(), n_words), dtype=np.uint64).view(np.int64) for t in b.column("text")]
            banded = [_banded(_shingles(t.as_py(), width), orders, bands) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(words, pa.list_(pa.int64())), pa.array(banded, pa.list_(pa.int64()))], [*names, "fps", "bands"])

    return texts.mapInArrow(run, T.StructType([*(texts.schema[c] for c in names), T.StructField("fps", longs), T.StructField("bands", longs)]))


def _banded(shingles: np.ndarray, orders: np.ndarray, bands: int) -> np.ndarray:
    """The hash of each band, as signed longs."""
    least = np.full(len(orders), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), 512):
        least = np.minimum(least, (orders[:, None] * shingles[lo : lo + 512]).min(1))
    out = [xxhash.xxh64_intdigest(x.tobytes(), 42) for x in least.reshape(bands, -1)]
    return np.array(out, dtype=np.uint64).view(np.int64)


def band_pairs(banded: DataFrame) -> DataFrame:
    """(a, b), a > b: every row of (id, band, h) with the first of those that share its band's hash."""
    first = banded.groupBy("band", "h").agg(F.min("id").alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "h", "b")
    return banded.join(first, ["band", "h"]).where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def candidate_pairs(marked: DataFrame, few: int = 16) -> DataFrame:
    """(a, b), a > b: ids of rows (id, word, fp) that may be near-equal, without all pairs of a large group.

    Rows with an equal fingerprint are compared with the first of them. Different fingerprints that share a key are compared
    all with all where they are few, and else with four leaders of the key (the least and the greatest, by value and by a
    hash); as a text has eight keys in each word, it meets other leaders in each of them. Joins are merged whatever their size, as
    in ``connected_components``: no table is built in the driver.
    """
    tied = marked.groupBy("word", "fp").agg(F.min("id").alias("id"))
    within = marked.join(tied.withColumnRenamed("id", "first").hint("merge"), ["word", "fp"]).select(F.col("id").alias("a"), F.col("first").alias("b"))
    keys = _keys(tied, _first_masks())
    on = ["word", "start", "mask", "bits"]
    one = F.struct("fp", "id")
    hashed = F.xxhash64("fp")
    shared = keys.groupBy(*on).agg(F.count("*").alias("n"), F.min(one).alias("l1"), F.max(one).alias("l2"), F.min_by(one, hashed).alias("l3"), F.max_by(one, hashed).alias("l4")).where("n > 1")
    led = keys.join(shared.hint("merge"), on).select("start", "n", "fp", "id", *on[:1], "mask", "bits", F.explode(F.array("l1", "l2", "l3", "l4")).alias("l")).where(_close(F.col("fp"), F.col("l.fp"), F.col("start")))
    small = keys.join(shared.where(F.col("n").between(3, few)).select(*on).hint("merge"), on, "left_semi")
    met = small.select(*on, F.col("fp").alias("fa"), F.col("id").alias("a")).join(small.select(*on, F.col("fp").alias("fb"), F.col("id").alias("b")).hint("merge"), on).where((F.col("a") > F.col("b")) & _close(F.col("fa"), F.col("fb"), F.col("start")))
    found = within.unionByName(led.select(F.col("id").alias("a"), F.col("l.id").alias("b"))).unionByName(met.select("a", "b"))
    return found.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def undecided(marked: DataFrame, banded: DataFrame, few: int = 16) -> DataFrame:
    """(id, component): the rows of keys and bands that the first comparisons neither settled nor compared pair by pair.

    For rows (id, component, word, fp) and (id, component, band, h) with the components of the links so far. A key or band whose
    rows are all in one component is settled; one of at most ``few`` different fingerprints has been compared all with all.
    """
    on = ["word", "start", "mask", "bits"]
    known = marked.groupBy("word", "fp").agg(F.min("id").alias("first"))
    keys = _keys(marked.join(known, ["word", "fp"]).select("word", "fp", "id", "component", (F.col("id") == F.col("first")).cast("long").alias("leads")), _first_masks())
    n, fps = F.count("*"), F.sum("leads")
    open_keys = keys.groupBy(*on).agg(n.alias("n"), fps.alias("fps"), F.min("component").alias("c0"), F.max("component").alias("c1")).where((F.col("c0") != F.col("c1")) & ((F.col("n") > few) | (F.col("n") > F.col("fps"))))
    open_bands = banded.groupBy("band", "h").agg(n.alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1 and n > 2")
    return keys.join(open_keys.select(*on), on, "left_semi").select("id", "component").unionByName(banded.join(open_bands.select("band", "h"), ["band", "h"], "left_semi").select("id", "component")).distinct()


def prefix_pairs(sets: DataFrame, least: float) -> DataFrame:
    """(a, b), a > b: an exact filter for rows (id, component, s): no pair of two components with a Jaccard similarity of ``least`` is lost.

    All shingles have one order, rare ones first. With n shingles, a set must have one of its first n - least * n + 1 in common
    with any similar set; of two similar sets the smaller one must have it even in its first n - 2 * least / (1 + least) * n + 1, and
    what follows the first common shingle must be long enough in both. So a passage that many texts share, or the body of a
    large group of near copies, makes no pairs by itself. The smaller set stands in one bucket of its size, the larger one asks
    the buckets of the sizes that its place in the order leaves possible. A shingle whose rows are of one component is settled;
    with the others, rows of its largest component don't meet each other.
    """
    n, room = F.col("n"), 1e-9
    alike = least / (1 + least)
    tokens = sets.select("id", "component", F.size("s").alias("n"), F.explode("s").alias("t"))
    shared = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(shared, "t").groupBy("id", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("r"))
    # Shingles of one text only come first in the order and meet nothing: they count as places.
    placed = ordered.select("id", "component", "n", (n - F.size("r")).alias("alone"), F.posexplode("r").alias("k", "x")).select("id", "component", "n", (F.col("alone") + F.col("k")).alias("before"), "x.t")
    # ``before`` shingles precede this one; the larger set's partner has at most ``top`` shingles.
    top = F.least(n, F.floor(((1 - alike) * n - F.col("before") + room) / alike))
    bucket = lambda size: F.floor(F.log(F.greatest(size, F.lit(1))) * 50).cast("int")
    probes = placed.withColumn("top", top).where(F.col("top") >= least * n - room)
    probes = checkpointed(probes)
    parts = probes.groupBy("t", "component").agg(F.count("*").alias("c"))
    open_ = parts.groupBy("t").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("c", "component")).alias("main")).where("parts > 1")
    # A shingle that a large group shares is one key: its rows are dealt to SALTS parts, and what they are joined with goes to each.
    salt, all_salts = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    here = probes.withColumn("salt", salt).join(open_.select("t", "main", all_salts.alias("salt")), ["t", "salt"])
    small = here.where(n - F.col("before") >= 2 * alike * n - room).select("t", bucket(n).alias("size"), "main", F.col("id").alias("a"), F.col("component").alias("ca"), n.alias("na"), F.col("before").alias("pa"), all_salts.alias("salt"))
    large = here.select("t", F.explode(F.sequence(bucket(F.ceil(least * n - room)), bucket(F.col("top")))).alias("size"), F.col("id").alias("b"), F.col("component").alias("cb"), n.alias("nb"), F.col("before").alias("pb"), (F.col("component") == F.col("main")).alias("in_main"), "salt")
    fits = (F.col("ca") != F.col("cb")) & (F.col("na") <= F.col("nb")) & (F.col("na") >= least * F.col("nb") - room) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= alike * (F.col("na") + F.col("nb")) - room)
    on = ["t", "size", "salt"]
    strays = small.where("ca <> main").join(large, on).where(fits)
    of_main = small.where("ca = main").join(large.where("not in_main"), on).where(fits)
    return strays.select("a", "b").unionByName(of_main.select("a", "b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows of ``pairs`` (a, b) whose shingle sets (id, s) have a Jaccard similarity of ``least``."""
    compared = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return compared.where(both >= least * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _hashes(text: str) -> tuple[Column, Column]:
    """128 bits that tell texts apart; null is a text of its own."""
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")


def _text_groups(docs: DataFrame, text: str, n_words: int, width: int, least: float) -> DataFrame:
    """(h1, h2, g): texts by their hashes with the number of their group of near-duplicates."""
    whole = docs.select(*_hashes(text), F.col(text).alias("text"))
    # The checkpoint fixes the numbers: nothing behind it makes them again.
    texts = checkpointed(whole.groupBy("h1", "h2").agg(F.first("text").alias("text")).select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "text"))
    names = texts.select("id", "h1", "h2")
    marked = checkpointed(marks(texts.select("id", "text"), n_words, width))

    def sets_of(ids: DataFrame) -> DataFrame:
        return checkpointed(shingle_sets(texts.select("id", "text").join(ids, "id", "left_semi"), width))

    fps = marked.select("id", F.posexplode("fps").alias("word", "fp"))
    bands = marked.select("id", F.posexplode("bands").alias("band", "h"))
    pairs = checkpointed(candidate_pairs(fps).unionByName(band_pairs(bands)).distinct())
    links = checkpointed(similar(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), least))
    settled = checkpointed(connected_components(links))
    component = F.coalesce("component", "id").alias("component")
    with_component = lambda rows: rows.join(settled, rows["id"] == settled["node"], "left").select(*rows.columns, component)
    left = checkpointed(undecided(checkpointed(with_component(fps)), with_component(bands)))
    sets = checkpointed(sets_of(left.select("id")).join(left, "id"))
    more = similar(checkpointed(prefix_pairs(sets, least)), sets, least)
    # The settled components stand for the links that made them.
    components = connected_components(settled.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    return names.join(components, F.col("id") == F.col("node"), "left").select("h1", "h2", F.coalesce("component", "id").alias("g"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = 6, width: int = 5, least: float = 0.8) -> DataFrame:
    """(key, component_id) of documents grouped by equal texts and by links of near-equal texts.

    Candidates come from two sources. ``n_words`` independent SimHash fingerprints of a text's set of words: two texts are
    candidates if one of the fingerprints differs in at most three bits. And ``BANDS`` bands of ``BAND_ROWS`` least hashes of the
    set of ``width``-word shingles: two texts are candidates if a band is equal, which depends on the Jaccard similarity alone
    and so finds replaced, added and cut passages, where new words move SimHash by more than three bits. A candidate is a link
    if the shingle sets, compared exactly, have a Jaccard similarity of ``least``, so no chance likeness groups two texts. In large
    keys texts are first compared with leaders; the rows of keys that this leaves in different components then go through
    an exact prefix filter (``prefix_pairs``), so no link among them is left out.

    component_id is the least key of the group, null if no row of it has one; rows of one key with different texts are told
    apart by their texts, so one key may have several components; null and empty texts, and all without a word, are one group.
    """
    rows = docs.select(key, *_hashes(text)).join(_text_groups(docs, text, n_words, width, least), ["h1", "h2"])
    rows = checkpointed(rows.select(key, "g"))
    return rows.join(rows.groupBy("g").agg(F.min(key).alias("component_id")), "g").select(key, "component_id")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n_words: int = 6, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the one with the least key.

    A null key comes last, ties between different texts are broken by their hashes. Rows of one key and one text are one
    document, and one of them stays; rows of one key with texts that aren't near-equal all stay.
    """
    names = docs.columns
    groups = _text_groups(docs, text, n_words, width, least)
    place = F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("key"), "h1", "h2")
    first = docs.select(key, *_hashes(text)).join(groups, ["h1", "h2"]).groupBy("g").agg(F.min(place).alias("p"))
    first = first.select(F.col("p.key").alias("_key"), F.col("p.h1").alias("_h1"), F.col("p.h2").alias("_h2"))
    h1, h2 = _hashes(text)
    kept = docs.join(first, F.col(key).eqNullSafe(F.col("_key")) & (h1 == F.col("_h1")) & (h2 == F.col("_h2")))
    return kept.dropDuplicates(["_key", "_h1", "_h2"]).select(*names)
