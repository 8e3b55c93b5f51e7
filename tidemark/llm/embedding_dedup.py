"""Embedding near-duplicates by an exact metric range join.

Cosine c between unit vectors is Euclidean distance sqrt(2 - 2c), a metric. Pivots drawn from the vectors, about sqrt(n) of them,
cut space into cells: a vector's home is the cell of its nearest pivot p, of two that each pivot has: the ball of 2r around it, and
what lies outside. By the triangle inequality a vector v can be within r of a member of cell j only if
d(v, p_j) - d(v, p_home) <= 2r and d(v, p_j) lies between the least and the largest distance of members of j from p_j, or at most r
outside; in Euclidean space the first is sharpened to v's distance from the plane halfway between the two pivots, which must
not exceed r. So a dense cluster is a cell of small extent, whatever else is nearest to its pivot.

Neighbouring cells are packed into regions of at most ``block`` vectors, so that a vector travels to a region once, however
many of its cells it may reach: v is sent to just those regions of a lower number that hold such a cell, each pair of vectors
meets in one region, and regions are joined independently. Vectors that are equal in every component are one class and travel once.

A region's vectors and its visitors are cut by a hash into blocks; each pair of blocks is one group, compared by blocked matrix
products in double precision. So a hot cell becomes many tasks of one size. No pair of vectors is ever emitted: a group gives
each vector's number of links and a spanning forest of its links.

A block holds an eighth of the vectors, and at most ``BLOCK_BYTES``: where the bounds prune nothing, a vector is copied to about
as many groups as there are blocks, eight until n vectors outgrow eight blocks' bytes (524,288 of 64 dimensions), then n times their bytes over
``BLOCK_BYTES``. The driver holds the pivots, and for each of them two counts and a radius: they grow as the root of n (51 MB of
pivots at 10 billion vectors of 64 dimensions). ``pruned`` tells what share of all pairs the bounds leave out: in 64 dimensions
vectors without clusters are about as far from every pivot, and nearly none is.

Defined results: null and zero vectors, and those with null or non-finite components, link with nothing; nor does a vector
link with one of another length; a null id has no links and a null component; repeated rows are vectors of their own and link
with each other (rows of one id with different vectors show the most links and the least component of them); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed
from tidemark.llm.components import connected_components

#: Bytes of doubles in a block, and into how many blocks vectors are cut at least (of ``LEAST_BLOCK`` vectors or more).
BLOCK_BYTES = 32 << 20
BLOCKS, LEAST_BLOCK = 8, 64
ROWS_AT_ONCE, COLUMNS_AT_ONCE, CELLS_AT_ONCE = 512, 8192, 1 << 21
#: Distances are compared with so much room for rounding; links themselves are compared as they are.
ROOM = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.maximum(np.abs(v).max(1, keepdims=True), np.finfo(np.float64).tiny)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _codes(values: np.ndarray) -> pa.Array:
    """Each row's doubles as bytes."""
    rows, dims = values.shape
    return pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(np.arange(rows + 1, dtype=np.int64) * dims * 8), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _matrix(codes: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Unit vectors from the bytes of doubles."""
    chunks = codes.chunks if isinstance(codes, pa.ChunkedArray) else [codes]
    parts = [np.zeros((0, dims))]
    for c in chunks:
        c = c.cast(pa.large_binary())
        _, offsets, data = c.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[c.offset : c.offset + len(c) + 1]
        if len(c):
            parts.append(np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(np.float64).reshape(-1, dims))
    return unit(np.concatenate(parts))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, code, dims) of the vectors that can link; ``code`` holds the components as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.fill_null(pc.list_value_length(b.column("v")), 0)
            known = pc.is_valid(b.column("id"))
            for dims in pc.unique(lengths).to_pylist():
                part = b.filter(pc.and_(known, pc.equal(lengths, dims)))
                if not dims or not part.num_rows:
                    continue
                # A null component becomes NaN here; adding 0 makes one of the two zeros.
                x = part.column("v").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims) + 0.0
                good = np.isfinite(x).all(1) & x.any(1)
                n = int(good.sum())
                yield pa.RecordBatch.from_arrays([part.column("id").filter(pa.array(good)), _codes(x[good]), pa.array(np.full(n, dims, np.int32))], ["id", "code", "dims"])

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, code binary, dims int")


class Cells:
    """Pivots of one vector length, and which cells a vector belongs or is sent to: 2 j is pivot j's ball, 2 j + 1 the rest."""

    def __init__(self, pivots: np.ndarray, radius: float):
        self.pivots, self.radius = pivots, radius

    def __len__(self) -> int:
        return 2 * len(self.pivots)

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * v @ self.pivots.T, 0))

    def homes(self, d: np.ndarray) -> np.ndarray:
        return 2 * np.argmin(d, 1) + (d.min(1) > 2 * self.radius)

    def reached(self, d: np.ndarray, home: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Boolean matrix: cells that may hold a vector within the radius. ``least``, ``most``: how far each cell's members are from
        its pivot (infinite and -infinite if there are none)."""
        room = self.radius + ROOM
        own = d[np.arange(len(d)), home // 2][:, None]
        plane = (d * d - own * own) / np.maximum(2 * self.distances(self.pivots[home // 2]), 1e-12)
        near = (d - own <= 2 * room) & (plane <= room)
        at = np.repeat(d, 2, axis=1)
        return np.repeat(near, 2, axis=1) & (at <= most + room) & (at >= least - room)

    def at_once(self) -> int:
        """How many vectors to look at together."""
        return max(1, CELLS_AT_ONCE // len(self))


@dataclass
class Regions:
    """Cells packed into regions; cells and regions are numbered through all vector lengths."""

    of_cell: np.ndarray
    members: np.ndarray  # vectors at home in each region
    block: np.ndarray  # vectors in a block, for each region


def packed(cells: Cells, members: np.ndarray, block: int) -> np.ndarray:
    """A region number for each cell: balls follow what lies outside them, cells near the same pivot follow each other, and a region is
    full at ``block`` vectors."""
    d = np.repeat(cells.distances(cells.pivots[: BLOCKS * 4]), 2, axis=1)
    order = np.lexsort((d.min(0), np.argmin(d, 0), np.arange(len(cells)) % 2 == 0))
    out, region, filled = np.zeros(len(members), dtype=np.int64), 0, 0
    for j in order.tolist():
        if filled and filled + members[j] > block:
            region, filled = region + 1, 0
        out[j] = region
        filled += int(members[j])
    return out


class Forest:
    """Disjoint sets of positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, members: list[int]) -> None:
        roots = {self.root(x) for x in members}
        least = min(roots)
        for r in roots:
            self.parent[r] = least


def _join_linked(mask: np.ndarray, left: np.ndarray, right: np.ndarray, forest: Forest) -> None:
    """Join the positions (left of rows, right of columns) that the mask links, by least labels handed to and fro."""
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    if not len(rows):
        return
    sub = mask[np.ix_(rows, columns)]
    of_column = np.arange(len(columns))
    none = len(columns)
    while True:
        of_row = np.where(sub, of_column, none).min(1)
        new = np.where(sub, of_row[:, None], none).min(0)
        if (new == of_column).all():
            break
        of_column = new
    places = np.concatenate([left[rows], right[columns]])
    labels = np.concatenate([of_row, of_column])
    order = np.argsort(labels, kind="stable")
    for part in np.split(places[order], np.flatnonzero(np.diff(labels[order])) + 1):
        forest.join(part.tolist())


def compare(group: pa.Table, least: float) -> pa.Table:
    """One home block with one block of mates (of the same region) and visitors: links of each vector, and a spanning forest."""
    dims = group.column("dims")[0].as_py()
    role = np.asarray(group.column("role").combine_chunks())  # 0: home block, 1: mate, 2: visitor
    ids, copies = (np.asarray(group.column(c).combine_chunks()) for c in ("id", "copies"))
    v = _matrix(group.column("code"), dims)
    home, others = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
    degree = np.zeros(len(ids), dtype=np.int64)
    forest = Forest(len(ids))
    for first in range(0, len(others), COLUMNS_AT_ONCE):
        other = others[first : first + COLUMNS_AT_ONCE]
        visitor = role[other] == 2
        right = v[other].T.copy()
        for lo in range(0, len(home), ROWS_AT_ONCE):
            block = home[lo : lo + ROWS_AT_ONCE]
            mask = v[block] @ right >= least
            rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
            if not len(rows):
                continue
            sub = mask[np.ix_(rows, columns)].astype(np.float64)
            degree[block[rows]] += np.rint(sub @ copies[other[columns]]).astype(np.int64)
            degree[other[columns]] += np.where(visitor[columns], np.rint(copies[block[rows]] @ sub), 0).astype(np.int64)
            _join_linked(mask, block, other, forest)
    # A vector of the region has one position as home and one as mate: both mean the same class, and are joined by their own link.
    root = np.array([forest.root(i) for i in range(len(ids))], dtype=np.int64)
    tied = np.flatnonzero(ids != ids[root])
    some = np.flatnonzero(degree)
    return pa.table(
        {
            "a": pa.array(np.concatenate([ids[some], ids[tied]])),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[root[tied]])]),
            "n": pa.concat_arrays([pa.array(degree[some]), pa.nulls(len(tied), pa.int64())]),
        }
    )


def blocks(classes: DataFrame, least: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(region, h, o, role, id, copies, dims, code): each class of (dims, code, id, copies) in every group that it is compared in."""
    radius = float(np.sqrt(2 - 2 * least))
    sizes = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    cells, block = {}, {}
    for dims, n in sizes.items():
        chosen = classes.where(F.col("dims") == dims).orderBy(F.xxhash64("id"), "id").limit(int(np.ceil(np.sqrt(n)))).select("code").collect()
        cells[dims] = Cells(unit(np.stack([np.frombuffer(r["code"], dtype=np.float64) for r in chosen])), radius)
        block[dims] = max(1, min(max(LEAST_BLOCK, -(-n // BLOCKS)), block_bytes // (8 * dims)))
    first = {dims: sum(len(cells[x]) for x in sorted(cells) if x < dims) for dims in cells}

    def by_dims(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
        for dims in pc.unique(b.column("dims")).to_pylist():
            part, step = b.filter(pc.equal(b.column("dims"), dims)), cells[dims].at_once()
            for lo in range(0, part.num_rows, step):
                some = part.slice(lo, step)
                d = cells[dims].distances(_matrix(some.column("code"), dims))
                yield dims, some, d, cells[dims].homes(d)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, _, d, home in by_dims(b):
                yield pa.RecordBatch.from_arrays([pa.array((home + first[dims]).astype(np.int32)), pa.array(d.min(1))], ["cell", "far"])

    n_cells = sum(map(len, cells.values()))
    least_far, most_far, members = np.full(n_cells, np.inf), np.full(n_cells, -np.inf), np.zeros(n_cells, dtype=np.int64)
    for r in classes.mapInArrow(at_home, "cell int, far double").groupBy("cell").agg(F.min("far").alias("near"), F.max("far").alias("far"), F.count("*").alias("n")).collect():
        least_far[r["cell"]], most_far[r["cell"]], members[r["cell"]] = r["near"], r["far"], r["n"]
    of_cell, room = np.zeros(n_cells, dtype=np.int64), []
    for dims in sorted(cells):
        own = slice(first[dims], first[dims] + len(cells[dims]))
        of_cell[own] = packed(cells[dims], members[own], block[dims]) + len(room)
        room += [block[dims]] * (int(of_cell[own].max()) + 1 - len(room))
    regions = Regions(of_cell, np.bincount(of_cell, weights=members, minlength=len(room)).astype(np.int64), np.array(room, dtype=np.int64))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
        """(classes, home region of each, regions that each visits)."""
        for b in batches:
            for dims, part, d, home in by_dims(b):
                own = slice(first[dims], first[dims] + len(cells[dims]))
                region = regions.of_cell[own]
                met = cells[dims].reached(d, home, least_far[own], most_far[own]) & (region < region[home][:, None])
                yield part, region[home], [np.unique(region[x]) for x in met]

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(room), dtype=np.int64)
        for _, _, visits in reached(batches):
            n += np.bincount(np.concatenate(visits), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"region": some.astype(np.int32), "n": n[some]})

    visitors = np.zeros(len(room), dtype=np.int64)
    for r in classes.mapInArrow(visited, "region int, n long").groupBy("region").agg(F.sum("n").alias("n")).collect():
        visitors[r["region"]] = r["n"]
    # In how many blocks a region's own classes and all that are in it are dealt; tasks have the numbers as arrays.
    own_blocks, all_blocks = (np.maximum(1, -(-n // np.maximum(regions.block, 1))).astype(np.int32) for n in (regions.members, regions.members + visitors))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, home, visits in reached(batches):
            region = np.concatenate([np.concatenate([[h, h], x]) for h, x in zip(home, visits, strict=True)]).astype(np.int32)
            role = np.concatenate([[0, 1] + [2] * len(x) for x in visits]).astype(np.int32)
            ends = np.cumsum([0, *(2 + len(x) for x in visits)]).astype(np.int32)
            roles = pa.StructArray.from_arrays([pa.array(x) for x in (region, role, own_blocks[region], all_blocks[region])], ["region", "role", "hs", "os"])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("dims", "code", "id", "copies")), pa.ListArray.from_arrays(pa.array(ends), roles)], ["dims", "code", "id", "copies", "roles"])

    dealt = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int")
    placed = classes.mapInArrow(sent, "dims int, code binary, id long, copies long, roles array<struct<region: int, role: int, hs: int, os: int>>")
    one = placed.select("dims", "code", "id", "copies", F.explode("roles").alias("r")).select("dims", "code", "id", "copies", "r.*")
    whole = lambda n: F.sequence(F.lit(0), n - 1)
    return (
        one.withColumn("h", F.explode(F.when(F.col("role") == 0, F.array(dealt % F.col("hs"))).otherwise(whole(F.col("hs")))))
        .withColumn("o", F.explode(F.when(F.col("role") == 0, whole(F.col("os"))).otherwise(F.array(dealt % F.col("os")))))
        .select("region", "h", "o", "role", "id", "copies", "dims", "code")
    )


def classes_of(rows: DataFrame) -> DataFrame:
    """(dims, code, id, copies): equal vectors as one."""
    return checkpointed(rows.groupBy("dims", "code").agg(F.min("id").alias("id"), F.count("*").alias("copies")))


def pruned(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(classes, moved, compared, share): different vectors, rows sent to groups, pairs compared, and the share of all pairs left out."""
    classes = classes_of(usable(vectors, key, vector))
    sized = blocks(classes, least, block_bytes).groupBy("region", "h", "o").agg(F.count_if(F.col("role") == 0).alias("homes"), F.count_if(F.col("role") == 1).alias("mates"), F.count_if(F.col("role") == 2).alias("visitors"))
    # Two of one region are compared both ways, a visitor once.
    done = sized.agg(F.sum(F.col("homes") + F.col("mates") + F.col("visitors")).alias("moved"), F.sum(F.col("homes") * (F.col("mates") / 2 + F.col("visitors"))).alias("compared"))
    return done.crossJoin(classes.agg(F.count("*").alias("classes"))).select("classes", "moved", F.col("compared").cast("long").alias("compared"), (1 - F.col("compared") / (F.col("classes") * F.col("classes") / 2)).alias("share"))


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_links, component_id, kept) of every vector: links are pairs with a cosine of ``least`` or more."""
    rows = usable(vectors, key, vector)
    classes = classes_of(rows)
    found = checkpointed(blocks(classes, least, block_bytes).groupBy("region", "h", "o").applyInArrow(lambda t: compare(t, least), "a long, b long, n long"))
    degrees = found.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("b is not null").select("a", "b"))
    of_class = classes.join(degrees, "id").join(components, F.col("id") == F.col("node"), "left").select("dims", "code", (F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = rows.join(of_class, ["dims", "code"]).select(F.col("id").alias("_id"), "n_links", "component_id").groupBy("_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return vectors.select(F.col(key).alias("_key")).join(linked, F.col("_key") == F.col("_id"), "left").select(
        F.col("_key").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "_key").cast("long").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "_key") == F.col("_key"), F.lit(True)).alias("kept"),
    )
