"""Conflict-constrained best-fit packing of documents into bins of fixed capacity.

Equal rows are counted first and then numbered, so that every piece has a key of its own; pieces are dealt by a hash of all that
into groups of about ``group_rows``, whatever their id, source or cluster, so a hot source or a repeated id is spread evenly and a
task holds one group of a bounded expected size. Groups are packed apart, longest piece first.
Open bins are kept in order of residual capacity and carry a bitmap of the sources and duplicate clusters they hold. For a
piece, the search begins at the tightest bin that has room and goes on to its successors until one has no conflict; else a new
bin opens. So no bin ever holds two pieces of one source or of one duplicate cluster.

Defined results: a document longer than the capacity is cut into full pieces and a rest, each in a bin of its own; null or zero
length makes one piece of length 0; null sources and null clusters conflict with nothing (``cluster_of`` gives null for a null
text); repeated rows are packed as rows of their own; ties are broken by id, piece, source and cluster, nulls behind all values; a
null id is a value like others, and ids come back as they were whatever stands beside them; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows are numbered in steps of so many.
STEP = 4096


def place(pieces: Iterable[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source, cluster), taken in the order given."""
    pieces = list(pieces)
    bits: dict[object, int] = {}
    crowded = {c for c, n in Counter(c for _, _, c in pieces if c is not None).items() if n > 1}
    out, open_bins, held = [], [], []
    for length, source, cluster in pieces:
        need = 0
        if source is not None:
            need |= 1 << bits.setdefault(("source", source), len(bits))
        if cluster in crowded:
            need |= 1 << bits.setdefault(("cluster", cluster), len(bits))
        at = bisect_left(open_bins, (length, -1))
        while at < len(open_bins) and held[open_bins[at][1]] & need:
            at += 1
        if at < len(open_bins):
            residual, number = open_bins.pop(at)
        else:
            residual, number = capacity, len(held)
            held.append(0)
        held[number] |= need
        out.append((number, capacity - residual))
        insort(open_bins, (residual - length, number))
    return out


def pack(docs: DataFrame, key: str, length: Column, source: Column, cluster: Column, capacity: int = 2048, group_rows: int = 4096) -> DataFrame:
    """One row for each piece: ``key``, piece, start (in the document), length, bin_id, bin_offset."""
    rows = docs.select(F.col(key), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("total"), source.alias("source"), cluster.alias("cluster"))
    # Numbers below n, in two steps so that no row holds an array longer than STEP or n / STEP.
    numbered = lambda df, n, name: df.withColumn("_high", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / STEP)))).withColumn(name, F.explode(F.sequence(F.col("_high") * STEP, F.least(n - 1, F.col("_high") * STEP + STEP - 1)))).drop("_high")
    equal = numbered(rows.groupBy(key, "total", "source", "cluster").agg(F.count("*").alias("n")), F.col("n"), "copy")
    in_pieces = numbered(equal, F.greatest(F.ceil(F.col("total") / capacity), F.lit(1)), "piece")
    start = F.col("piece") * capacity
    pieces = in_pieces.select(key, "source", "cluster", "copy", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.col("total") - start, F.lit(capacity)).cast("long").alias("length"))
    # An upper bound of the pieces, from the rows' count and total length alone.
    counted = docs.select(F.coalesce(length, F.lit(0)).cast("long").alias("n")).agg(F.count("*").alias("rows"), F.sum("n").alias("sum")).first()
    groups = max(1, -(-(counted["rows"] + (counted["sum"] or 0) // capacity) // group_rows))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(key, "piece", "copy", "start", "length", "source", "cluster"), F.lit(groups)).cast("int"))

    def packed(held: pa.Table) -> pa.Table:
        # Arrow's own columns throughout: an id or a cluster is never made a float by a null beside it. Nulls come last.
        by = held.append_column("_s", held.column("source").cast(pa.string())).append_column("_c", held.column("cluster").cast(pa.string()))
        order = [("length", "descending"), (key, "ascending"), ("piece", "ascending"), ("_s", "ascending"), ("_c", "ascending")]
        held = held.take(pc.sort_indices(by, sort_keys=order, null_placement="at_end"))
        placed = place(zip(held.column("length").to_pylist(), held.column("source").to_pylist(), held.column("cluster").to_pylist(), strict=True), capacity)
        group = held.column("group")[0].as_py()
        bins = {"bin_id": pa.array([(group << 32) + b for b, _ in placed], pa.int64()), "bin_offset": pa.array([o for _, o in placed], pa.int64())}
        return pa.table({**{c: held.column(c) for c in (key, "piece", "start", "length")}, **bins})

    kind = dict(docs.dtypes)[key]
    return dealt.groupBy("group").applyInArrow(packed, f"`{key}` {kind}, piece int, start long, length long, bin_id long, bin_offset long")


def cluster_of(text: Column) -> Column:
    """Equal texts are one cluster; a null text is in none."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def words(text: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))
