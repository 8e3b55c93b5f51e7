"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from, and for rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of spark.checkpoint.dir.

    What was shuffled for it goes once it is written, as nothing asks for that again.
    Only where that setting is missing a folder is chosen: /tmp on a local master, else the warehouse, which executors share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            local = context.master.startswith("local[") or context.master == "local"
            folder = "/tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(folder)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def bounded_sample(df: DataFrame, by: str, key: str, most: int, most_values: int = 200, salt: int = 7) -> DataFrame:
    """About ``most`` rows for each of the ``most_values`` commonest values of ``by``, the same on every run.

    Rows are chosen by a hash of ``key`` and equal keys together: never over 1.5 times as many different keys plus 50.
    The counts come from one aggregate of one row per value of ``by``.
    """
    common = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(most_values)
    counts = {r[by]: r["n"] for r in common.collect()}
    if not counts:
        return df.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, most / n))])
    unit = F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1_000_003)) / 1_000_003.0
    return df.where(unit < share[F.col(by)])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each value (one more than values); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_, at


def runs(offsets: np.ndarray, most_bytes: int, most_rows: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most so many bytes (or one row) and rows."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
        end = min(max(end, start + 1), start + most_rows, n)
        yield start, end
        start = end
