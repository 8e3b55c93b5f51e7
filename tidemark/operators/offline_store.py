"""Snapshots as Parquet, by entity and UTC date."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.features import key_of


def write_snapshots(snapshots: DataFrame, path: str, entity: str, batch_id: str | int = 0, **options: str) -> None:
    """Rows of a batch, by date. A batch written again replaces its own files and nothing else.

    A file's rows are in the order of their entities, and its blocks have Bloom filters of them, so that a reader of one entity
    decodes the blocks it is in and no others. ``options`` are the writer's.
    """
    key = key_of(entity)
    # Rebalanced by date: few files a date, and a date with many rows in several, each with some of the entities.
    dated = snapshots.withColumn("date", F.to_date("feature_timestamp")).withColumn("batch", F.lit(str(batch_id)))
    dealt = dated.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(64))).hint("rebalance", "date", "_slot").sortWithinPartitions("date", "batch", key, "feature_timestamp")
    writer = dealt.drop("_slot").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{key}", "true").options(**options)
    writer.partitionBy("date", "batch").parquet(f"{path}/entity={entity}")


def read_snapshots(spark: SparkSession, path: str, entity: str, tolerant: bool = False, upto: int | None = None) -> DataFrame:
    """All snapshots of an entity; columns that older files lack are null. ``tolerant``: files that can't be read are left out.

    ``upto``: batches of larger ids are left out, by their folders; those without a number stay.
    """
    stored = spark.read.options(mergeSchema=True, ignoreCorruptFiles=tolerant, ignoreMissingFiles=tolerant).parquet(f"{path}/entity={entity}")
    return (stored if upto is None else stored.where(F.coalesce(F.col("batch").try_cast("long"), F.lit(-1)) <= upto)).drop("batch")


def history(snapshots: DataFrame, entity: str, entity_id: int, start: datetime | str, end: datetime | str) -> DataFrame:
    """Snapshots of one entity with start <= feature_timestamp < end, in order. The dates are asked for too, so that other folders aren't read."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    found = snapshots.where((F.col(key_of(entity)) == entity_id) & (F.col("feature_timestamp") >= lo) & (F.col("feature_timestamp") < hi))
    if "date" in snapshots.columns:
        found = found.where((F.col("date") >= F.to_date(lo)) & (F.col("date") <= F.to_date(hi)))
    return found.orderBy("feature_timestamp")


def latest_as_of(snapshots: DataFrame, entity: str, as_of: datetime | str, by_column: bool = False, order: tuple[str, ...] = ()) -> DataFrame:
    """One row for each entity: its last snapshot before ``as_of``, whole, or (``by_column``) the last value of each column that isn't null."""
    key = key_of(entity)
    at = F.lit(as_of).cast("timestamp")
    seen = snapshots.where(F.col("feature_timestamp") < at)
    if "date" in snapshots.columns:
        seen = seen.where(F.col("date") <= F.to_date(at))
    by = F.struct("feature_timestamp", *order)
    columns = [c for c in snapshots.columns if c not in (key, "date", *order)]
    if not by_column:
        return seen.groupBy(key).agg(F.max_by(F.struct(*columns), by).alias("r")).select(key, "r.*")
    return seen.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), by)).alias(c) for c in columns])


def compact(spark: SparkSession, path: str, entity: str, into: str) -> None:
    """The same rows in one set of files for each date, to a new place."""
    rows = read_snapshots(spark, path, entity).withColumn("batch", F.lit("compact"))
    rows.repartition("date").sortWithinPartitions("date", "batch", key_of(entity), "feature_timestamp").write.mode("overwrite").partitionBy("date", "batch").parquet(f"{into}/entity={entity}")


def from_json_lists(snapshots: DataFrame, columns: list[str]) -> DataFrame:
    """Lists that a snapshot holds as JSON text, as arrays; other text stays null."""
    return snapshots.withColumns({c: F.from_json(c, "array<string>") for c in columns})
