"""Features of every user or item as of one reference time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.catalog import Catalog, default_catalog
from tidemark.functions.features import Measure, in_window, micros, rounded

TOP_CATEGORIES = 3
POPULARITY = "popularity_rank_1h"


def key_of(entity: str) -> str:
    if entity not in ("user", "item"):
        raise ValueError(f"unknown entity: {entity}")
    return f"{entity}_id"


def measures_of(catalog: Catalog, entity: str) -> list[Measure]:
    return list(dict.fromkeys(m for s in catalog.of(entity) for m in s.measures))


def finished(measured: DataFrame, catalog: Catalog, entity: str, ref_us: Column, snapshot: str, keep: list[Column]) -> DataFrame:
    """``keep`` and the features, from columns named as the measures.

    Popularity is divided by the most in its snapshot: an aggregate with one row for each value of column ``snapshot``, joined back.
    """
    specs = catalog.of(entity)
    value = {s.name: s.finish(lambda m: F.col(m.name), ref_us) for s in specs}
    if POPULARITY in value:
        # As many rows as the grid has points.
        most = measured.groupBy(snapshot).agg(F.max(value[POPULARITY]).alias("_most"))
        measured = measured.join(F.broadcast(most), snapshot)
        value[POPULARITY] = F.when(F.col("_most") > 0, rounded(value[POPULARITY] / F.col("_most"), 6)).otherwise(F.lit(0.0))
    return measured.select(*keep, *[value[s.name].alias(s.name) for s in specs])


def most_viewed(counted: DataFrame, key: list[str]) -> DataFrame:
    """(key.., category, n, first) to the top categories of each key, ties by what was seen first: an array."""
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "first", "category"))).where(F.col("rank") <= TOP_CATEGORIES)
    listed = F.array_sort(F.collect_list(F.struct("rank", "category")))
    return ranked.groupBy(*key).agg(F.transform(listed, lambda x: x["category"]).alias("categories_item_view_24h"))


def features_as_of(events: DataFrame, entity: str, ref: datetime | str, catalog: Catalog | None = None) -> DataFrame:
    """(key, feature_timestamp, features..): one row for each entity with an event before ``ref``.

    One aggregate gives all that single events add; sessions and categories take a second grouping each, joined on the key.
    """
    catalog = catalog or default_catalog()
    key = key_of(entity)
    ref_ts = F.lit(ref).cast("timestamp")
    ref_us = F.unix_micros(ref_ts)
    seen = events.where(F.col(key).isNotNull() & (F.col("ts") < ref_ts)).withColumn("ts_us", micros(F.col("ts")))
    measures = measures_of(catalog, entity)
    plain = [m for m in measures if m.plain]
    out = seen.groupBy(key).agg(F.count("*").alias("_n"), *[m.total(F.when(in_window(F.col("ts_us"), ref_us, m.hours), m.of_event())).alias(m.name) for m in plain]).drop("_n")
    if any(m.kind == "session_us" for m in measures):
        sessions = seen.groupBy(key, "session_id").agg(F.count("*").alias("n"), (F.max("ts_us") - F.min("ts_us")).alias("us")).where("n > 1")
        out = out.join(sessions.groupBy(key).agg(F.sum("us").alias("session_us"), F.count("*").alias("session_n")), key, "left")
    for m in (m for m in measures if m.kind == "categories"):
        named = F.col("metadata.category").isNotNull() & (F.col("metadata.category") != "")
        viewed = seen.where((F.col("event_type") == m.event_type) & in_window(F.col("ts_us"), ref_us, m.hours) & named)
        counted = viewed.groupBy(key, F.col("metadata.category").alias("category")).agg(F.count("*").alias("n"), F.min(F.struct("ts_us", "event_id")).alias("first"))
        out = out.join(most_viewed(counted, [key]), key, "left")
    return finished(out.withColumn("_snapshot", F.lit(0)), catalog, entity, ref_us, "_snapshot", [F.col(key), ref_ts.alias("feature_timestamp")])


def exploded_affinity(features: DataFrame, key: str = "user_id") -> DataFrame:
    """category_affinity as rows: key, rank (from 1), category."""
    return features.select(key, F.posexplode("category_affinity").alias("pos", "category")).select(key, (F.col("pos") + 1).cast("long").alias("rank"), "category")
