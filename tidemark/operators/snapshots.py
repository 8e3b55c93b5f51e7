"""Features of every entity on a regular grid of reference times.

Events are first added up in buckets of one hour, counted from the grid's start and named by their end, so a window of h hours
before a grid point is the sum of h buckets. What is shuffled is a row for each entity and hour, not each event: a hot item costs
as many rows as hours. ``materialise_by_join`` says the same as a join of grid and events, to test against.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.catalog import Catalog, default_catalog
from tidemark.functions.features import HOUR_US, micros
from tidemark.operators.features import finished, key_of, measures_of, most_viewed

FREQUENCIES = {"1H": 1, "6H": 6, "12H": 12, "1D": 24}


def hours_of(freq: str) -> int:
    if freq not in FREQUENCIES:
        raise ValueError(f"frequency {freq!r} is none of {', '.join(FREQUENCIES)}")
    return FREQUENCIES[freq]


def materialise(events: DataFrame, entity: str, start: datetime | str, end: datetime | str, freq: str = "1H", catalog: Catalog | None = None) -> DataFrame:
    """(key, feature_timestamp, features..) at start, start + freq, .. up to and with ``end``, from an entity's first event on."""
    catalog = catalog or default_catalog()
    key, step = key_of(entity), hours_of(freq)
    start_us = F.unix_micros(F.lit(start).cast("timestamp"))
    last = F.floor((F.unix_micros(F.lit(end).cast("timestamp")) - start_us) / HOUR_US)
    # The hour after which an event counts; hour 0 is the grid's start, and earlier ones are negative.
    bucket = (F.floor((F.col("ts_us") - start_us) / HOUR_US) + 1).cast("long")
    seen = events.where(F.col(key).isNotNull()).withColumn("ts_us", micros(F.col("ts"))).withColumn("hour", bucket).where(F.col("hour") <= last)
    measures = measures_of(catalog, entity)
    plain = [m for m in measures if m.plain]
    # Measures that differ only in their window share one column of the buckets.
    base = {(m.kind, m.event_type): m for m in plain}
    names = {k: f"b_{k[0]}_{k[1]}" for k in base}
    hourly = seen.groupBy(key, "hour").agg(F.count("*").alias("_n"), *[m.total(m.of_event()).alias(names[k]) for k, m in base.items()]).drop("_n")
    with_sessions = any(m.kind == "session_us" for m in measures)
    if with_sessions:
        hourly = hourly.join(_session_growth(seen, key), [key, "hour"], "left")
    by_entity = Window.partitionBy(key)
    points = F.sequence(F.greatest(F.ceil(F.col("first") / step) * step, F.lit(0)).cast("long"), last.cast("long"), F.lit(step).cast("long"))
    spine = seen.groupBy(key).agg(F.min("hour").alias("first")).where(F.greatest(F.ceil(F.col("first") / step) * step, F.lit(0)) <= last).select(key, F.explode(points).alias("hour"), F.lit(True).alias("asked"))
    rows = hourly.withColumn("asked", F.lit(False)).unionByName(spine, allowMissingColumns=True)

    def rolled(name: str, hours: int | None, most: bool) -> Column:
        frame = by_entity.orderBy("hour").rangeBetween(Window.unboundedPreceding if hours is None else -(hours - 1), Window.currentRow)
        return (F.max if most else F.sum)(name).over(frame)

    sums = [rolled(names[m.kind, m.event_type], m.hours, m.kind == "last").alias(m.name) for m in plain]
    if with_sessions:
        sums += [rolled("growth_us", None, False).alias("session_us"), rolled("growth_n", None, False).alias("session_n")]
    measured = rows.select(key, "hour", "asked", *sums).where("asked")
    for m in (m for m in measures if m.kind == "categories"):
        measured = measured.join(_rolled_categories(seen, key, m.event_type, m.hours, step, last), [key, "hour"], "left")
    at_us = start_us + F.col("hour") * HOUR_US
    return finished(measured, catalog, entity, at_us, "hour", [F.col(key), F.timestamp_micros(at_us).alias("feature_timestamp")])


def _session_growth(seen: DataFrame, key: str) -> DataFrame:
    """By how much each hour lengthens an entity's sessions, and how many sessions it makes two events long."""
    by_session = Window.partitionBy(key, "session_id").orderBy("hour")
    parts = seen.groupBy(key, "session_id", "hour").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"), F.count("*").alias("n"))
    before = F.sum("n").over(by_session.rowsBetween(Window.unboundedPreceding, -1))
    grown = parts.select(
        key,
        "hour",
        (F.col("hi") - F.coalesce(F.lag("hi").over(by_session), F.col("lo"))).alias("us"),
        F.when((F.coalesce(before, F.lit(0)) < 2) & (F.coalesce(before, F.lit(0)) + F.col("n") >= 2), 1).otherwise(0).alias("made"),
    )
    return grown.groupBy(key, "hour").agg(F.sum("us").alias("growth_us"), F.sum("made").alias("growth_n"))


def _rolled_categories(seen: DataFrame, key: str, event_type: str, hours: int, step: int, last: Column) -> DataFrame:
    named = F.col("metadata.category").isNotNull() & (F.col("metadata.category") != "")
    hourly = (
        seen.where((F.col("event_type") == event_type) & named)
        .groupBy(key, F.col("metadata.category").alias("category"), F.col("hour").alias("from"))
        .agg(F.count("*").alias("n"), F.min(F.struct("ts_us", "event_id")).alias("first"))
    )
    lo = F.greatest(F.ceil(F.col("from") / step) * step, F.lit(0)).cast("long")
    hi = F.least(F.col("from") + (hours - 1), last).cast("long")
    spread = hourly.where(lo <= hi).select(key, "category", "n", "first", F.explode(F.sequence(lo, hi, F.lit(step).cast("long"))).alias("hour"))
    counted = spread.groupBy(key, "hour", "category").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return most_viewed(counted, [key, "hour"])


def materialise_by_join(events: DataFrame, entity: str, start: datetime | str, end: datetime | str, freq: str = "1H", catalog: Catalog | None = None) -> DataFrame:
    """The same, by joining every grid point with all events before it. For tests: its cost is events times grid points."""
    from tidemark.functions.features import in_window

    catalog = catalog or default_catalog()
    key, step = key_of(entity), hours_of(freq)
    grid = events.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.make_dt_interval(hours=F.lit(step)))).alias("at"))
    grid = grid.select("at", F.unix_micros("at").alias("at_us"))
    seen = events.where(F.col(key).isNotNull()).withColumn("ts_us", micros(F.col("ts")))
    met = grid.join(seen, F.col("ts_us") < F.col("at_us"))
    on = [key, "at", "at_us"]
    measures = measures_of(catalog, entity)
    out = met.groupBy(*on).agg(F.count("*").alias("_n"), *[m.total(F.when(in_window(F.col("ts_us"), F.col("at_us"), m.hours), m.of_event())).alias(m.name) for m in measures if m.plain])
    if any(m.kind == "session_us" for m in measures):
        sessions = met.groupBy(*on, "session_id").agg(F.count("*").alias("n"), (F.max("ts_us") - F.min("ts_us")).alias("us")).where("n > 1")
        out = out.join(sessions.groupBy(*on).agg(F.sum("us").alias("session_us"), F.count("*").alias("session_n")), on, "left")
    for m in (m for m in measures if m.kind == "categories"):
        named = F.col("metadata.category").isNotNull() & (F.col("metadata.category") != "")
        viewed = met.where((F.col("event_type") == m.event_type) & in_window(F.col("ts_us"), F.col("at_us"), m.hours) & named)
        counted = viewed.groupBy(*on, F.col("metadata.category").alias("category")).agg(F.count("*").alias("n"), F.min(F.struct("ts_us", "event_id")).alias("first"))
        out = out.join(most_viewed(counted, on), on, "left")
    return finished(out, catalog, entity, F.col("at_us"), "at_us", [F.col(key), F.col("at").alias("feature_timestamp")])
