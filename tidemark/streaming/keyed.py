"""Features from state by key: a micro-batch reads its own events and the state of the keys they touch, whatever the history.

Each user or item has sums of its events by hour (hour h: events with h - 1 hours <= time < h hours), kept for the catalog's longest window, and
one row of all older ones for measures without a window. An hour begins to count in a window and ceases to; for the next such hour of a key
an event-time timer is set. When the watermark has passed it, the key's measures come out, even if it has no event any more: values fall when
their events grow old. So the rows are those of the hourly grid of ``snapshots.materialise`` at the hours where they can change. If the
watermark passes many of them at once, all of them come out.

State is kept by RocksDB with the stream's checkpoint; hours that no window can see any more are folded away when a timer fires.

What comes out at an hour is final: the watermark has passed it, and later events of before it are dropped. Sessions and categories need the events
themselves; features made of them are left to ``streaming.pipeline``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.catalog import Catalog, default_catalog
from tidemark.functions.features import HOUR_US, Measure, micros
from tidemark.operators.features import finished, key_of
from tidemark.streaming.pipeline import Paths, clean_stream, write_both

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS = HOUR_US // 1000
#: No hour.
NEVER = -(1 << 40)


def additive(catalog: Catalog, entity: str) -> Catalog:
    """The features whose measures add up from single events."""
    return Catalog(tuple(s for s in catalog.of(entity) if all(m.plain for m in s.measures)))


class Hourly(StatefulProcessor):
    """Rows of (key, hour, measures..) when a timer fires. State: rows of hour, sum or maximum of each base; NaN is nothing."""

    def __init__(self, key: str, measures: list[Measure]):
        self.key, self.measures = key, measures
        self.bases = list(dict.fromkeys((m.kind, m.event_type) for m in measures))
        self.longest = max((m.hours for m in measures if m.hours), default=0)
        #: After so many hours a window begins or ceases to see an hour.
        self.steps = sorted({0, *(m.hours for m in measures if m.hours)})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("hours", "rows binary, done long, timer long")

    def _held(self) -> tuple[np.ndarray, int, int]:
        """(rows, the hour up to which all has come out, the hour of the timer)."""
        held = self.state.get()
        rows, done, timer = held or (b"", NEVER, NEVER)
        return np.frombuffer(rows, np.float64).reshape(-1, 1 + len(self.bases)), done, timer

    def _hold(self, rows: np.ndarray, done: int, timer: int) -> None:
        """The next hour after ``done`` at which something changes gets the timer."""
        ahead = self._changes(rows, done)
        wanted = int(ahead[0]) if len(ahead) else NEVER
        if wanted != timer:
            if timer != NEVER:
                self.handle.deleteTimer(timer * HOUR_MS)
            if wanted != NEVER:
                self.handle.registerTimer(wanted * HOUR_MS)
        self.state.update((rows.tobytes(), done, wanted))

    def _changes(self, rows: np.ndarray, after: int) -> np.ndarray:
        hours = np.unique(rows[:, :1] + np.array(self.steps, np.float64))
        return hours[hours > after]

    def _added(self, rows: np.ndarray) -> np.ndarray:
        """One row for each hour."""
        hours, at = np.unique(rows[:, 0], return_inverse=True)
        out = np.full((len(hours), rows.shape[1]), np.nan)
        out[:, 0] = hours
        for j, (kind, _) in enumerate(self.bases, 1):
            some = ~np.isnan(rows[:, j])
            best = np.full(len(hours), -np.inf if kind == "last" else 0.0)
            (np.maximum if kind == "last" else np.add).at(best, at[some], rows[some, j])
            seen = np.bincount(at[some], minlength=len(hours)) > 0
            out[seen, j] = best[seen]
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        names = ["hour", *(f"b{j}" for j in range(len(self.bases)))]
        held, done, timer = self._held()
        self._hold(self._added(np.concatenate([held, *(r[names].to_numpy(np.float64) for r in rows)])), done, timer)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        rows, done, _ = self._held()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // HOUR_MS
        at = self._changes(rows, done)
        at = at[at <= now]
        out = {self.key: np.full(len(at), key[0]), "hour": at.astype(np.int64)}
        for m in self.measures:
            seen = rows[:, 0] <= at[:, None] if m.hours is None else (rows[:, 0] > at[:, None] - m.hours) & (rows[:, 0] <= at[:, None])
            values = rows[:, 1 + self.bases.index((m.kind, m.event_type))]
            seen &= ~np.isnan(values)
            total = np.where(seen, values, -np.inf).max(1) if m.kind == "last" else np.where(seen, values, 0.0).sum(1)
            out[m.name] = np.where(seen.any(1), total, np.nan)
        # What the longest window can't see at this hour it won't see later.
        old = rows[:, 0] <= now - self.longest
        if old.sum() > 1:
            gone = rows[old].copy()
            gone[:, 0] = now - self.longest
            rows = np.concatenate([self._added(gone), rows[~old]])
        self._hold(rows, now, NEVER)
        if len(at):
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def hourly_measures(events: DataFrame, entity: str, catalog: Catalog | None = None) -> DataFrame:
    """(key, hour, ref_us, measures..) of a stream of events with a watermark on ``ts``."""
    catalog, key = additive(catalog or default_catalog(), entity), key_of(entity)
    measures = list(dict.fromkeys(m for s in catalog.of(entity) for m in s.measures))
    processor = Hourly(key, measures)
    seen = events.where(F.col(key).isNotNull()).withColumn("ts_us", micros(F.col("ts")))
    hour = F.floor(F.col("ts_us") / HOUR_US).cast("double") + 1
    given = seen.select(key, "ts", hour.alias("hour"), *[Measure(k, t).of_event().cast("double").alias(f"b{j}") for j, (k, t) in enumerate(processor.bases)])
    kind = ", ".join([f"{key} long", "hour long", *(f"{m.name} double" for m in measures)])
    out = given.groupBy(key).transformWithStateInPandas(processor, kind, "append", "eventTime")
    # Whole numbers again, and nothing instead of NaN.
    return out.select(key, "hour", *[F.when(~F.isnan(m.name), F.col(m.name).cast("double" if m.kind in ("amount", "rating_sum") else "long")).alias(m.name) for m in measures])


def features_of(measured: DataFrame, entity: str, catalog: Catalog | None = None) -> DataFrame:
    """(key, feature_timestamp, features..) from ``hourly_measures`` in batch. All items that were viewed in an hour have a row at its end."""
    ref_us = F.col("hour") * HOUR_US
    return finished(measured, additive(catalog or default_catalog(), entity), entity, ref_us, "hour", [F.col(key_of(entity)), F.timestamp_micros(ref_us).alias("feature_timestamp")])


def start(messages: DataFrame, paths: Paths, entity: str, late: str = "1 hour", trigger: dict | None = None, catalog: Catalog | None = None) -> StreamingQuery:
    """The running query for one entity: its features at every hour that they may change at, to both stores below a folder of its own."""
    spark = messages.sparkSession
    events, _ = clean_stream(messages, late)
    own = Paths(f"{paths.root}/{entity}")

    def written(batch: DataFrame, batch_id: int) -> None:
        held = features_of(batch, entity, catalog).persist()
        try:
            if not held.isEmpty():
                write_both(spark, [(entity, held)], batch_id, own, catalog or default_catalog())
        finally:
            held.unpersist()

    writer = hourly_measures(events, entity, catalog).writeStream.outputMode("append").foreachBatch(written).option("checkpointLocation", own.checkpoints)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps the settings that it was started with
    try:
        return writer.trigger(**trigger or {"availableNow": True}).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
