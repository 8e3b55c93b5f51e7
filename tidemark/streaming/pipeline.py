"""From a stream of messages to both stores.

Messages are parsed, unreadable ones set aside, repeats of an event id dropped within the watermark. Each micro-batch adds its
events to a log by date, and features of the entities it touches are computed from their events in the days of the log that the
history covers, by the same expressions as in batch, for users and, by a shuffle of their own, for items. So what a batch reads depends on the
events of the history, not on the age of the log (``streaming.keyed`` holds state by key instead, and reads no log). Days that are twice
as old as the history go from the log.

Both stores are written by batch id, so a replayed batch changes nothing, and a batch is seen in neither before it is in both: its
commit record is written last, and readers ask for it. An empty batch writes nothing and loses nothing. Batch ids are those of the
checkpoint in the same folder: a stream that begins anew, with a new checkpoint, needs a new folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.catalog import Catalog, default_catalog
from tidemark.operators import files, offline_store, online_store
from tidemark.operators.features import POPULARITY, features_as_of, key_of, measures_of
from tidemark.operators.online_table import OnlineTable
from tidemark.schema import EVENT
from tidemark.sources.events import parse_events

#: The feature that may be infinite.
ENDLESS = "days_since_last_purchase"


@dataclass(frozen=True)
class Paths:
    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.root}/{name}"


def clean_stream(messages: DataFrame, late: str = "7 days") -> tuple[DataFrame, DataFrame]:
    """(events without repeats, dead letters)."""
    events, dead = parse_events(messages)
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]), dead


def history_hours(catalog: Catalog) -> int:
    """The catalog's longest window."""
    return max([m.hours for e in ("user", "item") for m in measures_of(catalog, e) if m.hours] or [24])


def read_log(spark: SparkSession, paths: Paths, start: object, end: object) -> DataFrame:
    """Events with start <= ts < end; only the folders of those days are listed and read."""
    days = [(start + timedelta(days=k)).date() for k in range((end.date() - start.date()).days + 1)]
    folders = "{" + ",".join(f"date={d}" for d in days) + "}"
    log = spark.read.option("basePath", paths.log).parquet(f"{paths.log}/{folders}")
    return log.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))).drop("date", "batch")


def prune_log(spark: SparkSession, paths: Paths, before: datetime) -> None:
    """Whole days of the log before a time go."""
    for name in files.names(spark, paths.log):
        if name.startswith("date=") and name.removeprefix("date=") < str(before.date()):
            files.remove(spark, f"{paths.log}/{name}")


def history_of(touched: DataFrame, seen: DataFrame, entity: str, ref: datetime, catalog: Catalog) -> DataFrame:
    """The events of touched entities, and what popularity compares them with: the last hour's views of others.

    A touched entity has an event of no type, in a session of its own, besides: one whose events are all older than the history gets its
    features too. Touched keys are sent to the events where they are few, so that what is shuffled is sums, not events.
    """
    key, fields = key_of(entity), {f.name: F.lit(None).cast(f.dataType) for f in EVENT}
    wanted = F.col("_own")
    if (entity, POPULARITY) in catalog:
        for m in catalog.get(entity, POPULARITY).measures:
            viewed = F.col("event_type") == m.event_type
            wanted = F.coalesce(wanted, viewed & (F.col("ts") >= F.lit(ref - timedelta(hours=m.hours))) if m.hours else viewed)
        own = seen.join(touched.withColumn("_own", F.lit(True)), key, "left").where(wanted)
    else:
        own = seen.join(touched, key, "left_semi")
    at = {key: F.col(key), "ts": F.lit(ref - timedelta(microseconds=1)).cast("timestamp"), "session_id": F.lit(f"none {uuid.uuid4()}")}
    return own.select(EVENT.names).unionByName(touched.select(*[value.alias(name) for name, value in (fields | at).items()]))


def process_batch(spark: SparkSession, batch: DataFrame, batch_id: int, paths: Paths, catalog: Catalog | None = None, history: int | None = None, push: Callable[[DataFrame, int], None] | None = None) -> None:
    """One micro-batch of events to the log and both stores.

    The reference time is one microsecond after the batch's last event. ``history``: how many hours before it count, by default the
    catalog's longest window; features over all time see those hours too. ``push`` gets the online rows, for another key-value store.
    """
    catalog = catalog or default_catalog()
    held: list[DataFrame] = []
    try:
        # The batch is run once, by the write, which tells its last event as well; from here on it is read from the log. Spark doesn't find a
        # persisted frame over a stream's batch on both sides of a join, and would run the stream's state again there.
        watch = Observation()
        dated = batch.observe(watch, F.max("ts").alias("last")).withColumn("date", F.to_date("ts")).withColumn("batch", F.lit(str(batch_id))).hint("rebalance", "date")
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(paths.log)
        last = watch.get.get("last")
        if last is None:
            return
        added = spark.read.schema(EVENT).option("basePath", paths.log).parquet(f"{paths.log}/date=*/batch={batch_id}")
        ref = last + timedelta(microseconds=1)
        seen = read_log(spark, paths, ref - timedelta(hours=history or history_hours(catalog)), ref)
        made = []
        for entity in ("user", "item"):
            key = key_of(entity)
            touched = added.select(key).where(F.col(key).isNotNull()).distinct().persist()
            held.append(touched)
            touched.count()  # how many there are tells the joins whether to send them to the events
            features = features_as_of(history_of(touched, seen, entity, ref, catalog), entity, ref, catalog)
            if (entity, POPULARITY) in catalog:
                features = features.join(touched, key, "left_semi")
            held.append(features.persist())
            made.append((entity, features))
        write_both(spark, made, batch_id, paths, catalog, push)
        # Twice the history: a batch whose last event is a late one still finds its own.
        prune_log(spark, paths, ref - timedelta(hours=2 * (history or history_hours(catalog))))
    finally:
        for frame in held:
            frame.unpersist()


def online_table(spark: SparkSession, paths: Paths) -> OnlineTable:
    return OnlineTable(spark, paths.online)


def committed(spark: SparkSession, paths: Paths) -> int:
    """The id of the last batch that is in both stores, -1 if none is. Batches are written one after another, so all before it are too."""
    return max([int(n) for n in files.names(spark, paths.commits) if n.isdigit()], default=-1)


def commit(spark: SparkSession, paths: Paths, batch_id: int) -> None:
    """From now on readers see the batch."""
    files.write(spark, f"{paths.commits}/{batch_id}", "")
    for n in files.names(spark, paths.commits):
        if n.isdigit() and int(n) < batch_id - 1:
            files.remove(spark, f"{paths.commits}/{n}")


def unsound(features: DataFrame, entity: str, catalog: Catalog) -> Column:
    """Why a row's features can't be used, null if they can: a number is missing, not a number, or infinite where it mustn't be."""
    why = F.lit(None).cast("string")
    for name in reversed([n for n in catalog.names(entity) if n in features.columns]):
        value = F.col(name)
        if catalog.get(entity, name).dtype == "float":
            endless = F.isnan(value) if name == ENDLESS else F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
            why = F.when(endless, f"{name} is not finite").otherwise(why)
        why = F.when(value.isNull(), f"{name} is missing").otherwise(why)
    return why


def write_both(spark: SparkSession, made: list[tuple[str, DataFrame]], batch_id: int, paths: Paths, catalog: Catalog, push: Callable[[DataFrame, int], None] | None = None) -> None:
    """(entity, features) to the offline and the online store, all or nothing: neither is seen before the batch is committed.

    Rows whose features can't be used are set aside with their key and the reason; the others are written. A batch that is committed
    is not written again, but pushed again, as it may not have been.
    """
    rows, newest, new = None, None, batch_id > committed(spark, paths)
    for entity, features in made:
        marked = features.withColumn("_why", unsound(features, entity, catalog))
        aside = marked.where("_why is not null").select(F.col(key_of(entity)).alias("entity_id"), "feature_timestamp", F.col("_why").alias("reason"), F.lit(entity).alias("entity"), F.lit(str(batch_id)).alias("batch"))
        if new:
            aside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("entity", "batch").parquet(paths.rejected)
        features = marked.where("_why is null").drop("_why")
        if new:
            offline_store.write_snapshots(features, paths.offline, entity, batch_id)
        own = online_store.to_online(features, entity, F.col("feature_timestamp"), catalog)
        rows = own if rows is None else rows.unionByName(own)
        # A batch may hold several times of a key; the last counts. It is found among whole rows, before they become one for each feature.
        rest = [c for c in features.columns if c != key_of(entity)]
        last = features.groupBy(key_of(entity)).agg(F.max_by(F.struct(*rest), "feature_timestamp").alias("r")).select(key_of(entity), "r.*")
        last = online_store.to_online(last, entity, F.col("feature_timestamp"), catalog)
        newest = last if newest is None else newest.unionByName(last)
    if new:
        online_table(spark, paths).upsert(newest, batch_id)
        commit(spark, paths, batch_id)
    if push is not None:
        push(rows, batch_id)


def read_online(spark: SparkSession, paths: Paths) -> DataFrame:
    """The latest value of each key of committed batches."""
    return online_table(spark, paths).read(committed(spark, paths))


def read_offline(spark: SparkSession, paths: Paths, entity: str) -> DataFrame:
    """The snapshots of committed batches."""
    return offline_store.read_snapshots(spark, paths.offline, entity, upto=committed(spark, paths))


def read_rejected(spark: SparkSession, paths: Paths) -> DataFrame:
    """(entity, entity_id, feature_timestamp, reason) of committed batches."""
    stored = spark.read.schema("entity_id long, feature_timestamp timestamp, reason string, entity string, batch long").parquet(paths.rejected)
    return stored.where(F.col("batch") <= committed(spark, paths)).select("entity", "entity_id", "feature_timestamp", "reason")


def start_dead_letters(dead: DataFrame, paths: Paths, trigger: dict | None = None) -> StreamingQuery:
    """Dead letters to JSON files."""
    return dead.writeStream.format("json").option("path", paths.dead).option("checkpointLocation", f"{paths.checkpoints}/dead").trigger(**trigger or {"availableNow": True}).start()


def start(messages: DataFrame, paths: Paths, late: str = "7 days", trigger: dict | None = None, catalog: Catalog | None = None, history: int | None = None) -> tuple[StreamingQuery, StreamingQuery]:
    """The two running queries: features, and dead letters. ``trigger``: as {"processingTime": "500 milliseconds"}."""
    spark = messages.sparkSession
    events, dead = clean_stream(messages, late)
    main = events.writeStream.foreachBatch(lambda b, i: process_batch(spark, b, i, paths, catalog, history)).option("checkpointLocation", f"{paths.checkpoints}/features").trigger(**trigger or {"availableNow": True}).start()
    return main, start_dead_letters(dead, paths, trigger)


def sliding_counts(events: DataFrame, width: str = "24 hours", slide: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Events of each type by user in sliding windows; streaming with a watermark, or batch."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width, slide), "user_id", "event_type").agg(F.count("*").alias("n"))
