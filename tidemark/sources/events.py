"""Where events come from: JSON messages, files, Kafka, and the driver's test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.schema import EVENT, EVENT_TYPES, REQUIRED, WIRE


def parse_events(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON text to (events, dead letters). Batch or streaming.

    A message is dead if it isn't JSON, lacks a required field, has a time that doesn't parse or an unknown event type; the
    dead-letter rows hold its text and the reason.
    """
    text = F.decode(F.col(value), "UTF-8") if dict(messages.dtypes)[value] == "binary" else F.col(value)
    # As a generator's row: a filter on its fields stays above it, while one on a column's would parse the text anew for each field it asks for.
    parsed = messages.select(text.alias("raw")).select("raw", F.explode(F.array(F.from_json("raw", WIRE, {"mode": "PERMISSIVE"}))).alias("e"))
    flat = parsed.select("raw", *[(F.try_to_timestamp(F.col("e.timestamp")) if f.name == "ts" else F.col(f"e.{f.name}")).alias(f.name) for f in EVENT])
    reason = F.when(F.col("user_id").isNull() & F.col("event_id").isNull(), "not an event")
    for name in REQUIRED:
        reason = reason.when(F.col(name).isNull(), f"no {name}")
    flat = flat.withColumn("reason", reason.when(~F.col("event_type").isin(*EVENT_TYPES), "unknown event_type"))
    return flat.where("reason is null").select(*EVENT.names), flat.where("reason is not null").select("raw", "reason")


def to_messages(events: DataFrame, *more: str | Column) -> DataFrame:
    """(key, value, more..): JSON messages keyed by user, so that one user's events keep their order."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    body = F.struct(*[iso.alias("timestamp") if c == "ts" else F.col(c) for c in EVENT.names])
    return events.select(F.col("user_id").cast("string").alias("key"), F.to_json(body).alias("value"), *more)


def kafka_stream(spark: SparkSession, settings: Settings, starting: str = "earliest") -> DataFrame:
    """Needs the Kafka connector on the class path. A fresh checkpoint with "earliest" replays the log."""
    options = {"kafka.bootstrap.servers": settings.bootstrap_servers, "subscribe": settings.topic, "startingOffsets": starting, "maxOffsetsPerTrigger": str(settings.batch_size)}
    return spark.readStream.format("kafka").options(**options).load()


def write_kafka(events: DataFrame, settings: Settings) -> None:
    options = {"kafka.bootstrap.servers": settings.bootstrap_servers, "topic": settings.topic, "kafka.acks": "all", "kafka.compression.type": "gzip", "kafka.linger.ms": "5", "kafka.retries": "3"}
    to_messages(events).write.format("kafka").options(**options).save()


def json_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Text files of one JSON message a line, as they arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


# Which event type stands for which in the driver's table.
TYPES = {"view": "item_view", "click": "add_to_cart", "purchase": "purchase", "error": "rating", "signup": "page_view"}


def events_from_table(table: DataFrame) -> DataFrame:
    """The driver's ``events`` (event_id, ts, user_id, event_type, value, props) as events; naive times are UTC.

    Items, categories, ratings and sessions aren't in the table and are derived from its columns; a signup has no item.
    """
    table.sparkSession.conf.set("spark.sql.session.timeZone", "UTC")
    # A column of its own below the others: those that are made of it would look into the text anew, each for itself.
    table, k = table.withColumn("_k", F.get_json_object("props", "$.k").cast("long")), F.col("_k")
    signup, purchase, error = (F.col("event_type") == x for x in ("signup", "purchase", "error"))
    kind = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])[F.col("event_type")]
    nothing = lambda t: F.lit(None).cast(t)

    def made(value: Column, name: str) -> Column:
        return value.alias(name)

    metadata = F.struct(
        made(nothing("double"), "price"),
        made(F.when(~signup, F.concat(F.lit("cat"), (k % 10).cast("string"))), "category"),
        made(nothing("int"), "quantity"),
        made(F.when(purchase, F.col("value")), "total_amount"),
        made(F.when(error, (k % 5 + 1).cast("double")), "rating"),
        made(nothing("string"), "query"),
        made(nothing("int"), "results_count"),
        made(nothing("string"), "page"),
    )
    session = F.concat_ws("-", F.col("user_id").cast("string"), F.col("ts").cast("date").cast("string"))
    return table.select(
        F.col("event_id").cast("string").alias("event_id"),
        "user_id",
        kind.alias("event_type"),
        F.when(~signup, k).alias("item_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        session.alias("session_id"),
        metadata.alias("metadata"),
    )


def deduplicated(events: DataFrame) -> DataFrame:
    """One row for each event_id: the earliest, in batch."""
    order = F.struct("ts", "user_id")
    return events.groupBy("event_id").agg(F.min_by(F.struct(*EVENT.names), order).alias("e")).select("e.*")
