"""The event record and its JSON form."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_TYPES = ("page_view", "item_view", "add_to_cart", "purchase", "search", "rating")

METADATA = T.StructType(
    [
        T.StructField("price", T.DoubleType()),
        T.StructField("category", T.StringType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("query", T.StringType()),
        T.StructField("results_count", T.IntegerType()),
        T.StructField("page", T.StringType()),
    ]
)

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("metadata", METADATA),
    ]
)

#: As on the wire: the time has another name there, and is text.
WIRE = T.StructType([T.StructField("timestamp", T.StringType()) if f.name == "ts" else f for f in EVENT])
REQUIRED = ("event_id", "user_id", "event_type", "ts", "session_id")
