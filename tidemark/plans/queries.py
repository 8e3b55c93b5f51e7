"""The registered queries over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.catalog import default_catalog
from tidemark.functions.features import HOUR_US, Measure, in_window, micros
from tidemark.operators import asof, consistency, features, files, offline_store, online_store, rolling, snapshots, training
from tidemark.operators.online_table import OnlineTable
from tidemark.sources import events as source
from tidemark.sources import generator
from tidemark.streaming import keyed, metrics, pipeline

REF = "2024-01-20 00:00:00"
START, END = "2024-01-02 00:00:00", "2024-01-30 00:00:00"
NOW = "2024-01-20 06:00:00"

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.events_from_table(read(spark, sf_dir, "events"))


def naive(df: DataFrame) -> DataFrame:
    """Times without a zone, as the driver's tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def user_features_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(features.features_as_of(events(spark, sf_dir), "user", REF).drop("category_affinity", "avg_session_duration"))


def user_session_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.features_as_of(events(spark, sf_dir), "user", REF).select("user_id", "avg_session_duration")


def user_category_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.exploded_affinity(features.features_as_of(events(spark, sf_dir), "user", REF))


def item_features_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(features.features_as_of(events(spark, sf_dir), "item", REF).drop("popularity_rank_1h"))


def item_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.features_as_of(events(spark, sf_dir), "item", "2024-01-19 13:00:00").select("item_id", "view_count_1h", "popularity_rank_1h")


def user_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.materialise(events(spark, sf_dir), "user", START, END, "6H")


def item_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.materialise(events(spark, sf_dir), "item", START, END, "6H")


def user_snapshots_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(user_grid(spark, sf_dir).drop("category_affinity"))


def user_affinity_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = user_grid(spark, sf_dir).select("user_id", "feature_timestamp", F.posexplode("category_affinity").alias("pos", "category"))
    return naive(rows.select("user_id", "feature_timestamp", (F.col("pos") + 1).cast("long").alias("rank"), "category"))


def item_snapshots_6h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(item_grid(spark, sf_dir))


def rolling_counts_per_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event the user's earlier events in windows before it, itself and events at its time left out."""
    seen = events(spark, sf_dir).withColumn("us", micros(F.col("ts")))
    kind = lambda name: F.col("event_type") == name
    counted = rolling.rolling_counts(seen, "event_id", "user_id", "us", {"views_1h": (kind("item_view"), 1), "views_24h": (kind("item_view"), 24), "purchases_7d": (kind("purchase"), 168)})
    return counted.withColumn("event_id", F.col("event_id").cast("long"))


def entity_history_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = offline_store.history(user_grid(spark, sf_dir).select("user_id", "feature_timestamp", "purchase_count_24h", "item_view_count_24h"), "user", 7, "2024-01-10 00:00:00", "2024-01-17 00:00:00")
    return naive(found)


def nullable_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots where a rate of 0 counts as not known, so that rows have nulls."""
    return user_grid(spark, sf_dir).select("user_id", "feature_timestamp", "purchase_count_24h", F.nullif("conversion_rate_7d", F.lit(0.0)).alias("conversion_rate_7d"), F.when(F.col("total_spend_24h") > 0, F.col("total_spend_24h")).alias("total_spend_24h"))


def latest_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(offline_store.latest_as_of(nullable_snapshots(spark, sf_dir), "user", REF))


def latest_as_of_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(offline_store.latest_as_of(nullable_snapshots(spark, sf_dir), "user", REF, by_column=True))


def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(training.label_events(events(spark, sf_dir), max_labels=5000))


def label_events_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(training.label_events(events(spark, sf_dir), max_labels=None, point_in_time_negatives=True))


def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.class_balance(training.label_events(events(spark, sf_dir), max_labels=None))


USER_COLUMNS, ITEM_COLUMNS = ["purchase_count_24h", "item_view_count_24h", "conversion_rate_7d"], ["view_count_24h", "purchase_count_24h", "avg_rating"]


def _joined(spark: SparkSession, sf_dir: str, with_items: bool, strategy: str = "union") -> DataFrame:
    labels = training.label_events(events(spark, sf_dir), max_labels=None)
    items = item_grid(spark, sf_dir) if with_items else None
    return training.build_training_set(labels, user_grid(spark, sf_dir), items, USER_COLUMNS, ITEM_COLUMNS, strategy=strategy, grid=(START, END, 6))


def pit_join_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(_joined(spark, sf_dir, False))


def pit_join_user_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(_joined(spark, sf_dir, False, "range"))


def pit_join_user_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(_joined(spark, sf_dir, False, "grid"))


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(_joined(spark, sf_dir, True))


def asof_orders_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the supplier's last earlier shipment of its first part, within 30 days: a join with long histories."""
    first = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_suppkey", F.col("o_orderdate").alias("at"))
    shipped = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_shipdate").alias("shipped")).agg(F.sum("l_quantity").cast("long").alias("quantity"))
    return naive(asof.asof_join(orders, shipped, "l_suppkey", "at", "shipped", ["quantity"]))


def asof_orders_any_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``asof_orders_lineitem`` for whole customer segments, however long ago: few keys, long histories, no tolerance."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    orders = read(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "segment", F.col("o_orderdate").alias("at"), "o_totalprice")
    daily = orders.where("o_orderkey % 7 = 0").groupBy("segment", F.col("at").alias("ordered")).agg(F.count("*").alias("n"))
    return naive(asof.asof_join(orders.select("o_orderkey", "segment", "at"), daily, "segment", "at", "ordered", ["n"], tolerance_days=None))


def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.leakage(_joined(spark, sf_dir, True))


def leakage_report_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label of a user whose id is divisible by 10 is given a feature time a second after it."""
    late = F.when(F.col("user_id") % 10 == 0, F.col("label_timestamp") + F.expr("interval 1 second")).otherwise(F.col("feature_timestamp_used"))
    return training.leakage(_joined(spark, sf_dir, True).withColumn("feature_timestamp_used", late))


def online(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None, ref: str = REF) -> DataFrame:
    """Users' and items' features of a time, written then."""
    seen = events(spark, sf_dir) if seen is None else seen
    users = features.features_as_of(seen, "user", ref).select("user_id", "feature_timestamp", "purchase_count_1h", "purchase_count_24h", "item_view_count_24h")
    items = features.features_as_of(seen, "item", ref).select("item_id", "feature_timestamp", "view_count_1h", "view_count_24h", "purchase_count_24h")
    at = F.col("feature_timestamp")
    return online_store.to_online(users, "user", at).unionByName(online_store.to_online(items, "item", at))


def online_ttl_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive(online_store.visible(online(spark, sf_dir), NOW))


def online_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("entity_id")).distinct()
    return online_store.deleted(online(spark, sf_dir), "user", gone).groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_entities"))


def feature_vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = events(spark, sf_dir).where("item_id is not null").select("user_id", "item_id").distinct()
    live = online_store.visible(online(spark, sf_dir), NOW)
    return online_store.vector(live, pairs, ["purchase_count_1h", "purchase_count_24h"], ["view_count_24h"]).withColumn("missing", F.array_join("missing", ","))


def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for both entities, some unknown, one row for each feature that was asked for."""
    asked = read(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("item").alias("entity"), F.pmod("event_id", F.lit(200)).alias("entity_id"))
    requests = asked.withColumn("names", F.when(F.col("entity") == "user", F.array(F.lit("purchase_count_24h"), F.lit("nothing"))).otherwise(F.array(F.lit("view_count_24h"))))
    found = online_store.batch(online(spark, sf_dir), requests)
    return found.select("pos", "entity", "entity_id", F.col("features")[F.when(F.col("entity") == "user", "purchase_count_24h").otherwise("view_count_24h")].alias("value"), F.size("features").cast("long").alias("n"))


def missing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_vector_lookup(spark, sf_dir).groupBy("missing").agg(F.count("*").alias("n"))


def perturbed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Offline features of REF, and online ones off by a fixed share for some users."""
    offline = features.features_as_of(events(spark, sf_dir), "user", REF)
    off = lambda c, every, by: F.when(F.col("user_id") % every == 0, F.col(c) * by).otherwise(F.col(c))
    live = offline.withColumns({"item_view_count_24h": off("item_view_count_24h", 3, 2.0), "total_spend_24h": off("total_spend_24h", 40, 3.0), "conversion_rate_7d": off("conversion_rate_7d", 5, 1.01)})
    return live, offline


CHECKED = ["purchase_count_24h", "item_view_count_24h", "total_spend_24h", "conversion_rate_7d", "days_since_last_purchase", "category_affinity"]


def consistency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, offline = perturbed(spark, sf_dir)
    return consistency.compare(live, offline, "user_id", CHECKED)


def consistency_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency_stats(spark, sf_dir).where("flagged").select("feature_name", "n_inconsistent")


def event_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count("item_id").alias("n_items"))


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event comes twice, the second time an hour later; the earliest stays."""
    seen = events(spark, sf_dir)
    again = seen.where("cast(event_id as long) % 3 = 0").withColumn("ts", F.col("ts") + F.expr("interval 1 hour"))
    return naive(source.deduplicated(seen.unionByName(again)).select(F.col("event_id").cast("long").alias("event_id"), "user_id", "ts"))


def broken_messages(seen: DataFrame) -> DataFrame:
    """Events as messages, four of every seven broken in a way of their own."""
    messages = source.to_messages(seen).withColumn("n", F.pmod(F.get_json_object("value", "$.event_id").cast("long"), F.lit(7)))
    broken = (
        F.when(F.col("n") == 0, F.substring("value", 1, 20))
        .when(F.col("n") == 1, F.regexp_replace("value", '"event_type":"[a-z_]*"', '"event_type":"dance"'))
        .when(F.col("n") == 2, F.replace("value", F.lit('"user_id"'), F.lit('"nobody"')))
        .when(F.col("n") == 3, F.regexp_replace("value", '"timestamp":"[^"]*"', '"timestamp":"soon"'))
        .otherwise(F.col("value"))
    )
    return messages.select(broken.alias("value"))


def parse_events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, some of them broken, parsed again: counts by kind and reason."""
    good, dead = source.parse_events(broken_messages(events(spark, sf_dir)))
    kinds = good.select(F.lit("good").alias("kind"), F.lit("").alias("reason")).unionByName(dead.select(F.lit("dead").alias("kind"), "reason"))
    return kinds.groupBy("kind", "reason").agg(F.count("*").alias("n"))


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = source.parse_events(source.to_messages(events(spark, sf_dir)))
    return naive(good.select(F.col("event_id").cast("long").alias("event_id"), "user_id", "event_type", "item_id", "ts", "session_id", F.col("metadata.category").alias("category"), F.col("metadata.total_amount").alias("total_amount")))


def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = events(spark, sf_dir).groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    return naive(counted.select(F.col("window.start").alias("start"), "event_type", "n"))


def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = events(spark, sf_dir).groupBy(F.window("ts", "24 hours", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return naive(counted.select(F.col("window.start").alias("start"), "user_id", "n"))


def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end where a user is silent for 12 hours."""
    found = events(spark, sf_dir).groupBy(F.session_window("ts", "12 hours"), "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("last"))
    return naive(found.select("user_id", "start", "last", "n"))


def windowed_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts for windows of growing length, to see that they contain each other."""
    seen = events(spark, sf_dir).withColumn("us", micros(F.col("ts")))
    ref = F.unix_micros(F.lit(REF).cast("timestamp"))
    one = lambda h: F.coalesce(F.sum(F.when(in_window(F.col("us"), ref, h), Measure("count", "item_view", h).of_event())), F.lit(0)).alias(f"views_{h or 'all'}")
    return seen.groupBy("user_id").agg(*[one(h) for h in (1, 24, 168, None)])


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature, and how many entities have it as of REF."""
    seen = events(spark, sf_dir).where(F.col("ts") < F.lit(REF).cast("timestamp"))
    counted = seen.agg(F.countDistinct("user_id").alias("user"), F.countDistinct("item_id").alias("item")).unpivot([], ["user", "item"], "entity", "n_entities")
    return default_catalog().frame(spark).join(counted, "entity")


def generated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many synthetic events as the driver's table has, by type: whether the share lies within six standard deviations of the
    weight, and how many rows break a rule of the record."""
    n = read(spark, sf_dir, "events").agg(F.count("*").alias("total"))
    made = generator.historical(spark, n.first()["total"], END)
    expected = F.create_map(*[F.lit(x) for pair in generator.WEIGHTS for x in pair])[F.col("event_type")]
    m, has_item = F.col("metadata"), F.col("event_type").isin("item_view", "add_to_cart", "purchase", "rating")
    broken = (
        (F.col("item_id").isNotNull() != has_item) | (m["price"].isNotNull() != has_item) | (F.col("event_type").isin("rating") & ~m["rating"].between(1, 5)) | ((F.col("event_type") == "purchase") & (F.abs(m["total_amount"] - m["price"] * m["quantity"]) > 0.006))
        | ~F.col("user_id").between(1, 10_000) | ~F.coalesce(F.col("item_id"), F.lit(1)).between(1, 5_000) | (F.col("ts") > F.lit(END).cast("timestamp")) | (F.col("ts") < F.lit(END).cast("timestamp") - F.expr("interval 48 hours"))
    )
    by_type = made.groupBy("event_type").agg(F.count("*").alias("made"), F.count_if(broken).alias("broken"), F.first(expected).alias("weight"))
    total = F.sum("made").over(Window.partitionBy(F.lit(1)))  # six rows
    counted = by_type.withColumn("total", total)
    return counted.select("event_type", "total", "weight", (F.abs(F.col("made") / F.col("total") - F.col("weight")) <= 6 * F.sqrt(F.col("weight") * (1 - F.col("weight")) / F.col("total"))).alias("as_weighted"), "broken")


def label_events_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cap that leaves few views at sf0.01, and one at larger sizes."""
    return naive(training.label_events(events(spark, sf_dir), max_labels=2500))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: beside the checkpoints if the session has a place for them."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        master = spark.sparkContext.master
        top = "/tmp" if master == "local" or master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored_history_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity_history_range`` from the offline store: written by date in two batches, one of them twice, and read by dates."""
    path, grid = scratch(spark, "offline"), user_grid(spark, sf_dir).select("user_id", "feature_timestamp", "purchase_count_24h", "item_view_count_24h")
    early = F.col("feature_timestamp") < F.lit("2024-01-14 00:00:00").cast("timestamp")
    for rows, batch_id in ((grid.where(early), 1), (grid.where(~early), 2), (grid.where(~early), 2)):
        offline_store.write_snapshots(rows, path, "user", batch_id)
    stored = offline_store.read_snapshots(spark, path, "user")
    return naive(offline_store.history(stored, "user", 7, "2024-01-10 00:00:00", "2024-01-17 00:00:00").drop("date"))


def online_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``online_ttl_visible`` from the online store after five upserts of older values and an empty one behind each, buckets merged at every second."""
    seen, table = events(spark, sf_dir), OnlineTable(spark, scratch(spark, "online"), buckets=8, merge_every=1)
    for k, ref in enumerate(("2024-01-05 00:00:00", "2024-01-10 00:00:00", "2024-01-15 00:00:00", "2024-01-19 23:00:00", REF)):
        rows = online(spark, sf_dir, seen, ref)
        table.upsert(rows, 2 * k)
        table.upsert(rows.limit(0), 2 * k + 1)
    return naive(online_store.visible(table.read(), NOW))


def tolerant_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity_history_range`` from an offline store with a file in it that is no Parquet."""
    path, grid = scratch(spark, "offline"), user_grid(spark, sf_dir).select("user_id", "feature_timestamp", "purchase_count_24h", "item_view_count_24h")
    offline_store.write_snapshots(grid, path, "user", 1)
    spark.createDataFrame([("damaged",)], "value string").write.text(f"{path}/entity=user/date=2024-01-12/batch=2")
    stored = offline_store.read_snapshots(spark, path, "user", tolerant=True)
    return naive(offline_store.history(stored, "user", 7, "2024-01-10 00:00:00", "2024-01-17 00:00:00").drop("date"))


def stored_latest_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``latest_as_of_nonnull`` from the offline store."""
    path = scratch(spark, "offline")
    offline_store.write_snapshots(nullable_snapshots(spark, sf_dir), path, "user", 1)
    return naive(offline_store.latest_as_of(offline_store.read_snapshots(spark, path, "user"), "user", REF, by_column=True))


def stored_evolving_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of two batches, the later with a column that the earlier lacks, by date: rows, known values, first and last row."""
    path, grid = scratch(spark, "offline"), user_grid(spark, sf_dir)
    early = F.col("feature_timestamp") < F.lit("2024-01-14 12:00:00").cast("timestamp")
    offline_store.write_snapshots(grid.where(early).select("user_id", "feature_timestamp", "purchase_count_24h"), path, "user", 1)
    offline_store.write_snapshots(grid.where(~early).select("user_id", "feature_timestamp", "purchase_count_24h", "item_view_count_24h"), path, "user", 2)
    by_date = offline_store.read_snapshots(spark, path, "user").groupBy(F.col("date").cast("string").alias("date"))
    return naive(by_date.agg(F.count("*").alias("n"), F.sum("purchase_count_24h").alias("purchases"), F.count("item_view_count_24h").alias("n_views"), F.sum("item_view_count_24h").alias("views"), F.min("feature_timestamp").alias("first"), F.max("feature_timestamp").alias("last")))


def exported_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``training_set`` by way of CSV."""
    path, data = scratch(spark, "csv"), _joined(spark, sf_dir, True)
    training.export_csv(data, path)
    return naive(training.import_csv(spark, path, data.schema))


def exported_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_affinity_6h`` by way of CSV, where lists are text."""
    path, data = scratch(spark, "csv"), user_grid(spark, sf_dir).select("user_id", "feature_timestamp", "category_affinity")
    training.export_csv(data, path)
    rows = training.import_csv(spark, path, data.schema).select("user_id", "feature_timestamp", F.posexplode("category_affinity").alias("pos", "category"))
    return naive(rows.select("user_id", "feature_timestamp", (F.col("pos") + 1).cast("long").alias("rank"), "category"))


def leakage_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten violations that a report shows, where every label of a user whose id is divisible by 10 has a feature a second too new."""
    late = F.when(F.col("user_id") % 10 == 0, F.col("label_timestamp") + F.expr("interval 1 second")).otherwise(F.col("feature_timestamp_used"))
    return naive(training.violations(_joined(spark, sf_dir, True).withColumn("feature_timestamp_used", late)))


def observed_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is counted of ``feature_vector_lookup`` while it is used."""
    names = ["user_purchase_count_1h", "user_purchase_count_24h", "item_view_count_24h"]
    found, watch = metrics.observed(feature_vector_lookup(spark, sf_dir), names)
    found.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([watch.get], "rows long, values long, misses long")


def generated_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many synthetic events as the driver's table has, eight a second: number of events, users and items in range, times, ids."""
    n = read(spark, sf_dir, "events").count()
    made = generator.batch(spark, n, START, 8, n_users=50, n_items=20)
    us = F.unix_micros("ts") - F.unix_micros(F.lit(START).cast("timestamp"))
    return naive(made.agg(F.count("*").alias("n"), F.count_if(us % 125_000 != 0).alias("off_beat"), F.countDistinct("ts").alias("n_times"), F.countDistinct("event_id").alias("n_ids"), F.min("ts").alias("first"), F.max("ts").alias("last")))


#: Where the messages of the streamed queries are cut: a run of the stream for each part, from where the last one stopped.
PARTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def streamed(spark: SparkSession, sf_dir: str, seen: DataFrame | None = None) -> pipeline.Paths:
    """Both stores after three runs over messages that come in three parts, every third message twice.

    The messages of all parts are written by one pass over the events; each part's folder then comes to where the stream reads.
    The stream's state, and what it shuffles, has a partition for each core while it runs.
    """
    paths, seen = pipeline.Paths(scratch(spark, "stream")), events(spark, sf_dir) if seen is None else seen
    seen = seen.withColumn("part", sum(((F.col("ts") >= F.lit(at).cast("timestamp")).cast("int") for at in PARTS), F.lit(0)))
    times = F.when(F.col("event_id").cast("long") % 3 == 0, 2).otherwise(1)
    written = source.to_messages(seen, "part", times.alias("times")).select("value", "part", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("value", "part")
    # A task has a file open for each part, and so needn't sort its messages by part.
    writers = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, str(len(PARTS) + 1))
    try:
        written.write.partitionBy("part").text(paths.ahead)
    finally:
        spark.conf.set(WRITERS, writers)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        for part in range(len(PARTS) + 1):
            # A part without events has no folder.
            if f"part={part}" in files.names(spark, paths.ahead):
                files.move(spark, f"{paths.ahead}/part={part}", f"{paths.messages}/part={part}")
            for query in pipeline.start(source.json_stream(spark, paths.messages, 1_000_000), paths):
                query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return paths


def streamed_user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' snapshots that the stream left in the offline store."""
    stored = pipeline.read_offline(spark, streamed(spark, sf_dir), "user")
    return naive(stored.drop("category_affinity", "avg_session_duration", "date"))


def streamed_online_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items' latest values that the stream left in the online store."""
    live = pipeline.read_online(spark, streamed(spark, sf_dir))
    return naive(live.where("entity = 'item'").where(F.col("feature_name").isin("view_count_24h", "purchase_count_24h", "cart_add_count_1h")))


def streamed_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that the stream set aside, by reason."""
    paths = pipeline.Paths(scratch(spark, "dead"))
    broken_messages(events(spark, sf_dir)).write.text(paths.messages)
    _, dead = pipeline.clean_stream(source.json_stream(spark, paths.messages, 1_000_000))
    pipeline.start_dead_letters(dead, paths).awaitTermination()
    return spark.read.schema("raw string, reason string").json(paths.dead).groupBy("reason").agg(F.count("*").alias("n"))


def streamed_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' snapshots where the purchases of every seventh user have an endless amount: what was set aside, and what all others have."""
    amount = F.when((F.col("user_id") % 7 == 3) & (F.col("event_type") == "purchase"), F.lit(float("inf"))).otherwise(F.col("metadata.total_amount"))
    paths = streamed(spark, sf_dir, events(spark, sf_dir).withColumn("metadata", F.col("metadata").withField("total_amount", amount)))
    kept = pipeline.read_offline(spark, paths, "user").select("user_id", "feature_timestamp", "purchase_count_24h", "total_spend_24h", F.lit(None).cast("string").alias("reason"))
    aside = pipeline.read_rejected(spark, paths).where("entity = 'user'").select(F.col("entity_id").alias("user_id"), "feature_timestamp", "reason")
    return naive(kept.unionByName(aside, allowMissingColumns=True))


def streamed_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups of a stream in two runs: misses of each feature, added over the batches, and whether the merged sketch's quartiles of the
    events' values have the ranks that they should have within two percent."""
    path, names = scratch(spark, "asked"), ["user_purchase_count_1h", "user_purchase_count_24h", "item_view_count_24h"]
    asked = read(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), "value", (F.col("event_id") % 2).alias("part"))
    live, heard = online_store.visible(online(spark, sf_dir), NOW).select(*online_store.KEY, "value_json"), metrics.Served()
    spark.streams.addListener(heard)
    try:
        for part in (0, 1):
            asked.where(F.col("part") == part).write.mode("append").parquet(f"{path}/in")
            source_ = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in")
            found = metrics.measured(online_store.vector(live, source_, ["purchase_count_1h", "purchase_count_24h"], ["view_count_24h"]), names, "value")
            found.writeStream.format("noop").option("checkpointLocation", f"{path}/checkpoints").trigger(availableNow=True).start().awaitTermination()
        spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(heard)
    levels = (0.25, 0.5, 0.75)
    found = heard.quantiles(spark, list(levels))
    ranks = read(spark, sf_dir, "events").agg(*[F.avg((F.col("value") <= q).cast("double")).alias(f"r{i}") for i, q in enumerate(found)]).first()
    good = all(abs(r - q) <= 0.02 for r, q in zip(ranks, levels, strict=True))
    return spark.createDataFrame([(n, heard.rows, heard.misses[n], good) for n in names], "feature string, rows long, misses long, quartiles_good boolean")


def generated_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``generated_batch`` from the live source: five micro-batches, each in a run of its own."""
    n, path = read(spark, sf_dir, "events").count(), scratch(spark, "live")
    each = max(1, -(-n // 5))
    for _ in range(5):
        made = generator.live(spark, each, START, 8, n_users=50, n_items=20)
        made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoints").trigger(availableNow=True).start().awaitTermination()
    us = F.unix_micros("ts") - F.unix_micros(F.lit(START).cast("timestamp"))
    seen = spark.read.parquet(f"{path}/out").where(us < n * 125_000)
    same = generator.batch(spark, n, START, 8, n_users=50, n_items=20)
    whole = lambda df: df.select(F.xxhash64("event_id", "user_id", "event_type", "item_id", "ts", "session_id", "metadata.price", "metadata.category").alias("h"))
    missing = whole(same).join(whole(seen), "h", "left_anti").count()
    return naive(seen.agg(F.count("*").alias("n"), F.count_if(us % 125_000 != 0).alias("off_beat"), F.countDistinct("event_id").alias("n_ids"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.lit(missing).cast("long").alias("missing")))


def generated_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether items' popularity and users' affinities, of as many as the driver's table has events, and the choices that follow them, have the
    moments of their distributions within six standard deviations."""
    n = read(spark, sf_dir, "events").count()
    near = lambda column, mean, deviation, more=0.0: (F.abs(column - F.lit(mean)) <= 6 * F.lit(deviation) / F.sqrt(F.count("*")) + F.lit(more))
    items = spark.range(1, n + 1).select(generator.popularity(F.col("id"), 42).alias("p"))
    users = spark.range(1, n + 1).select(generator.affinity(F.col("id"), 42).alias("a"))
    one = items.agg(near(F.avg("p"), 2 / 7, 0.16).alias("popularity_mean"), near(F.var_pop("p"), 10 / 392, 0.04).alias("popularity_variance"))
    first = F.col("a")[0]
    two = users.agg(near(F.avg(first), 0.1, 0.13).alias("affinity_mean"), near(F.var_pop(first), 0.015, 0.05).alias("affinity_variance"), (F.max(F.abs(F.aggregate("a", F.lit(0.0), lambda x, y: x + y) - 1)) < 1e-9).alias("affinity_sum"))
    made = generator.historical(spark, n, END).where(F.col("event_type").isin("item_view", "add_to_cart", "purchase", "rating"))
    number = ((F.col("item_id") - 1) % len(generator.CATEGORIES)).cast("int")
    chosen = made.select(generator.popularity(F.col("item_id"), 42).alias("p"), F.element_at(generator.affinity(F.col("user_id"), 42), number + 1).alias("own"))
    # Chosen in proportion: the mean is that of the square over the mean, 3/8; a chosen category's share has the mean of ten squares, 1/4.
    three = chosen.agg(near(F.avg("p"), 3 / 8, 0.18, 0.02).alias("chosen_popularity"), near(F.avg("own"), 0.25, 0.3, 0.02).alias("chosen_affinity"))
    found = [x.unpivot([], x.columns, "moment", "good") for x in (one, two, three)]
    return found[0].unionByName(found[1]).unionByName(found[2]).withColumn("n", F.lit(n).cast("long"))


def streamed_hourly(spark: SparkSession, sf_dir: str, entity: str) -> DataFrame:
    """What the stream with state by key leaves in the offline store, stopped and started again halfway."""
    paths, seen = pipeline.Paths(scratch(spark, "keyed")), events(spark, sf_dir)
    late = F.col("ts") >= F.lit(PARTS[0]).cast("timestamp")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), spark.sparkContext.defaultParallelism)))
    try:
        for part in (seen.where(~late), seen.where(late)):
            source.to_messages(part).select("value").write.mode("append").text(paths.messages)
            keyed.start(source.json_stream(spark, paths.messages, 1_000_000), paths, entity).awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return naive(pipeline.read_offline(spark, pipeline.Paths(f"{paths.root}/{entity}"), entity).drop("date"))


def streamed_hourly_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' features at each hour at which an event of theirs begins or ceases to count, up to the watermark."""
    return streamed_hourly(spark, sf_dir, "user")


def streamed_hourly_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed_hourly(spark, sf_dir, "item")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        user_features_asof, user_session_duration, user_category_affinity, item_features_asof, item_popularity, user_snapshots_6h, user_affinity_6h, item_snapshots_6h,
        rolling_counts_per_event, entity_history_range, latest_as_of, latest_as_of_nonnull, label_events, label_events_point_in_time, label_balance, pit_join_user,
        pit_join_user_range, pit_join_user_grid, training_set, asof_orders_lineitem, asof_orders_any_age, leakage_report, leakage_report_injected, online_ttl_visible, online_after_delete,
        feature_vector_lookup, batch_lookup, missing_features, consistency_stats, consistency_flags, event_type_counts, dedup_events, parse_events_json, parsed_events,
        tumbling_window, sliding_window, gap_sessions, windowed_measures, catalog, generated_events,
        label_events_capped, stored_history_range, online_upserted, tolerant_history, stored_latest_as_of, stored_evolving_columns, exported_training_set, exported_affinity,
        leakage_details, observed_lookups, generated_batch, streamed_user_features, streamed_online_items, streamed_dead_letters, streamed_hourly_users, streamed_hourly_items,
        streamed_rejected, streamed_lookups, generated_live, generated_profiles,
    )
}
