"""The latest value of every feature, with a time to live for each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.catalog import Catalog, default_catalog
from tidemark.operators.features import key_of

KEY = ("entity", "entity_id", "feature_name")


def as_json(value: Column, kind: str) -> Column:
    """A value as JSON text; an infinite number becomes null, as JSON has none."""
    if kind in ("double", "float"):
        value = F.when(F.abs(value) != F.lit(float("inf")), value)
    if kind.startswith(("array", "struct", "map")):
        return F.to_json(value)
    return F.when(value.isNotNull(), F.substring_index(F.substring(F.to_json(F.struct(value.alias("v"))), 6, 1 << 30), "}", 1)) if kind != "string" else F.when(value.isNotNull(), F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', "$1"))


def to_online(features: DataFrame, entity: str, written_at: Column, catalog: Catalog | None = None, default_ttl: int = 86400) -> DataFrame:
    """A wide row for each entity to one row for each feature: KEY, value_json, written_at, expires_at."""
    catalog = catalog or default_catalog()
    key = key_of(entity)
    kinds = dict(features.dtypes)
    names = [c for c in features.columns if c not in (key, "feature_timestamp", "date")]
    one = lambda n: F.struct(F.lit(n).alias("feature_name"), as_json(F.col(n), kinds[n]).alias("value_json"), F.lit(catalog.ttl(entity, n, default_ttl)).cast("long").alias("ttl"))
    rows = features.select(F.lit(entity).alias("entity"), F.col(key).alias("entity_id"), written_at.alias("written_at"), F.explode(F.array(*[one(n) for n in names])).alias("f"))
    return rows.select("entity", "entity_id", "f.feature_name", "f.value_json", "written_at", F.timestamp_seconds(F.unix_micros("written_at") / 1e6 + F.col("f.ttl")).alias("expires_at"))


def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """The latest row of each key; of rows written at one time, the one that expires last."""
    both = new if old is None else old.unionByName(new)
    rest = [c for c in new.columns if c not in KEY]
    latest = F.max_by(F.struct(*rest), F.struct("written_at", "expires_at", "value_json"))
    return both.groupBy(*KEY).agg(latest.alias("r")).select(*KEY, "r.*")


def visible(online: DataFrame, now: datetime | str | Column) -> DataFrame:
    """Rows that haven't expired, with the whole seconds they have left."""
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    left = F.floor((F.unix_micros("expires_at") - F.unix_micros(at)) / 1_000_000).cast("long")
    return online.where(F.col("expires_at") > at).withColumn("ttl_seconds", left)


def deleted(online: DataFrame, entity: str, ids: DataFrame) -> DataFrame:
    """Without any feature of the given ids (column entity_id) of one entity."""
    key_of(entity)
    gone = ids.select(F.lit(entity).alias("entity"), F.col("entity_id"))
    return online.join(gone, ["entity", "entity_id"], "left_anti")


def lookup(online: DataFrame, entity: str, ids: DataFrame, names: list[str], prefix: str = "", key: str | None = None) -> DataFrame:
    """``ids`` with one JSON column for each name, null where there is none."""
    key = key or key_of(entity)
    wide = online.where((F.col("entity") == entity) & F.col("feature_name").isin(*names)).groupBy("entity_id").agg(*[F.max(F.when(F.col("feature_name") == n, F.col("value_json"))).alias(f"{prefix}{n}") for n in names])
    return ids.join(wide, ids[key] == wide["entity_id"], "left").select(*ids.columns, *[f"{prefix}{n}" for n in names])


def vector(online: DataFrame, pairs: DataFrame, user_names: list[str], item_names: list[str]) -> DataFrame:
    """(user_id, item_id) pairs with user_ and item_ features, and the names of those that are missing."""
    out = lookup(online, "item", lookup(online, "user", pairs, user_names, "user_"), item_names, "item_")
    names = [f"user_{n}" for n in user_names] + [f"item_{n}" for n in item_names]
    return out.withColumn("missing", missing(names))


def missing(names: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names])) if names else F.array().cast("array<string>")


def batch(online: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (pos, entity, entity_id, names: array) to rows (pos, entity, entity_id, features: map), order and repeats kept in pos."""
    asked = requests.select("pos", "entity", "entity_id", F.explode_outer("names").alias("feature_name"))
    found = asked.join(online.select(*KEY, "value_json"), list(KEY), "left")
    pairs = F.collect_list(F.when(F.col("feature_name").isNotNull(), F.struct("feature_name", "value_json")))
    return found.groupBy("pos", "entity", "entity_id").agg(F.map_from_entries(F.array_distinct(pairs)).alias("features"))
