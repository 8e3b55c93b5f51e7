"""Labels from events, point-in-time training sets, and the audit for leakage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.asof import asof_join

LABEL_COLUMNS = ("user_id", "timestamp", "label")


def label_events(events: DataFrame, max_labels: int | None = 5000, point_in_time_negatives: bool = False) -> DataFrame:
    """(user_id, item_id, timestamp, label): 1 for purchases, 0 for views of items that the user never bought.

    "Never" looks at all events, the future included; with ``point_in_time_negatives`` only at purchases before the view. The cap
    counts purchases first, but one negative is always let in. Of rows with one user, item and label the earliest stays.
    """
    with_item = events.where("item_id is not null").select("user_id", "item_id", F.col("ts").alias("timestamp"), "event_id", "event_type")
    bought = with_item.where("event_type = 'purchase'")
    viewed = with_item.where("event_type = 'item_view'")
    first = bought.groupBy("user_id", "item_id").agg(F.min("timestamp").alias("bought_at"))
    if point_in_time_negatives:
        negatives = viewed.join(first, ["user_id", "item_id"], "left").where("bought_at is null or bought_at >= timestamp").drop("bought_at")
    else:
        negatives = viewed.join(first, ["user_id", "item_id"], "left_anti")
    if max_labels is not None:
        # At most ``max_labels`` rows are numbered; how many of them stay is asked within the query.
        earliest = negatives.orderBy("timestamp", "event_id").limit(max(1, max_labels))
        place = F.row_number().over(Window.orderBy("timestamp", "event_id"))
        room = F.greatest(F.lit(1), F.lit(max_labels) - bought.agg(F.count("*")).scalar())
        negatives = earliest.withColumn("_place", place).where(F.col("_place") <= room).drop("_place")
    both = bought.withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)))
    kept = both.groupBy("user_id", "item_id", "label").agg(F.min(F.struct("timestamp", "event_id")).alias("first"))
    return kept.select("user_id", "item_id", F.col("first.timestamp").alias("timestamp"), "label")


def class_balance(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def build_training_set(labels: DataFrame, user_snapshots: DataFrame, item_snapshots: DataFrame | None, user_features: list[str], item_features: list[str], tolerance_days: int = 30, strategy: str = "union", grid: tuple[object, object, int] | None = None) -> DataFrame:
    """One row for each label whose user has a snapshot before it: label, times used, user_ and item_ features.

    A label without a user snapshot is dropped; one without an item or an item snapshot keeps its row with nulls. Features that a
    snapshot lacks are null. ``item_feature_timestamp_used`` lets the audit see items as well.
    """
    if missing := [c for c in LABEL_COLUMNS if c not in labels.columns]:
        raise ValueError(f"labels lack {', '.join(missing)}")

    def renamed(snapshots: DataFrame, entity: str, names: list[str], ts: str) -> DataFrame:
        value = lambda n: F.col(n) if n in snapshots.columns else F.lit(None)
        return snapshots.select(f"{entity}_id", F.col("feature_timestamp").alias(ts), *[value(n).alias(f"{entity}_{n}") for n in names])

    with_item = "item_id" in labels.columns and item_snapshots is not None
    base = labels.select("user_id", "label", F.col("timestamp").alias("label_timestamp"), *(["item_id"] if "item_id" in labels.columns else []))
    out = asof_join(base, renamed(user_snapshots, "user", user_features, "feature_timestamp_used"), "user_id", "label_timestamp", "feature_timestamp_used", [f"user_{n}" for n in user_features], "inner", tolerance_days, strategy, grid=grid)
    if with_item:
        items = renamed(item_snapshots, "item", item_features, "item_feature_timestamp_used")
        out = asof_join(out, items, "item_id", "label_timestamp", "item_feature_timestamp_used", [f"item_{n}" for n in item_features], "left", tolerance_days, strategy, grid=grid)
    first = ["user_id", "label", "label_timestamp", "feature_timestamp_used", *(["item_id"] if "item_id" in labels.columns else [])]
    return out.select(*first, *[c for c in out.columns if c not in first])


@dataclass(frozen=True)
class LeakageReport:
    passed: bool
    violations: int
    total_rows: int
    details: list[str]

    def summary(self) -> str:
        return f"{'PASSED' if self.passed else 'FAILED'}: {self.violations} of {self.total_rows} rows use a feature that is not older than the label"


def leakage(dataset: DataFrame) -> DataFrame:
    """(total_rows, violations, item_violations) in one row; a missing time is no violation."""
    late = lambda c: F.count_if(F.col(c) >= F.col("label_timestamp")) if c in dataset.columns else F.lit(0).cast("long")
    return dataset.agg(F.count("*").alias("total_rows"), late("feature_timestamp_used").alias("violations"), late("item_feature_timestamp_used").alias("item_violations"))


def violations(dataset: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` violations, in order of time, user and entity: (label_timestamp, user_id, entity, feature_timestamp_used)."""
    used = {"user": "feature_timestamp_used", "item": "item_feature_timestamp_used"}
    found = F.array(*[F.struct(F.lit(e).alias("entity"), F.col(c).alias("feature_timestamp_used")) for e, c in used.items() if c in dataset.columns])
    each = dataset.select("label_timestamp", "user_id", F.inline(found)).where("feature_timestamp_used >= label_timestamp")
    return each.orderBy("label_timestamp", "user_id", "entity", "feature_timestamp_used").limit(most)


def validate_no_leakage(dataset: DataFrame) -> LeakageReport:
    missing = [c for c in ("feature_timestamp_used", "label_timestamp") if c not in dataset.columns]
    if missing:
        n = dataset.count()
        return LeakageReport(False, n, n, [f"column missing: {c}" for c in missing])
    row = leakage(dataset).first()
    bad = row["violations"] + row["item_violations"]
    rows = violations(dataset).collect() if bad else []
    return LeakageReport(bad == 0, bad, row["total_rows"], [f"user {r['user_id']}: {r['entity']} feature {r['feature_timestamp_used']} is not before label {r['label_timestamp']}" for r in rows])


#: With microseconds, which Spark's own default cuts off.
CSV = {"header": True, "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def export_csv(dataset: DataFrame, path: str) -> None:
    """CSV with a header; arrays as JSON. One file for each partition."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in dataset.dtypes]
    dataset.select(*flat).write.mode("overwrite").options(**CSV).csv(path)


def import_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``export_csv`` wrote of a dataset with this schema; JSON as arrays, structs and maps again."""
    nested = {f.name: f.dataType for f in schema if isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType)}
    text = T.StructType([T.StructField(f.name, T.StringType() if f.name in nested else f.dataType) for f in schema])
    return spark.read.options(**CSV).schema(text).csv(path).withColumns({c: F.from_json(c, t) for c, t in nested.items()})
