"""Whether online and offline values of features agree."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.features import relative_difference, rounded

RELATIVE_THRESHOLD = RATE_THRESHOLD = 0.05


def compare(online: DataFrame, offline: DataFrame, key: str, features: list[str], ids: DataFrame | None = None) -> DataFrame:
    """One row for each feature with at least one pair: n_compared, n_inconsistent, rates, differences, flagged.

    A pair counts if both values are there. Numbers differ by their relative difference, all else by being unequal (0 or 1).
    ``ids`` restricts the entities; an id given twice counts twice.
    """
    asked = (ids if ids is not None else offline.select(key)).select(key)
    shared = [f for f in features if f in online.columns and f in offline.columns]
    kinds = dict(offline.dtypes)
    numeric = lambda f: kinds[f] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[f].startswith("decimal")
    joined = asked.join(online.select(key, *[F.col(f).alias(f"_on_{f}") for f in shared]), key).join(offline.select(key, *[F.col(f).alias(f"_off_{f}") for f in shared]), key)

    def difference(f: str) -> Column:
        a, b = F.col(f"_on_{f}"), F.col(f"_off_{f}")
        if not numeric(f):
            return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 0.0).otherwise(1.0))
        a, b = a.cast("double"), b.cast("double")
        return F.when(a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b), relative_difference(a, b))

    if not shared:
        return asked.sparkSession.createDataFrame([], STATS)
    pairs = joined.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature_name"), difference(f).alias("diff")) for f in shared])).alias("p")).select("p.*").where("diff is not null")
    rate = F.count_if(F.col("diff") > RELATIVE_THRESHOLD) / F.count("*")
    return pairs.groupBy("feature_name").agg(
        F.count("*").alias("n_compared"),
        F.count_if(F.col("diff") > RELATIVE_THRESHOLD).alias("n_inconsistent"),
        rounded(rate, 4).alias("inconsistency_rate"),
        rounded(F.avg("diff"), 4).alias("mean_relative_diff"),
        rounded(F.max("diff"), 4).alias("max_relative_diff"),
        (rate > RATE_THRESHOLD).alias("flagged"),
    )


STATS = "feature_name string, n_compared long, n_inconsistent long, inconsistency_rate double, mean_relative_diff double, max_relative_diff double, flagged boolean"


@dataclass(frozen=True)
class ConsistencyReport:
    entity: str
    total_checked: int
    inconsistent_features: list[str]
    per_feature_stats: list[dict]
    passed: bool
    checked_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def summary(self) -> str:
        bad = ", ".join(self.inconsistent_features) or "none"
        return f"[{'PASS' if self.passed else 'FAIL'}] {self.entity}: {self.total_checked} checked, inconsistent features: {bad}"


def check(online: DataFrame, offline: DataFrame, entity: str, features: list[str], ids: DataFrame) -> ConsistencyReport:
    """The statistics as a report; there is a row for each feature, so collecting them is bounded by the catalog."""
    if entity not in ("user", "item"):
        raise ValueError(f"unknown entity: {entity}")
    stats = [r.asDict() for r in compare(online, offline, f"{entity}_id", features, ids).orderBy("feature_name").collect()]
    bad = [s["feature_name"] for s in stats if s["flagged"]]
    return ConsistencyReport(entity, ids.count(), bad, stats, not bad)
