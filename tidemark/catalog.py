"""The feature catalog: what each feature is, and how its value comes from measures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.features import DAY_US, Measure, ratio, rounded

#: From the measures' columns and the reference time in microseconds to the feature's column.
Finish = Callable[[Callable[[Measure], Column], Column], Column]


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    entity: str
    dtype: str
    ttl_seconds: int
    window: str | None
    description: str
    measures: tuple[Measure, ...] = field(repr=False, default=())
    finish: Finish = field(repr=False, compare=False, default=lambda m, ref: F.lit(None))


class Catalog:
    """Features by (entity, name): two entities may use one name. A registered feature is computed wherever features are."""

    def __init__(self, specs: tuple[FeatureSpec, ...] = ()):
        self._specs: dict[tuple[str, str], FeatureSpec] = {}
        for s in specs:
            self.register(s)

    def register(self, spec: FeatureSpec) -> None:
        if spec.entity not in ("user", "item"):
            raise ValueError(f"unknown entity: {spec.entity}")
        self._specs.setdefault((spec.entity, spec.name), spec)

    def get(self, entity: str, name: str) -> FeatureSpec:
        return self._specs[entity, name]

    def __contains__(self, key: tuple[str, str]) -> bool:
        return key in self._specs

    def of(self, entity: str) -> list[FeatureSpec]:
        if entity not in ("user", "item"):
            raise ValueError(f"unknown entity: {entity}")
        return [s for (e, _), s in self._specs.items() if e == entity]

    def names(self, entity: str) -> list[str]:
        return [s.name for s in self.of(entity)]

    def all(self) -> list[FeatureSpec]:
        return list(self._specs.values())

    def ttl(self, entity: str, name: str, default: int = 86400) -> int:
        return self._specs[entity, name].ttl_seconds if (entity, name) in self._specs else default

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s.entity, s.name, s.dtype, s.ttl_seconds, s.window, s.description) for s in self.all()]
        return spark.createDataFrame(rows, "entity string, name string, dtype string, ttl_seconds long, window string, description string")


def _count(name: str, entity: str, event_type: str, hours: int, description: str) -> FeatureSpec:
    m = Measure("count", event_type, hours)
    return FeatureSpec(name, entity, "int", hours * 3600, f"{hours}h", description, (m,), lambda of, ref: F.coalesce(of(m), F.lit(0)).cast("long"))


def _amount(name: str, entity: str, hours: int, description: str) -> FeatureSpec:
    m = Measure("amount", "purchase", hours)
    return FeatureSpec(name, entity, "float", hours * 3600, f"{hours}h", description, (m,), lambda of, ref: F.round(F.coalesce(of(m), F.lit(0.0)), 4))


def _conversion(name: str, entity: str, hours: int, window: str, description: str) -> FeatureSpec:
    bought, seen = Measure("count", "purchase", hours), Measure("count", "item_view", hours)
    return FeatureSpec(name, entity, "float", hours * 3600, window, description, (bought, seen), lambda of, ref: ratio(F.coalesce(of(bought), F.lit(0)), of(seen), 6))


_LENGTH, _SESSIONS, _CATEGORIES = Measure("session_us"), Measure("session_n"), Measure("categories", "item_view", 24)
_LAST, _RATED, _RATINGS, _SEEN = Measure("last", "purchase"), Measure("rating_sum", "rating"), Measure("rating_n", "rating"), Measure("count", "item_view", 1)


def default_catalog() -> Catalog:
    return Catalog(
        (
            _count("purchase_count_1h", "user", "purchase", 1, "Purchases in the last hour"),
            _count("purchase_count_24h", "user", "purchase", 24, "Purchases in the last day"),
            _count("item_view_count_1h", "user", "item_view", 1, "Item views in the last hour"),
            _count("item_view_count_24h", "user", "item_view", 24, "Item views in the last day"),
            _count("cart_count_1h", "user", "add_to_cart", 1, "Additions to the cart in the last hour"),
            _amount("total_spend_24h", "user", 24, "Money spent in the last day"),
            FeatureSpec("avg_session_duration", "user", "float", 86400, None, "Mean length of sessions, in minutes", (_LENGTH, _SESSIONS), lambda of, ref: ratio(of(_LENGTH) / F.lit(60e6), of(_SESSIONS), 4)),
            _conversion("conversion_rate_7d", "user", 168, "7d", "Purchases for each item view in the last week"),
            FeatureSpec("category_affinity", "user", "list", 86400, "24h", "The three categories viewed most in the last day", (_CATEGORIES,), lambda of, ref: F.coalesce(of(_CATEGORIES), F.array().cast("array<string>"))),
            FeatureSpec("days_since_last_purchase", "user", "float", 86400, None, "Days since the last purchase, infinite if none", (_LAST,), lambda of, ref: F.coalesce(rounded((ref - of(_LAST)) / F.lit(float(DAY_US)), 4), F.lit(float("inf")))),
            _count("view_count_1h", "item", "item_view", 1, "Views in the last hour"),
            _count("view_count_24h", "item", "item_view", 24, "Views in the last day"),
            _count("purchase_count_24h", "item", "purchase", 24, "Purchases in the last day"),
            _count("cart_add_count_1h", "item", "add_to_cart", 1, "Additions to carts in the last hour"),
            FeatureSpec("avg_rating", "item", "float", 86400, None, "Mean rating, 0 if none", (_RATED, _RATINGS), lambda of, ref: ratio(of(_RATED), of(_RATINGS), 4)),
            _conversion("conversion_rate_24h", "item", 24, "24h", "Purchases for each view in the last day"),
            _amount("revenue_24h", "item", 24, "Money taken in the last day"),
            # A share of the snapshot's largest count, not a rank; the division by that count is done by the snapshot.
            FeatureSpec("popularity_rank_1h", "item", "float", 3600, "1h", "Views in the last hour as a share of the most viewed item's", (_SEEN,), lambda of, ref: F.coalesce(of(_SEEN), F.lit(0)).cast("double")),
        )
    )
