"""Features as of one time: boundaries, defaults and ties, on events around a fixed time."""

from datetime import datetime, timedelta, timezone

import pytest

from tidemark.catalog import Catalog, FeatureSpec, default_catalog
from tidemark.functions.features import Measure
from tidemark.operators.features import features_as_of
from tidemark.schema import EVENT

REF = datetime(2024, 6, 1, 12, tzinfo=timezone.utc)
HOUR, DAY = 3600, 86400


def event(number, kind, seconds_before, user=1, item=101, session="s", **metadata):
    row = {k: metadata.get(k) for k in ("price", "category", "quantity", "total_amount", "rating", "query", "results_count", "page")}
    return (str(number), user, kind, None if kind == "page_view" else item, REF - timedelta(seconds=seconds_before), session, row)


@pytest.fixture
def of(spark):
    def run(events, entity="user", ref=REF):
        key = f"{entity}_id"
        return {r[key]: r.asDict() for r in features_as_of(spark.createDataFrame(events, EVENT), entity, ref).collect()}

    return run


def test_window_begins_inclusive_and_ends_exclusive(of):
    found = of([event(1, "purchase", HOUR), event(2, "purchase", HOUR + 1), event(3, "purchase", 0), event(4, "purchase", -60), event(5, "item_view", 10)])[1]
    assert (found["purchase_count_1h"], found["purchase_count_24h"], found["item_view_count_1h"]) == (1, 2, 1)


def test_counts_by_type(of):
    found = of([event(i, "item_view", 60 * i) for i in range(1, 6)] + [event(10, "add_to_cart", 30), event(11, "page_view", 20)])[1]
    assert (found["item_view_count_1h"], found["cart_count_1h"], found["purchase_count_24h"]) == (5, 1, 0)


def test_spend_falls_back_to_price(of):
    found = of([event(1, "purchase", 10, total_amount=20.5, price=99.0), event(2, "purchase", 20, price=5.25), event(3, "purchase", 30), event(4, "item_view", 5, price=7.0)])[1]
    assert found["total_spend_24h"] == 25.75


def test_conversion(of):
    assert of([event(1, "purchase", 10)])[1]["conversion_rate_7d"] == 0.0
    found = of([event(1, "purchase", 10), event(2, "item_view", 20), event(3, "item_view", 6 * DAY), event(4, "item_view", 8 * DAY), event(5, "item_view", 30)])[1]
    assert found["conversion_rate_7d"] == round(1 / 3, 6)


def test_sessions_of_one_event_do_not_count(of):
    events = [event(1, "page_view", 1200, session="a"), event(2, "page_view", 600, session="a"), event(3, "page_view", 3000, session="b"), event(4, "page_view", 1200, session="b"), event(5, "page_view", 50, session="c")]
    assert of(events)[1]["avg_session_duration"] == 20.0
    assert of(events[4:])[1]["avg_session_duration"] == 0.0


def test_days_since_purchase(of):
    assert of([event(1, "item_view", 10)])[1]["days_since_last_purchase"] == float("inf")
    assert of([event(1, "purchase", 3 * DAY), event(2, "purchase", DAY // 2)])[1]["days_since_last_purchase"] == 0.5


def test_affinity_top_three_ties_by_first_seen(of):
    seen = ["b", "a", "c", "d", "a", ""]
    events = [event(i, "item_view", 1000 - i, category=c) for i, c in enumerate(seen)] + [event(9, "item_view", 2 * DAY, category="z"), event(10, "purchase", 5, category="d")]
    assert of(events)[1]["category_affinity"] == ["a", "b", "c"]
    assert of([event(1, "purchase", 5)])[1]["category_affinity"] == []


def test_items(of):
    events = [event(1, "item_view", 10), event(2, "item_view", 20, item=202), event(3, "item_view", 30), event(4, "purchase", 40, total_amount=10.0), event(5, "rating", 9 * DAY, rating=4.0), event(6, "rating", 50, rating=3.0), event(7, "rating", 60), event(8, "page_view", 5)]
    found = of(events, "item")
    assert set(found) == {101, 202}
    first = found[101]
    assert (first["view_count_1h"], first["purchase_count_24h"], first["revenue_24h"], first["conversion_rate_24h"], first["avg_rating"], first["popularity_rank_1h"]) == (2, 1, 10.0, 0.5, 3.5, 1.0)
    assert (found[202]["popularity_rank_1h"], found[202]["avg_rating"], found[202]["conversion_rate_24h"]) == (0.5, 0.0, 0.0)


def test_popularity_without_views(of):
    assert of([event(1, "purchase", 10)], "item")[101]["popularity_rank_1h"] == 0.0


def test_entity_without_recent_events_has_a_row(of):
    assert of([event(1, "page_view", 40 * DAY)])[1]["item_view_count_24h"] == 0
    assert of([event(1, "page_view", -5)]) == {}


def test_catalog_keeps_both_features_of_one_name():
    catalog = default_catalog()
    assert len(catalog.all()) == 18 and len(catalog.of("user")) == 10
    assert ("item", "purchase_count_24h") in catalog and ("user", "purchase_count_24h") in catalog
    assert catalog.ttl("item", "view_count_1h") == 3600 and catalog.ttl("item", "nothing", 5) == 5
    with pytest.raises(ValueError):
        catalog.of("shop")


def test_registered_feature_is_computed(spark):
    searches = Measure("count", "search", 24)
    catalog = Catalog((FeatureSpec("searches_24h", "user", "int", DAY, "24h", "Searches", (searches,), lambda of, ref: of(searches)),))
    events = spark.createDataFrame([event(1, "search", 10), event(2, "search", 20)], EVENT)
    assert features_as_of(events, "user", REF, catalog).first()["searches_24h"] == 2
