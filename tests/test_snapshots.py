"""The bucket roll says the same as the join of grid and events."""

from datetime import datetime, timezone

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.test_features import event
from tidemark.operators.snapshots import materialise, materialise_by_join
from tidemark.schema import EVENT

START, END = datetime(2024, 5, 30, tzinfo=timezone.utc), datetime(2024, 6, 1, 18, tzinfo=timezone.utc)

events_ = st.lists(
    st.builds(
        lambda kind, before, user, item, session, category: (kind, before, user, item, session, category),
        st.sampled_from(["item_view", "purchase", "add_to_cart", "rating", "page_view"]),
        st.sampled_from([0, 3600, 7200, 21600, 86400, 43200]) | st.integers(-9000, 400_000),
        st.integers(1, 3), st.integers(100, 102), st.sampled_from("abc"), st.sampled_from(["x", "y", "z", "w", None]),
    ),
    min_size=1, max_size=40,
)


@pytest.mark.parametrize("entity", ["user", "item"])
def test_roll_equals_join(spark, entity):
    @settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
    @given(events_)
    def run(drawn):
        rows = [event(i, k, b, u, it, s, category=c, price=2.5, rating=float(i % 5 + 1) if k == "rating" else None) for i, (k, b, u, it, s, c) in enumerate(drawn)]
        events = spark.createDataFrame(rows, EVENT)
        a = materialise(events, entity, START, END, "6H")
        b = materialise_by_join(events, entity, START, END, "6H")
        assert a.columns == b.columns
        order = lambda df: sorted(map(str, df.collect()))
        assert order(a) == order(b)

    run()


def test_frequency_is_checked(spark):
    with pytest.raises(ValueError):
        materialise(spark.createDataFrame([], EVENT), "user", START, END, "5H")


def test_empty(spark):
    assert materialise(spark.createDataFrame([], EVENT), "user", START, END, "6H").count() == 0
