"""State by key: equal to batch at each hour, through restarts, and falling to nothing without events."""

from datetime import datetime, timedelta, timezone

import pandas as pd

from tidemark.catalog import default_catalog
from tidemark.operators.snapshots import materialise
from tidemark.schema import EVENT
from tidemark.sources import events as source
from tidemark.streaming import keyed, pipeline

T0 = datetime(2024, 6, 1, tzinfo=timezone.utc)


def run(spark, rows, paths, entity):
    """Rows as messages, through a run of the stream from where the last stopped: its batches' numbers of rows."""
    source.to_messages(spark.createDataFrame(rows, EVENT)).select("value").write.mode("append").text(paths.messages)
    query = keyed.start(source.json_stream(spark, paths.messages), paths, entity)
    query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress]


def event(i, user, kind, item, hours, rating=None):
    meta = {"price": 2.5, "category": "c", "quantity": 1, "total_amount": 5.0 if kind == "purchase" else None, "rating": rating, "query": None, "results_count": None, "page": None}
    return (f"e{i}", user, kind, item, T0 + timedelta(hours=hours), "s", meta)


def test_restarts_expiry_and_own_rows_only(spark, tmp_path):
    paths = pipeline.Paths(str(tmp_path))
    first = [event(i, i % 3, ("item_view", "purchase", "add_to_cart")[i % 3], i % 4, i * 0.7) for i in range(60)]
    # User 0 has no event after these; user 9's move the watermark on by twelve days.
    second = [event(100 + i, 9, "item_view", 3, 60 + 24 * i) for i in range(12)]
    third = [event(200, 9, "purchase", 3, 400)]
    sizes = [run(spark, rows, paths, "user") for rows in (first, second, third)]
    assert [sum(s) for s in sizes] == [60, 12, 1]
    stored = pipeline.read_offline(spark, pipeline.Paths(f"{paths.root}/user"), "user").drop("date")
    names = keyed.additive(default_catalog(), "user").names("user")
    assert {"category_affinity", "avg_session_duration"}.isdisjoint(names)
    every = spark.createDataFrame(first + second + third, EVENT)
    grid = materialise(every, "user", T0, T0 + timedelta(hours=399), "1H").select(stored.columns)
    # Each row is the grid's, and each hour at which the grid's features change by more than the days since a purchase has one.
    rows, expected = {(r[0], r[1]): tuple(r)[2:] for r in stored.collect()}, {(r[0], r[1]): tuple(r)[2:] for r in grid.collect()}
    assert all(rows[k] == expected[k] for k in rows) and len(rows) == stored.count()
    changing = [n for n in stored.columns[2:] if n != "days_since_last_purchase"]
    before = {}
    for key in sorted(expected):
        now = tuple(v for n, v in zip(stored.columns[2:], expected[key], strict=True) if n in changing)
        if before.get(key[0], (0,) * len(now)) != now:
            assert key in rows
        before[key[0]] = now
    last = {k[0]: rows[k] for k in sorted(rows)}
    assert all(v == 0 for n, v in zip(stored.columns[2:], last[0], strict=True) if n in changing)
    # The online store has each user's last values.
    online = {(r["entity_id"], r["feature_name"]): r["value_json"] for r in pipeline.read_online(spark, pipeline.Paths(f"{paths.root}/user")).collect()}
    assert online[0, "item_view_count_24h"] == "0" and online[9, "item_view_count_24h"] == "0"


def test_items_and_their_popularity(spark, tmp_path):
    paths = pipeline.Paths(str(tmp_path))
    rows = [event(i, i, "item_view", i % 3, i % 5 * 0.2) for i in range(20)] + [event(50, 1, "rating", 7, 0.5, 4.0), event(51, 1, "page_view", None, 0.6), event(52, 1, "item_view", 1, 30)]
    run(spark, rows, paths, "item")
    stored = pipeline.read_offline(spark, pipeline.Paths(f"{paths.root}/item"), "item").drop("date")
    grid = materialise(spark.createDataFrame(rows, EVENT), "item", T0, T0 + timedelta(hours=29), "1H").select(stored.columns)
    expected = {(r[0], r[1]): tuple(r) for r in grid.collect()}
    got = {(r[0], r[1]): tuple(r) for r in stored.collect()}
    assert got == {k: expected[k] for k in got}
    assert sorted({(k[1].day, k[1].hour) for k in got}) == [(1, 1), (1, 2), (2, 1)] and len(got) == 12  # four items as they begin to count, an hour and a day later


def test_old_hours_are_folded(spark):
    """What no window sees any more is one row of state; measures without a window keep it."""

    class Handle:
        def __init__(self):
            self.value, self.timers = None, set()

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Times:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

        getCurrentWatermarkInMs = getExpiryTimeInMs

    measures = [m for s in keyed.additive(default_catalog(), "item").of("item") for m in s.measures]
    p, handle = keyed.Hourly("item_id", list(dict.fromkeys(measures))), Handle()
    p.init(handle)
    given = pd.DataFrame({"hour": [float(h) for h in range(1, 201)], **{f"b{j}": [1.0] * 200 for j in range(len(p.bases))}})
    assert list(p.handleInputRows((5,), iter([given[:100], given[100:]]), None)) == [] and handle.timers == {keyed.HOUR_MS}
    out = pd.concat(p.handleExpiredTimer((5,), Times(210 * keyed.HOUR_MS), Times(210 * keyed.HOUR_MS)))
    handle.timers.discard(keyed.HOUR_MS)
    assert out["hour"].tolist() == list(range(1, 211)) and handle.timers == {211 * keyed.HOUR_MS}
    rows = p._held()[0]
    assert len(rows) == 1 + 14 and rows[0, 1] == 186
    rated = next(m.name for m in measures if m.kind == "rating_n")
    assert out[rated].tolist()[-1] == 200 and out["count_item_view_24h"].tolist()[-1] == 14
    list(p.handleExpiredTimer((5,), Times(400 * keyed.HOUR_MS), Times(400 * keyed.HOUR_MS)))
    assert len(p._held()[0]) == 1
