"""As-of joins, labels, training sets and the audit."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from tests.test_features import event
from tidemark.operators.asof import asof_join
from tidemark.operators.training import build_training_set, export_csv, import_csv, label_events, leakage, validate_no_leakage
from tidemark.schema import EVENT

T0 = datetime(2024, 7, 1, 12, tzinfo=timezone.utc)
DAY = timedelta(days=1)


def labels(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long, timestamp timestamp, label int")


def snaps(spark, entity, rows):
    return spark.createDataFrame(rows, f"{entity}_id long, feature_timestamp timestamp, n long")


def test_strictly_before_and_most_recent(spark):
    users = snaps(spark, "user", [(1, T0 - 3 * DAY, 1), (1, T0 - DAY, 2), (1, T0, 3), (1, T0 + DAY, 4)])
    out = build_training_set(labels(spark, [(1, None, T0, 1), (1, None, T0 - 2 * DAY, 0), (1, None, T0, 1)]), users, None, ["n"], [])
    assert sorted((r["label"], r["user_n"]) for r in out.collect()) == [(0, 1), (1, 2), (1, 2)]


@pytest.mark.parametrize("strategy", ["union", "range"])
def test_tolerance_is_inclusive(spark, strategy):
    users = snaps(spark, "user", [(1, T0 - 30 * DAY, 1), (2, T0 - 30 * DAY - timedelta(microseconds=1), 2)])
    out = build_training_set(labels(spark, [(1, None, T0, 1), (2, None, T0, 1)]), users, None, ["n"], [], strategy=strategy)
    assert [r["user_id"] for r in out.collect()] == [1]


def test_cold_users_drop_and_cold_items_stay(spark):
    users, items = snaps(spark, "user", [(1, T0 - DAY, 5)]), snaps(spark, "item", [(7, T0 - DAY, 9)])
    out = build_training_set(labels(spark, [(1, 7, T0, 1), (1, 8, T0, 0), (2, 7, T0, 1), (1, None, T0, 0)]), users, items, ["n", "lacking"], ["n"])
    assert sorted((r["item_id"] or 0, r["item_n"]) for r in out.collect()) == [(0, None), (7, 9), (8, None)]
    assert out.columns == ["user_id", "label", "label_timestamp", "feature_timestamp_used", "item_id", "user_n", "user_lacking", "item_feature_timestamp_used", "item_n"]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="timestamp"):
        build_training_set(spark.createDataFrame([(1, 1)], "user_id long, label int"), snaps(spark, "user", []), None, [], [])


@pytest.mark.parametrize("strategy", ["union", "range"])
def test_against_brute_force(spark, strategy):
    draw = random.Random(3)
    at = lambda: T0 + timedelta(hours=draw.randint(0, 2000))
    left = [(i, draw.choice([1, 2, 3, None]), at()) for i in range(200)]
    right = list({(draw.choice([1, 2, 4]), at()) for _ in range(150)})
    a = spark.createDataFrame(left, "id long, k long, t timestamp")
    b = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(right)], "k long, s timestamp, v long")
    found = {r["id"]: r["v"] for r in asof_join(a, b, "k", "t", "s", ["v"], tolerance_days=10, strategy=strategy).collect()}
    for i, k, t in left:
        fits = [(s, v) for v, (kk, s) in enumerate(right) if kk == k and t - 10 * DAY <= s < t]
        assert found[i] == (max(fits)[1] if fits else None)


def test_labels(spark):
    events = [event(1, "item_view", 100), event(2, "purchase", 50), event(3, "item_view", 90, item=5), event(4, "item_view", 80, item=5), event(5, "purchase", 40), event(6, "item_view", 70, item=6), event(7, "page_view", 10)]
    frame = spark.createDataFrame(events, EVENT)
    found = lambda **kw: sorted((r["item_id"], r["label"]) for r in label_events(frame, **kw).collect())
    assert found() == [(5, 0), (6, 0), (101, 1)]
    assert found(max_labels=1) == [(5, 0), (101, 1)]
    assert found(point_in_time_negatives=True) == [(5, 0), (6, 0), (101, 0), (101, 1)]


def test_leakage(spark):
    kind = "user_id long, label_timestamp timestamp, feature_timestamp_used timestamp, label int"
    clean = spark.createDataFrame([(i, T0, T0 - DAY, 1) for i in range(5)], kind)
    assert validate_no_leakage(clean).passed
    bad = clean.unionByName(spark.createDataFrame([(i, T0, T0 + timedelta(seconds=i), 1) for i in range(12)], kind))
    report = validate_no_leakage(bad)
    assert (report.passed, report.violations, report.total_rows, len(report.details)) == (False, 12, 17, 10)
    assert "12 of 17" in report.summary()
    missing = validate_no_leakage(clean.drop("feature_timestamp_used"))
    assert not missing.passed and missing.violations == 5
    assert leakage(clean.withColumn("feature_timestamp_used", clean["label_timestamp"] - timedelta(days=1))).first()["violations"] == 0


def test_items_are_among_the_violations_shown(spark):
    kind = "user_id long, feature_timestamp_used timestamp, item_feature_timestamp_used timestamp, label_timestamp timestamp, label int"
    rows = [(1, T0 - DAY, T0, T0, 1), (2, T0 + DAY, None, T0, 0), (3, T0 - DAY, T0 - DAY, T0, 1), (4, None, None, T0, 1)]
    report = validate_no_leakage(spark.createDataFrame(rows, kind))
    assert (report.violations, [d.split(" is")[0].split()[:3] for d in report.details]) == (2, [["user", "1:", "item"], ["user", "2:", "user"]])


def test_csv_keeps_microseconds_lists_and_nulls(spark, tmp_path):
    kind = "user_id long, at timestamp, share double, tags array<string>"
    rows = [(1, T0 + timedelta(microseconds=7), 0.1, ["a,b", 'q"']), (2, T0, None, []), (None, None, float("inf"), None)]
    data = spark.createDataFrame(rows, kind)
    export_csv(data, str(tmp_path / "csv"))
    assert sorted(map(str, import_csv(spark, str(tmp_path / "csv"), data.schema).collect())) == sorted(map(str, data.collect()))
