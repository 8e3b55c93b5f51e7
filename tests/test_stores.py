"""Offline and online stores, and whether they agree."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import consistency, offline_store, online_store

T0 = datetime(2024, 8, 1, 12, tzinfo=timezone.utc)
HOUR = timedelta(hours=1)


def test_offline_round_trip(spark, tmp_path):
    kind = "user_id long, feature_timestamp timestamp, n long, tags array<string>"
    rows = [(1, T0 - 48 * HOUR, 1, ["a"]), (1, T0 - 24 * HOUR, 2, []), (1, T0, 3, None), (2, T0, 4, ["b", "c"])]
    offline_store.write_snapshots(spark.createDataFrame(rows, kind), str(tmp_path), "user", 1)
    offline_store.write_snapshots(spark.createDataFrame(rows, kind), str(tmp_path), "user", 1)
    offline_store.write_snapshots(spark.createDataFrame([(1, T0 + HOUR, 9.5)], "user_id long, feature_timestamp timestamp, extra double"), str(tmp_path), "user", 2)
    stored = offline_store.read_snapshots(spark, str(tmp_path), "user")
    assert stored.count() == 5
    assert [r["n"] for r in offline_store.history(stored, "user", 1, T0 - 48 * HOUR, T0).collect()] == [1, 2]
    assert offline_store.history(stored, "user", 77, T0 - 48 * HOUR, T0).count() == 0
    last = {r["user_id"]: r for r in offline_store.latest_as_of(stored, "user", T0 + 2 * HOUR).collect()}
    assert (last[1]["n"], last[1]["extra"], last[2]["tags"]) == (None, 9.5, ["b", "c"])
    by_column = {r["user_id"]: r for r in offline_store.latest_as_of(stored, "user", T0 + 2 * HOUR, by_column=True).collect()}
    assert (by_column[1]["n"], by_column[1]["tags"], by_column[1]["extra"]) == (3, [], 9.5)
    assert {r["n"] for r in offline_store.latest_as_of(stored, "user", T0).collect()} == {2}
    plan = offline_store.history(stored, "user", 1, T0 - HOUR, T0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    offline_store.compact(spark, str(tmp_path), "user", str(tmp_path / "compact"))
    assert offline_store.read_snapshots(spark, str(tmp_path / "compact"), "user").count() == 5
    assert offline_store.from_json_lists(spark.createDataFrame([('["x","y"]',)], "t string"), ["t"]).first()["t"] == ["x", "y"]


def test_damaged_files_are_left_out(spark, tmp_path):
    rows = [(i, T0 + i * HOUR, i) for i in range(40)]
    frame = spark.createDataFrame(rows, "user_id long, feature_timestamp timestamp, n long")
    for k in (0, 1):
        offline_store.write_snapshots(frame.where(f"n % 2 = {k}"), str(tmp_path), "user", k)
    files = sorted(tmp_path.glob("entity=user/date=*/batch=0/*.parquet"))
    assert len(files) == 3  # one for each date
    files[0].write_bytes(b"no longer a file")
    (files[0].parent / f".{files[0].name}.crc").unlink()
    found = offline_store.read_snapshots(spark, str(tmp_path), "user", tolerant=True)
    assert 20 <= found.count() < 40
    with pytest.raises(Exception, match="."):
        offline_store.read_snapshots(spark, str(tmp_path), "user").count()


def decoded(df):
    """Rows that the scan of a plan puts out when it runs."""
    run = df._jdf.queryExecution()
    df._jdf.collectToPython()
    found, stack = 0, [run.executedPlan()]
    while stack:
        node = stack.pop()
        name, children = node.nodeName(), node.children()
        stack += [children.apply(i) for i in range(children.size())]
        if name == "AdaptiveSparkPlan":
            stack.append(node.executedPlan())
        elif "QueryStage" in name:
            stack.append(node.plan())
        elif "Scan parquet" in name:
            found += node.metrics().apply("numOutputRows").value()
    return found


def test_one_entity_is_read_by_its_blocks(spark, tmp_path):
    """What is decoded for one entity doesn't grow with the entities: ten times as many, as many rows."""
    seen = {}
    for n in (4_000, 40_000):
        ids = spark.range(n).select(F.col("id").alias("user_id"), F.explode(F.array(*[F.lit(T0 + k * HOUR) for k in range(3)])).alias("feature_timestamp"), F.rand(1).alias("v"))
        blocks = {"parquet.block.size": "16384", "parquet.page.size": "4096", "parquet.block.size.row.check.min": "10", "parquet.page.size.row.check.min": "10"}
        offline_store.write_snapshots(ids, str(tmp_path / str(n)), "user", 1, **blocks)
        found = offline_store.history(offline_store.read_snapshots(spark, str(tmp_path / str(n)), "user"), "user", 1234, T0 - HOUR, T0 + 9 * HOUR)
        assert found.count() == 3
        seen[n] = decoded(found)
    assert 3 <= seen[40_000] <= 2 * seen[4_000] and seen[40_000] < 40_000 / 10


@pytest.fixture
def online(spark):
    wide = spark.createDataFrame([(1, T0, 3, 2.5, ["a", "b"], "x\"y", float("inf"), None)], "user_id long, feature_timestamp timestamp, purchase_count_1h long, total_spend_24h double, category_affinity array<string>, note string, far double, gone long")
    items = spark.createDataFrame([(1, T0, 8)], "item_id long, feature_timestamp timestamp, view_count_1h long")
    at = F.col("feature_timestamp")
    return online_store.to_online(wide, "user", at).unionByName(online_store.to_online(items, "item", at))


def test_online_values(spark, online):
    found = {(r["entity"], r["feature_name"]): r["value_json"] for r in online.collect()}
    assert found == {("user", "purchase_count_1h"): "3", ("user", "total_spend_24h"): "2.5", ("user", "category_affinity"): '["a","b"]', ("user", "note"): '"x\\"y"', ("user", "far"): None, ("user", "gone"): None, ("item", "view_count_1h"): "8"}


def test_ttl_delete_and_overwrite(spark, online):
    assert {r["feature_name"] for r in online_store.visible(online, T0 + HOUR).where("entity = 'user'").collect()} == {"total_spend_24h", "category_affinity", "note", "far", "gone"}
    assert online_store.visible(online, T0 + HOUR / 2).where("feature_name = 'purchase_count_1h'").first()["ttl_seconds"] == 1800
    later = online.withColumns({"written_at": F.col("written_at") + F.expr("interval 1 hour"), "value_json": F.lit("7")})
    assert {r["value_json"] for r in online_store.merged(online, later).collect()} == {"7"}
    left = online_store.deleted(online, "user", spark.createDataFrame([(1,)], "entity_id long"))
    assert [r["entity"] for r in left.collect()] == ["item"]


def test_lookups(spark, online):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (5, 1)], "user_id long, item_id long")
    found = {(r["user_id"], r["item_id"]): r for r in online_store.vector(online, pairs, ["purchase_count_1h"], ["view_count_1h"]).collect()}
    assert (found[1, 1]["user_purchase_count_1h"], found[1, 1]["item_view_count_1h"], found[1, 1]["missing"]) == ("3", "8", [])
    assert found[1, 2]["missing"] == ["item_view_count_1h"] and found[5, 1]["missing"] == ["user_purchase_count_1h"]
    asked = spark.createDataFrame([(0, "user", 1, ["purchase_count_1h", "nothing"]), (1, "user", 1, ["purchase_count_1h"]), (2, "item", 9, ["view_count_1h"])], "pos long, entity string, entity_id long, names array<string>")
    assert [r["features"] for r in online_store.batch(online, asked).orderBy("pos").collect()] == [{"purchase_count_1h": "3", "nothing": None}, {"purchase_count_1h": "3"}, {"view_count_1h": None}]
    with pytest.raises(ValueError):
        online_store.lookup(online, "shop", pairs, [])


def _sides(spark, values, kind="double"):
    on = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(values)], f"user_id long, f {kind}")
    off = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(values)], f"user_id long, f {kind}")
    return on, off


def test_consistency(spark):
    stats = lambda values, kind="double": consistency.compare(*_sides(spark, values, kind), "user_id", ["f", "g"]).first()
    inf = float("inf")
    row = stats([(100.0, 1.0)] * 8 + [(1.0, 1.0)] * 2)
    assert (row["n_compared"], row["n_inconsistent"], row["inconsistency_rate"], row["max_relative_diff"], row["flagged"]) == (10, 8, 0.8, 99.0, True)
    assert not stats([(1.001, 1.0)] * 4 + [(1.0, 1.0)] * 16)["flagged"]
    assert stats([(2.0, 1.0)] + [(1.0, 1.0)] * 19)["flagged"] is False  # a rate of exactly 5 % is let pass
    assert stats([(inf, inf), (None, 1.0), (float("nan"), 1.0)])["n_compared"] == 1
    assert stats([(inf, 1.0)])["n_inconsistent"] == 1
    same = stats([(["a"], ["a"]), (["a", "b"], ["b", "a"])], "array<string>")
    assert (same["n_compared"], same["n_inconsistent"]) == (2, 1)


def test_consistency_report(spark):
    on, off = _sides(spark, [(100.0, 1.0)] * 3)
    ids = spark.createDataFrame([(0,), (1,), (1,), (44,)], "user_id long")
    report = consistency.check(on, off, "user", ["f"], ids)
    assert (report.total_checked, report.passed, report.inconsistent_features, report.per_feature_stats[0]["n_compared"]) == (4, False, ["f"], 3)
    assert report.summary().startswith("[FAIL]")
    assert consistency.check(on, off, "user", [], ids).passed
    with pytest.raises(ValueError):
        consistency.check(on, off, "shop", ["f"], ids)
