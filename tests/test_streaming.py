"""A stream of files gives what batch gives over the same events."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators.features import features_as_of
from tidemark.operators.offline_store import read_snapshots
from tidemark.operators.online_table import OnlineTable
from tidemark.plans import queries
from tidemark.schema import EVENT
from tidemark.sources import events as source
from tidemark.sources import generator
from tidemark.streaming import pipeline
from tidemark.streaming.metrics import Histogram, Progress, Served, measured, observed

T0 = datetime(2024, 6, 1, tzinfo=timezone.utc)


def test_parse(spark):
    good = {"event_id": "a", "user_id": 1, "event_type": "item_view", "item_id": 5, "timestamp": "2024-06-01T00:00:00", "session_id": "s", "metadata": {"price": 2.5}}
    bad = [dict(good, event_type="dance"), {k: v for k, v in good.items() if k != "user_id"}, dict(good, timestamp="soon")]
    lines = [json.dumps(good), json.dumps({k: v for k, v in good.items() if k not in ("item_id", "metadata")})] + [json.dumps(b) for b in bad] + [json.dumps(good)[:30]]
    events, dead = source.parse_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r["item_id"], r["metadata"] and r["metadata"]["price"]) for r in events.collect()] == [(5, 2.5), (None, None)]
    assert sorted(r["reason"] for r in dead.collect()) == ["no ts", "no user_id", "not an event", "unknown event_type"]


def test_stream_equals_batch(spark, tmp_path):
    made = generator.historical(spark, 400, T0, span_hours=30, n_users=20, n_items=40).persist()
    messages = [r["value"] for r in source.to_messages(made).collect()]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("\n".join(messages[:250] + messages[:20] + ["{broken"]))
    (tmp_path / "in/b.txt").write_text("\n".join(messages[250:]))
    paths = pipeline.Paths(str(tmp_path / "out"))
    listener = Progress()
    spark.streams.addListener(listener)
    for q in pipeline.start(source.json_stream(spark, str(tmp_path / "in")), paths):
        q.awaitTermination()
    spark.streams.removeListener(listener)
    ref = made.agg(F.max("ts")).first()[0] + timedelta(microseconds=1)
    for entity in ("user", "item"):
        batch = features_as_of(made, entity, ref)
        stored = read_snapshots(spark, paths.offline, entity).select(batch.columns)
        assert sorted(map(str, stored.collect())) == sorted(map(str, batch.collect()))
    assert spark.read.json(paths.dead).count() == 1
    online = pipeline.read_online(spark, paths)
    assert online.where("entity = 'user'").select("entity_id").distinct().count() == features_as_of(made, "user", ref).count()
    # The same batch again changes nothing.
    before = online.count()
    pipeline.process_batch(spark, made.limit(0), 0, paths)
    assert pipeline.read_online(spark, paths).count() == before
    assert "stream_events_total" in listener.as_text() and 'stream_batch_latency_ms_bucket{le="+Inf"}' in listener.as_text()


def test_batches_read_their_history_only(spark, tmp_path):
    """Three batches over three weeks: the third sees its last seven days, whatever lies before, and lists no other folder."""
    paths = pipeline.Paths(str(tmp_path))
    made = [generator.batch(spark, 60, T0 + timedelta(days=10 * k), 0.001, seed=k, n_users=5, n_items=20).persist() for k in range(3)]
    for k, rows in enumerate(made):
        pipeline.process_batch(spark, rows, k, paths)
    ref = made[2].agg(F.max("ts")).first()[0] + timedelta(microseconds=1)
    start = ref - timedelta(hours=pipeline.history_hours(pipeline.default_catalog()))
    every = made[0].unionByName(made[1]).unionByName(made[2])
    expected = features_as_of(every.where((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(ref))), "user", ref)
    stored = read_snapshots(spark, paths.offline, "user").where(F.col("feature_timestamp") == F.lit(ref)).select(expected.columns)
    assert sorted(map(str, stored.collect())) == sorted(map(str, expected.collect()))
    log = pipeline.read_log(spark, paths, start, ref)
    assert log.count() == 60 and all("date=2024-06-2" in f for f in log.inputFiles())


def test_touched_entities_without_recent_events_have_features(spark, tmp_path):
    """A batch over twelve days: its user and item of the first day have features of nothing; another item's views count for popularity."""
    at = lambda days: T0 + timedelta(days=days)
    rows = [("a", 1, "purchase", 7, at(0), "s", None), ("b", 2, "item_view", 8, at(12), "t", None), ("c", 2, "item_view", 8, at(12), "t", None)]
    paths, held = pipeline.Paths(str(tmp_path)), set(spark.sparkContext._jsc.getPersistentRDDs())
    pipeline.process_batch(spark, spark.createDataFrame(rows, EVENT), 0, paths)
    pipeline.process_batch(spark, spark.createDataFrame([("d", 1, "item_view", 9, at(12) + timedelta(minutes=1), "u", None)], EVENT), 1, paths)
    users = {(r["user_id"], r["feature_timestamp"].minute): r for r in read_snapshots(spark, paths.offline, "user").collect()}
    assert set(users) == {(1, 0), (2, 0), (1, 1)}
    assert (users[1, 0]["purchase_count_24h"], users[1, 0]["days_since_last_purchase"], users[1, 0]["category_affinity"]) == (0, float("inf"), [])
    items = {r["item_id"]: r for r in read_snapshots(spark, paths.offline, "item").collect()}
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= held
    assert {i: (r["view_count_1h"], r["popularity_rank_1h"]) for i, r in items.items()} == {7: (0, 0.0), 8: (2, 1.0), 9: (1, 0.5)}


ONLINE = "entity string, entity_id long, feature_name string, value_json string, written_at timestamp, expires_at timestamp"


def test_online_store_keeps_every_key(spark, tmp_path):
    """Sixty batches, every second one empty, some of them twice, against a dictionary."""
    table, expected, merges = OnlineTable(spark, str(tmp_path), buckets=4, merge_every=3), {}, 0
    assert table.read().count() == 0
    for k in range(60):
        ids = [] if k % 2 else [k % 5, 100 + k]
        rows = [("user", i, "f", str(k), T0 + timedelta(hours=k), T0 + timedelta(hours=k + 1)) for i in ids]
        expected |= {r[1]: r[3] for r in rows}
        for _ in range(1 + (k % 4 == 2)):
            table.upsert(spark.createDataFrame(rows, ONLINE), k)
        merges += (tmp_path / f"data/base={k}").exists()
        if k % 20 == 10:
            assert {r["entity_id"]: r["value_json"] for r in table.read().collect()} == expected
    assert {r["entity_id"]: r["value_json"] for r in table.read().collect()} == expected and merges > 3
    assert {r["value_json"] for r in table.read(upto=20).collect()} == set() and len(list((tmp_path / "manifest").glob("*.json"))) == 4
    assert max(len(x) for x in table.manifest(58).values()) <= 4
    found = table.of_keys(spark.createDataFrame([("user", 4, "f"), ("user", 158, "f"), ("user", 9, "f")], "entity string, entity_id long, feature_name string"))
    assert {r["entity_id"]: r["value_json"] for r in found.collect()} == {4: expected[4], 158: expected[158]}


def test_a_merge_rewrites_touched_buckets_only(spark, tmp_path):
    table = OnlineTable(spark, str(tmp_path), buckets=32, merge_every=1)
    many = spark.range(20_000).select(F.lit("user").alias("entity"), F.col("id").alias("entity_id"), F.lit("f").alias("feature_name"), F.lit("0").alias("value_json"), F.lit(T0).alias("written_at"), F.lit(T0).alias("expires_at"))
    table.upsert(many, 0)
    for k, ids in ((1, [5]), (2, [5, 6, 7])):
        table.upsert(spark.createDataFrame([("user", i, "f", str(k), T0 + timedelta(hours=k), T0) for i in ids], ONLINE), k)
    whole, one = (sum(p.stat().st_size for p in (tmp_path / d).rglob("*.parquet")) for d in ("data/batch=0", "data/base=1"))
    assert one < whole / 16
    assert len(list((tmp_path / "data/base=2").glob("bucket=*"))) <= 3
    assert table.read().count() == 20_000 and {r["value_json"] for r in table.read().where("entity_id in (5, 6, 7)").collect()} == {"2"}


def test_a_batch_is_in_both_stores_or_in_none(spark, tmp_path, monkeypatch):
    paths = pipeline.Paths(str(tmp_path))
    made = [generator.batch(spark, 40, T0 + timedelta(hours=k), 1, seed=k, n_users=5, n_items=8).persist() for k in range(2)]
    assert pipeline.read_online(spark, paths).count() == 0
    pipeline.process_batch(spark, made[0], 0, paths)
    seen = lambda: (pipeline.read_offline(spark, paths, "user").count(), pipeline.read_offline(spark, paths, "item").count(), sorted(map(str, pipeline.read_online(spark, paths).collect())))
    before = seen()
    for broken in ("upsert", "commit"):
        with monkeypatch.context() as m:
            target = OnlineTable if broken == "upsert" else pipeline
            m.setattr(target, broken, lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                pipeline.process_batch(spark, made[1], 1, paths)
        assert seen() == before
    pipeline.process_batch(spark, made[1], 1, paths)
    after = seen()
    assert after[0] > before[0] and after != before
    pipeline.process_batch(spark, made[1], 1, paths)
    assert seen() == after


def test_a_row_that_cannot_be_used_is_set_aside(spark, tmp_path):
    paths, meta = pipeline.Paths(str(tmp_path)), (1.0, "c", 1, float("nan"), None, None, None, None)
    rows = [("a", 1, "purchase", 7, T0, "s", meta), ("b", 2, "item_view", 8, T0, "t", None), ("c", 3, "purchase", 8, T0, "t", (1.0, "c", 1, 4.0, None, None, None, None))]
    pipeline.process_batch(spark, spark.createDataFrame(rows, EVENT), 0, paths)
    assert {r["user_id"]: r["total_spend_24h"] for r in pipeline.read_offline(spark, paths, "user").collect()} == {2: 0.0, 3: 4.0}
    assert {(r["entity"], r["entity_id"], r["reason"]) for r in pipeline.read_rejected(spark, paths).collect()} == {("user", 1, "total_spend_24h is not finite"), ("item", 7, "revenue_24h is not finite")}
    assert {r["entity_id"] for r in pipeline.read_online(spark, paths).where("entity = 'user'").collect()} == {2, 3}


def test_sketches_and_misses_are_added_over_batches(spark):
    heard = Served()
    for k in range(3):
        rows = [(i, None if i % 4 == k else "x", None, float(i * 3 + k)) for i in range(200)]
        found = measured(spark.createDataFrame(rows, "id long, f string, g string, ms double"), ["f", "g"], "ms", name=f"n{k}")
        found.write.format("noop").mode("overwrite").save()
        values = found.agg(F.count("*").alias("rows"), F.count_if(F.col("f").isNull()).alias("miss_f"), F.count_if(F.col("g").isNull()).alias("miss_g"), F.kll_sketch_agg_double("ms").alias("took")).first().asDict()
        heard.add(values)
    assert (heard.rows, dict(heard.misses)) == (600, {"f": 150, "g": 600})
    assert all(abs(q / 600 - p) < 0.02 for q, p in zip(heard.quantiles(spark, [0.1, 0.5, 0.9]), (0.1, 0.5, 0.9), strict=True))
    assert 'served_miss_total{feature="g"} 600' in heard.as_text()


def test_live_batches_are_the_generators(spark, tmp_path):
    for _ in range(3):
        made = generator.live(spark, 50, T0, 10, n_users=5, n_items=20)
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.schema(EVENT).parquet(str(tmp_path / "out"))
    assert sorted(map(str, stored.collect())) == sorted(map(str, generator.batch(spark, 150, T0, 10, n_users=5, n_items=20).collect()))


def test_lookups_are_observed(spark):
    found, watch = observed(spark.createDataFrame([(1, "a", None), (2, None, None)], "id long, f string, g string"), ["f", "g"])
    assert found.count() == 2 and watch.get == {"rows": 2, "values": 4, "misses": 3}
    h = Histogram("ms", (1, 10))
    for x in (0.5, 1, 5, 50):
        h.add(x)
    assert h.as_text().split("\n") == ['ms_bucket{le="1"} 2', 'ms_bucket{le="10"} 3', 'ms_bucket{le="+Inf"} 4', "ms_sum 56.5", "ms_count 4", ""]


def test_generator_is_seeded(spark):
    a = generator.batch(spark, 300, T0, 10)
    b = generator.batch(spark, 300, T0, 10).repartition(3)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    rows = a.collect()
    assert rows[10]["ts"] - rows[0]["ts"] == timedelta(seconds=1)
    for r in rows:
        m = r["metadata"]
        assert (r["item_id"] is None) == (r["event_type"] in ("page_view", "search"))
        assert r["event_type"] != "purchase" or abs(m["total_amount"] - m["price"] * m["quantity"]) < 0.006
        assert r["event_type"] != "rating" or 1 <= m["rating"] <= 5
    assert source.deduplicated(a.unionByName(a)).count() == 300


def test_live_stream_has_a_plan(spark):
    assert generator.stream(spark).isStreaming
    assert pipeline.sliding_counts(generator.stream(spark)).isStreaming


def test_a_stream_is_run_once_for_a_batch(spark, tmp_path, monkeypatch):
    """Features are made from the log: a plan that holds the batch itself would run its parsing and its state again in each branch."""
    (tmp_path / "in").mkdir()
    made = generator.historical(spark, 60, T0, span_hours=3, n_users=5, n_items=8)
    (tmp_path / "in/a.txt").write_text("\n".join(r["value"] for r in source.to_messages(made).collect()))
    plans = []
    monkeypatch.setattr(pipeline, "features_as_of", lambda events, *rest: plans.append(events._jdf.queryExecution().executedPlan().toString()) or features_as_of(events, *rest))
    paths = pipeline.Paths(str(tmp_path / "out"))
    for q in pipeline.start(source.json_stream(spark, str(tmp_path / "in")), paths):
        q.awaitTermination()
    assert len(plans) == 2 and not any("ExistingRDD" in p for p in plans)
    # Few keys are sent to the events.
    assert not any("SortMergeJoin" in p for p in plans)


def test_a_message_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"user_id": 1}\n\nnull\n[]\n')
    events, dead = source.parse_events(source.read_json(spark, str(tmp_path)))
    for frame in (events, dead):
        assert frame._jdf.queryExecution().executedPlan().toString().replace("DataFilters", "").count("from_json(") == 1
    assert events.count() == 0 and sorted((r["raw"], r["reason"]) for r in dead.collect()) == [("", "not an event"), ("[]", "not an event"), ("null", "not an event"), ('{"user_id": 1}', "no event_id")]


def test_a_batch_is_not_held(spark, tmp_path, monkeypatch):
    """One run writes a batch to the log and tells its last event: the batch isn't kept in memory beside the stream's state."""
    made, held = generator.batch(spark, 40, T0, 1, n_users=5, n_items=8), []
    persist = type(made).persist
    monkeypatch.setattr(type(made), "persist", lambda df, *how: held.append(df) or persist(df, *how))
    paths = pipeline.Paths(str(tmp_path))
    pipeline.process_batch(spark, made, 0, paths)
    assert held and all(df is not made for df in held)
    assert {r["feature_timestamp"] for r in pipeline.read_offline(spark, paths, "user").collect()} == {made.agg(F.max("ts")).first()[0] + timedelta(microseconds=1)}


def test_messages_are_not_sorted_by_part(spark, monkeypatch):
    """A task writes its messages as they come, to one file for each part, rather than sort all of them first."""
    monkeypatch.setattr(pipeline, "start", lambda *a: ())
    made, writers = generator.batch(spark, 60, datetime(2024, 1, 10, 23, 59, 50, tzinfo=timezone.utc), 2, n_users=5, n_items=8), spark.conf.get(queries.WRITERS)
    paths = queries.streamed(spark, "", made.withColumn("event_id", F.unix_seconds("ts").cast("string")))
    spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    done = spark._jsparkSession.sharedState().statusStore().executionsList()
    written = [p for p in (done.apply(i).physicalPlanDescription() for i in range(done.size())) if paths.ahead in p]
    assert written and not any("Sort" in p for p in written)
    stored = spark.read.text(paths.messages).groupBy("part").count().collect()
    assert {r["part"] for r in stored} == {0, 1} and sum(r["count"] for r in stored) == 60 + made.where(F.unix_seconds("ts") % 3 == 0).count()
    assert spark.conf.get(queries.WRITERS) == writers


def test_an_item_is_looked_up_once(spark):
    """The table's JSON text is read once for an event, however many of its columns are made of it, and filters on them don't read it again."""
    table = spark.createDataFrame([(1, datetime(2024, 1, 1), 2, "view", 1.5, '{"k": 13}'), (2, datetime(2024, 1, 1), 2, "error", 1.5, "{}"), (3, datetime(2024, 1, 1), 2, "signup", None, '{"k": 4}')], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    made = source.events_from_table(table)
    assert [(r["item_id"], r["metadata"]["category"], r["metadata"]["rating"]) for r in made.orderBy("event_id").collect()] == [(13, "cat3", None), (None, None, None), (None, None, None)]
    assert source.to_messages(made)._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == 1
