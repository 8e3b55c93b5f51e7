"""Hot keys are spread: rolling windows and as-of joins over keys that hold most of the rows."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.features import HOUR_US, micros
from tidemark.operators.asof import asof_join
from tidemark.operators.rolling import rolling_counts

T0 = datetime(2024, 6, 1, tzinfo=timezone.utc)


def rows_of(n=3000, seed=1):
    """Nine of ten rows are of one user; some without a user or a time, some at one time."""
    draw = random.Random(seed)
    return [(i, 1 if draw.random() < 0.9 else draw.choice([2, 3, None]), draw.choice("ab"), None if draw.random() < 0.01 else T0 + timedelta(minutes=draw.randint(0, 15_000) // 7 * 7)) for i in range(n)]


def rows_in_windows(df):
    """The most rows that one group of a window has, by the plan's own partitioning: distinct keys of the windows."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_rolling_counts(spark):
    rows = rows_of()
    frame = spark.createDataFrame(rows, "id long, user long, kind string, at timestamp").withColumn("us", micros(F.col("at")))
    is_kind = lambda k: F.col("kind") == k
    wanted = {"a_1h": (is_kind("a"), 1), "a_24h": (is_kind("a"), 24), "b_100h": (is_kind("b"), 100)}
    found = {r["id"]: tuple(r)[1:] for r in rolling_counts(frame, "id", "user", "us", wanted).collect()}
    by_user = {}
    for i, u, k, at in rows:
        by_user.setdefault(u, []).append((at, k))

    def plainly(u, at, kind, hours):
        return 0 if u is None or at is None else sum(k == kind and t is not None and at - timedelta(hours=hours) <= t < at for t, k in by_user[u])

    assert found == {i: (u, plainly(u, at, "a", 1), plainly(u, at, "a", 24), plainly(u, at, "b", 100)) for i, u, _, at in rows}
    # Windows are over a block of six hours of a user, or over a user's blocks, never over a user's rows.
    plan = rows_in_windows(rolling_counts(frame, "id", "user", "us", wanted))
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert windows and all("[_k#" in w for w in windows)
    assert sum("_b#" in w.split("windowspecdefinition(")[1].split(" ASC")[0] for w in windows) >= 1
    known = frame.where("user = 1 and us is not null")
    largest = known.groupBy(F.floor(F.col("us") / (6 * HOUR_US))).count().agg(F.max("count")).first()[0]
    assert largest < known.count() / 20
    assert rolling_counts(frame.limit(0), "id", "user", "us", wanted).count() == 0


def test_asof_without_tolerance_on_a_hot_key(spark):
    draw = random.Random(5)
    day = lambda: T0 + timedelta(hours=draw.randint(0, 60 * 24))
    left = [(i, 1 if draw.random() < 0.9 else draw.choice([2, None]), day()) for i in range(1500)]
    right = [(1 if draw.random() < 0.9 else 2, day(), i) for i in range(60)] + [(2, T0 - timedelta(days=400), -1), (None, T0, -2)]
    lf = spark.createDataFrame(left, T.StructType([T.StructField("id", T.LongType()), T.StructField("k", T.LongType()), T.StructField("at", T.TimestampType())]))
    rt = spark.createDataFrame(right, "k long, seen timestamp, v long")
    of = lambda strategy: sorted(map(str, asof_join(lf, rt, "k", "at", "seen", ["v"], tolerance_days=None, strategy=strategy, order=("v",)).collect()))
    found = of("union")
    assert found == of("range") and len(found) == len(left)
    expected = {}
    for i, k, at in left:
        fits = [(t, v) for rk, t, v in right if rk is not None and rk == k and t < at]
        expected[i] = max(fits)[1] if fits else None
    got = asof_join(lf, rt, "k", "at", "seen", ["v"], tolerance_days=None, order=("v",)).collect()
    assert {r["id"]: r["v"] for r in got} == expected
    plan = asof_join(lf, rt, "k", "at", "seen", ["v"], tolerance_days=None)._jdf.queryExecution().executedPlan().toString()
    # The window over rows is by key and day; the one by key alone is over a row for each day.
    over = [line.split("windowspecdefinition(")[1] for line in plan.splitlines() if "Window " in line]
    assert any("_b#" in w.split(" ASC")[0] for w in over) and len(over) == 2
