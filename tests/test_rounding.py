"""Features whose exact value lies halfway between two roundings are rounded as the SQL rounds them."""

from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_entry import plain
from tidemark.functions.features import ratio, rounded
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

#: Microseconds before the hour: so many that the days have a five as their fifth digit.
TIES = [4_320_000 + 8_640_000 * k for k in range(40)]


def table(path):
    """Purchases of a user each, and a view long after them, which moves the watermark on."""
    at = datetime(2024, 1, 8, 12)
    rows = [(i, at - timedelta(microseconds=us), i, "purchase", 2.5, '{"k": 3}') for i, us in enumerate(TIES)]
    rows += [(900, datetime(2024, 1, 12), 900, "view", 1.0, '{"k": 4}')]
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    db = duckdb.connect()
    db.execute("CREATE TABLE events AS SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, props FROM frame")
    db.execute(f"COPY events TO '{path}/events.parquet'")
    assert len(frame) == 41
    return db


@pytest.mark.parametrize("name", ["streamed_hourly_users", "user_snapshots_6h"])
def test_ties_round_as_in_sql(spark, tmp_path, name):
    db = table(tmp_path)
    assert plain(QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(db.execute(ORACLES[name]).fetchdf())


def test_rounded_is_the_databases_round(spark):
    values = [us / 86_400e6 for us in TIES] + [n / 160 for n in range(1, 400)] + [-0.00015, 0.0, 1e307, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 4)).collect()]
    assert got == [r[0] for r in duckdb.sql("SELECT round(unnest(?::DOUBLE[]), 4)", params=[values]).fetchall()]
    odd = spark.createDataFrame([(float("nan"), 3), (None, 3)], "v double, n long").select(rounded(F.col("v"), 4), ratio(F.lit(1), F.col("n") - 3, 4)).collect()
    assert odd[0][0] != odd[0][0] and odd[1][0] is None and [r[1] for r in odd] == [0.0, 0.0]
