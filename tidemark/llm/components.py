"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregates and joins over edges; no node's neighbours are collected in one place, and neither edges nor
components come to the driver: only a count and a checksum do, to see that nothing has changed. Rounds grow as the logarithm
of a component's diameter; edges that are settled already, each node linked to its component's least, take one. Each round is
checkpointed in the shared folder. Joins are merged whatever their size: a broadcast's table is built in the driver and stays
there until that happens to collect its garbage, and there would be two in every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the larger (or smaller) neighbours of each node to the least node around it; an edge may come twice."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least.hint("merge"), "a")
    linked = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b")


def _mark(edges: DataFrame) -> Row:
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(a, b) long pairs to (node, component): the least node reachable. Nodes without an edge have no row."""
    now = checkpointed(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(now)
    for _ in range(most_rounds):
        now = checkpointed(_star(_star(now, large=True), large=False).distinct())
        mark = _mark(now)
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
