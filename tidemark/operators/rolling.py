"""Counts over the time before each row, with no task that holds a key's whole history.

The number of events in [t - h, t) is the number before t less the number before t - h. Each of these is a number before the start of a block
of time, from a running sum over a key's blocks (a row for each block, added up before it is shuffled), and a number inside the block, from a window
over that block of that key alone. So a hot key is spread over its blocks, whatever the length of its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.features import HOUR_US


def rolling_counts(events: DataFrame, row_id: str, key: str, us: str, measures: dict[str, tuple[Column, int]], block_hours: int = 6) -> DataFrame:
    """(row_id, key, measures..): for each event the earlier ones of its key that a measure's condition holds for, in so many hours before it.

    ``us``: the time in microseconds; events at the same time don't count. ``row_id`` tells events apart. Rows without a key or a time count nothing.
    """
    width = block_hours * HOUR_US
    kinds: dict[str, Column] = {}
    names = {}
    for name, (condition, hours) in measures.items():
        kind = next((k for k, c in kinds.items() if str(c) == str(condition)), f"c{len(kinds)}")
        kinds[kind] = condition
        names[name] = (kind, hours)
    seen = events.select(F.col(row_id).alias("_id"), F.col(key).alias("_k"), F.col(us).alias("_t"), *[F.when(c, 1).otherwise(0).alias(k) for k, c in kinds.items()])
    known = seen.where("_k is not null and _t is not null")
    block = lambda t: F.floor(t / width)
    # What is asked: the numbers before each event, and before the starts of its windows.
    back = sorted({0, *(h for _, h in names.values())})
    asked = known.select("_id", "_k", F.col("_t").alias("_own"), F.explode(F.array(*[F.lit(h) for h in back])).alias("_h")).withColumn("_t", F.col("_own") - F.col("_h").cast("long") * HOUR_US)
    asked = asked.select("_id", "_k", "_t", "_h", block(F.col("_t")).alias("_b"))
    given = known.select("_k", "_t", block(F.col("_t")).alias("_b"), *kinds)
    inside = Window.partitionBy("_k", "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    both = given.unionByName(asked, allowMissingColumns=True)
    within = both.select("_id", "_k", "_b", "_h", *[F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(k) for k in kinds]).where("_h is not null")
    # The numbers before each block, for blocks that are asked for as well.
    sums = both.groupBy("_k", "_b").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(f"before_{k}") for k in kinds])
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_k", "_b", *[F.coalesce(F.sum(f"before_{k}").over(earlier), F.lit(0)).alias(f"before_{k}") for k in kinds])
    met = within.join(before, ["_k", "_b"])
    number = lambda kind, h: F.sum(F.when(F.col("_h") == h, F.col(kind) + F.col(f"before_{kind}")))
    counted = met.groupBy("_id").agg(F.first("_k").alias("_k"), *[(number(kind, 0) - number(kind, h)).cast("long").alias(name) for name, (kind, h) in names.items()])
    out = counted.unionByName(seen.where("_k is null or _t is null").select("_id", "_k", *[F.lit(0).cast("long").alias(n) for n in names]))
    return out.select(F.col("_id").alias(row_id), F.col("_k").alias(key), *names)
