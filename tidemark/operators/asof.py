"""As-of joins: to each left row the latest right row of its key that is strictly earlier and not too old.

``union``: both sides in one sorted window, linear in their rows. With a tolerance, keys are also cut into blocks of that length,
a right row goes to its own and the next block, and no partition holds more than two blocks of one key: a hot key is spread
over time. Without one, a block of a day looks at itself first, and then takes what the blocks before it ended with: a key's blocks, a
row for each, are scanned a second time, not its rows. ``range``: an equi and range join with max_by, good for few right rows a key. ``grid``: for right rows on a complete
regular grid, the one time that can match is computed and joined by equality.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.features import DAY_US, HOUR_US, micros


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, columns: list[str], how: str = "left", tolerance_days: int | None = 30, strategy: str = "union", order: tuple[str, ...] = (), grid: tuple[object, object, int] | None = None) -> DataFrame:
    """``left`` with ``columns`` and ``right_ts`` of the matching right row, null where there is none (or dropped, if ``how`` is inner).

    ``order`` breaks ties of right rows with one time: the last wins. ``grid`` is (start, end, hours) for that strategy.
    """
    joiner: dict[str, Callable[..., DataFrame]] = {"union": _union, "range": _range, "grid": _grid}
    if strategy not in joiner:
        raise ValueError(f"strategy {strategy!r} is none of {', '.join(joiner)}")
    payload = F.struct(F.col(right_ts), *[F.col(c) for c in columns])
    slim = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).select(F.col(key).alias("_k"), micros(F.col(right_ts)).alias("_t"), F.struct(*[F.col(c) for c in (*order, *columns)]).alias("_o"), payload.alias("_p"))
    out = joiner[strategy](left.withColumn("_l", micros(F.col(left_ts))), slim, key, tolerance_days, grid)
    if how == "inner":
        out = out.where("_p is not null")
    return out.select(*left.columns, F.col(f"_p.{right_ts}").alias(right_ts), *[F.col(f"_p.{c}").alias(c) for c in columns])


def _fits(left_us: Column, right_us: Column, tolerance_days: int | None) -> Column:
    before = right_us < left_us
    return before if tolerance_days is None else before & (right_us >= left_us - tolerance_days * DAY_US)


def _union(left: DataFrame, right: DataFrame, key: str, tolerance_days: int | None, grid: object) -> DataFrame:
    width = DAY_US if tolerance_days is None else max(1, tolerance_days) * DAY_US
    block = lambda us: F.floor(us / width)
    # Left rows without a key match nothing; they are spread by their time instead of meeting in one partition.
    own = F.when(F.col(key).isNull(), F.xxhash64("_l")).otherwise(block(F.col("_l")))
    a = left.select(F.col(key).alias("_k"), F.col("_l").alias("_t"), own.alias("_b"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_row"))
    blocks = F.array(block(F.col("_t"))) if tolerance_days is None else F.array(block(F.col("_t")), block(F.col("_t")) + 1)
    b = right.select("_k", "_t", F.explode(blocks).alias("_b"), F.lit(1).alias("_side"), "_o", "_p")
    # At one time left comes first, so an equal right row is never seen: strictly earlier.
    both = a.unionByName(b, allowMissingColumns=True)
    before = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(F.col("_side") == 1, F.struct("_t", "_p")), ignorenulls=True).over(before)
    seen = both.withColumn("_f", found).where("_side = 0")
    if tolerance_days is None:
        # Blocks of either side, with their last right row; then what was last before each block.
        ends = both.where("_k is not null").groupBy("_k", "_b").agg(F.max_by(F.struct("_t", "_p"), F.when(F.col("_side") == 1, F.struct("_t", "_o"))).alias("_end"))
        earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(F.col("_k").alias("_ck"), F.col("_b").alias("_cb"), F.last("_end", ignorenulls=True).over(earlier).alias("_c"))
        seen = seen.join(carried, (F.col("_k") == F.col("_ck")) & (F.col("_b") == F.col("_cb")), "left").withColumn("_f", F.coalesce("_f", "_c"))
    return seen.select("_row.*", F.when(_fits(F.col("_t"), F.col("_f._t"), tolerance_days), F.col("_f._p")).alias("_p"))


def _range(left: DataFrame, right: DataFrame, key: str, tolerance_days: int | None, grid: object) -> DataFrame:
    # The match depends on key and time alone, so these stand for the rows; no row number has to survive a task that runs again.
    points = left.select(F.col(key).alias("_k"), "_l").where("_k is not null").distinct()
    met = points.join(right, "_k").where(_fits(F.col("_l"), F.col("_t"), tolerance_days))
    best = met.groupBy("_k", "_l").agg(F.max_by("_p", F.struct("_t", "_o")).alias("_p")).withColumnRenamed("_l", "_at")
    return left.join(best, (F.col(key) == F.col("_k")) & (F.col("_l") == F.col("_at")), "left").drop("_k", "_at")


def _grid(left: DataFrame, right: DataFrame, key: str, tolerance_days: int | None, grid: tuple[object, object, int] | None) -> DataFrame:
    if grid is None:
        raise ValueError("the grid strategy needs the grid's start, end and hours")
    start_us, end_us = (F.unix_micros(F.lit(x).cast("timestamp")) for x in grid[:2])
    step = grid[2] * HOUR_US
    before = F.ceil((F.col("_l") - start_us) / step) - 1
    at = start_us + F.least(before, F.floor((end_us - start_us) / step)).cast("long") * step
    met = left.withColumn("_at", at).join(right.select("_k", "_t", "_p"), (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_t")), "left")
    return met.withColumn("_p", F.when(_fits(F.col("_l"), F.col("_t"), tolerance_days), F.col("_p")))
