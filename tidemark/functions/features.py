"""Column builders: windows before a reference time, and what an event adds to a feature."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def in_window(ts_us: Column, ref_us: Column, hours: int | None) -> Column:
    """ref - hours <= ts < ref; all time before ref without hours."""
    before = ts_us < ref_us
    return before if hours is None else (ts_us >= ref_us - hours * HOUR_US) & before


def amount() -> Column:
    return F.coalesce(F.col("metadata.total_amount"), F.col("metadata.price"), F.lit(0.0))


@dataclass(frozen=True)
class Measure:
    """What is added up over a window: ``kind`` of the events of a type.

    count: events; amount: money; rating_sum and rating_n: ratings given; last: time of the last event, in microseconds;
    session_us and session_n: length and number of sessions of two events or more; categories: the most frequent, as an array.
    """

    kind: str
    event_type: str | None = None
    hours: int | None = None

    @property
    def name(self) -> str:
        return "_".join(str(x) for x in (self.kind, self.event_type, f"{self.hours}h" if self.hours else None) if x)

    @property
    def plain(self) -> bool:
        """Added up from single events, without a second grouping."""
        return self.kind not in ("session_us", "session_n", "categories")

    def of_event(self) -> Column:
        """What one event adds, null if nothing."""
        own = F.col("event_type") == self.event_type
        rated = own & F.col("metadata.rating").isNotNull()
        return {
            "count": lambda: F.when(own, F.lit(1)),
            "amount": lambda: F.when(own, amount()),
            "rating_sum": lambda: F.when(rated, F.col("metadata.rating")),
            "rating_n": lambda: F.when(rated, F.lit(1)),
            "last": lambda: F.when(own, F.col("ts_us")),
        }[self.kind]()

    def total(self, column: Column) -> Column:
        return F.max(column) if self.kind == "last" else F.sum(column)


def rounded(value: Column, digits: int) -> Column:
    """Scaled, rounded half away from zero and scaled back, all in doubles, as databases do.

    ``F.round`` goes by a double's shortest decimal text instead: 0.00015 becomes 0.0002 there, and 0.0001 here, as 0.00015 * 10000 is below 1.5.
    """
    scale = F.lit(10.0**digits)
    return F.when(F.abs(value * scale) < F.lit(float("inf")), F.round(value * scale) / scale).otherwise(value)


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(rounded(F.try_divide(part.cast("double"), whole.cast("double")), digits), F.lit(0.0))


def relative_difference(a: Column, b: Column) -> Column:
    """|a - b| / max(|b|, 1e-9); 0 where both are the same infinity, infinite where one is."""
    infinite = F.abs(a) == F.lit(float("inf"))
    infinite = infinite | (F.abs(b) == F.lit(float("inf")))
    return F.when(a == b, F.lit(0.0)).when(infinite, F.lit(float("inf"))).otherwise(F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-9)))
