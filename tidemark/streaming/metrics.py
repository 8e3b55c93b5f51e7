"""Counts and times of a running stream."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, deque

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: Upper ends of the buckets of a micro-batch's time, in milliseconds: from half a second, doubled, to about four minutes.
BATCH_MS = tuple(500 * 2**k for k in range(10))


class Histogram:
    """Counts by buckets, each with what is below its end."""

    def __init__(self, name: str, ends: tuple[float, ...]):
        self.name, self.ends, self.counts, self.total = name, ends, [0] * (len(ends) + 1), 0.0

    def add(self, value: float) -> None:
        self.counts[bisect_left(self.ends, value)] += 1
        self.total += value

    def as_text(self) -> str:
        below = [sum(self.counts[: i + 1]) for i in range(len(self.counts))]
        lines = [f'{self.name}_bucket{{le="{end}"}} {n}' for end, n in zip([*self.ends, "+Inf"], below, strict=True)]
        return "\n".join([*lines, f"{self.name}_sum {self.total}", f"{self.name}_count {below[-1]}", ""])


def observed(found: DataFrame, names: list[str], name: str = "lookups") -> tuple[DataFrame, Observation]:
    """Looked-up rows, and what is counted of them as they are used: rows, values asked for, values that were missing."""
    watch = Observation(name)
    misses = [F.count_if(F.col(n).isNull()) for n in names]
    return found.observe(watch, F.count("*").alias("rows"), (F.count("*") * len(names)).alias("values"), sum(misses[1:], misses[0]).alias("misses") if misses else F.lit(0).alias("misses")), watch


def measured(found: DataFrame, names: list[str], took: str, name: str = "served") -> DataFrame:
    """Looked-up rows, streaming or not, with counts of rows and of each feature's misses and a sketch of the column ``took`` observed in each batch."""
    misses = [F.count_if(F.col(n).isNull()).alias(f"miss_{n}") for n in names]
    return found.observe(name, F.count("*").alias("rows"), *misses, F.kll_sketch_agg_double(F.col(took).cast("double")).alias("took"))


class Served(StreamingQueryListener):
    """Adds up what ``measured`` observes in the batches of a stream: counts are added, sketches merged."""

    def __init__(self, name: str = "served"):
        self.name, self.rows, self.misses, self.sketches = name, 0, Counter(), []

    def add(self, seen: dict) -> None:
        self.rows += seen["rows"]
        self.misses.update({k.removeprefix("miss_"): n for k, n in seen.items() if k.startswith("miss_")})
        if seen["rows"]:
            self.sketches.append(bytes(seen["took"]))

    def quantiles(self, spark: SparkSession, at: list[float]) -> list[float]:
        """Of all that was observed; ranks are right within about 1.3 percent."""
        merged = spark.createDataFrame([(s,) for s in self.sketches], "took binary").agg(F.kll_merge_agg_double("took").alias("took"))
        return list(merged.select(*[F.kll_sketch_get_quantile_double("took", F.lit(q)).alias(f"q{i}") for i, q in enumerate(at)]).first())

    def as_text(self) -> str:
        return "\n".join([f"{self.name}_rows_total {self.rows}", *(f'{self.name}_miss_total{{feature="{k}"}} {n}' for k, n in sorted(self.misses.items())), ""])

    def onQueryStarted(self, event: object) -> None: ...

    def onQueryIdle(self, event: object) -> None: ...

    def onQueryTerminated(self, event: object) -> None: ...

    def onQueryProgress(self, event: object) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.add(seen.asDict())


class Progress(StreamingQueryListener):
    """Keeps the last batches' numbers, and totals."""

    def __init__(self, kept: int = 1000):
        self.batches: deque[dict] = deque(maxlen=kept)
        self.events, self.errors = 0, 0
        self.latency = Histogram("stream_batch_latency_ms", BATCH_MS)

    def onQueryStarted(self, event: object) -> None: ...

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        self.events += p.numInputRows
        self.latency.add(p.durationMs.get("triggerExecution", 0))
        self.batches.append({"batch_id": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "latency_ms": p.durationMs.get("triggerExecution", 0)})

    def onQueryIdle(self, event: object) -> None: ...

    def onQueryTerminated(self, event: object) -> None:
        self.errors += event.exception is not None

    def as_text(self) -> str:
        """In the text format that metric scrapers read."""
        slowest = max((b["latency_ms"] for b in self.batches), default=0)
        return f"stream_events_total {self.events}\nstream_errors_total {self.errors}\nstream_batches_total {len(self.batches)}\nstream_batch_latency_ms_max {slowest}\n" + self.latency.as_text()
