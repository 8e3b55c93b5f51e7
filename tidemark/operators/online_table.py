"""The online store as files: keys in buckets, each a base and what came since, named by a manifest for each batch.

A batch's rows go, by a hash of their key, to files of their own, and a manifest says for every bucket which files hold it from then on. A
bucket that has ``merge_every`` batches on top of its base gets a new base, and no other bucket is rewritten: what a merge costs grows
with the keys of the buckets that were touched. Nothing that a kept manifest names is ever overwritten or deleted, so a reader never
meets a half-written state, and an empty batch changes nothing. A batch that has its manifest is in: if it comes again, nothing happens.

Batches come in the order of their ids, not all of which need to come. ``upto`` hides all later batches.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import files
from tidemark.operators.online_store import KEY, merged

SCHEMA = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("entity_id", T.LongType()),
        T.StructField("feature_name", T.StringType()),
        T.StructField("value_json", T.StringType()),
        T.StructField("written_at", T.TimestampType()),
        T.StructField("expires_at", T.TimestampType()),
    ]
)
#: Manifests that stay readable behind the newest.
KEPT = 3


@dataclass(frozen=True)
class OnlineTable:
    spark: SparkSession
    path: str
    buckets: int = 64
    merge_every: int = 20

    def manifests(self, upto: int | None = None) -> list[int]:
        ids = [int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.path}/manifest") if n.endswith(".json") and not n.startswith("_")]
        return sorted(i for i in ids if upto is None or i <= upto)

    def manifest(self, batch_id: int) -> dict[int, list[str]]:
        """The files' folders of each bucket, its base first."""
        return {int(b): held for b, held in json.loads(files.read(self.spark, f"{self.path}/manifest/{batch_id}.json")).items()}

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """The rows of a batch take the place of older ones of their keys."""
        known = self.manifests(batch_id)
        if known[-1:] == [batch_id]:
            return
        held = self.manifest(known[-1]) if known else {}
        touched = self._write(rows, f"data/batch={batch_id}")
        if not touched:
            return
        held |= {b: [*held.get(b, []), f"data/batch={batch_id}"] for b in touched}
        full = [b for b in touched if len(held[b]) > self.merge_every]
        if full:
            self._write(self._of({b: held[b] for b in full}), f"data/base={batch_id}")
            held |= {b: [f"data/base={batch_id}"] for b in full}
        files.write(self.spark, f"{self.path}/manifest/{batch_id}.json", json.dumps(held))
        self._tidy(batch_id)

    def read(self, upto: int | None = None) -> DataFrame:
        """The latest value of each key, of no batch after ``upto``; an empty store has no rows."""
        known = self.manifests(upto)
        return self._of(self.manifest(known[-1]) if known else {})

    def of_keys(self, keys: DataFrame, upto: int | None = None) -> DataFrame:
        """``read`` for keys (entity, entity_id, feature_name) that few buckets hold: the others' files are not opened."""
        known = self.manifests(upto)
        held = self.manifest(known[-1]) if known else {}
        wanted = {r["bucket"] for r in self._numbered(keys).select("bucket").distinct().collect()}  # at most as many as there are buckets
        return self._of({b: x for b, x in held.items() if b in wanted}).join(keys, list(KEY), "left_semi")

    def _numbered(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, folder: str) -> list[int]:
        """The buckets that were written, one file or more for each."""
        numbered = self._numbered(rows.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA]))
        numbered.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/{folder}")
        return [int(n.removeprefix("bucket=")) for n in files.names(self.spark, f"{self.path}/{folder}") if n.startswith("bucket=")]

    def _of(self, held: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folders in held.items() for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return merged(None, self.spark.read.schema(SCHEMA).parquet(*paths))

    def _tidy(self, batch_id: int) -> None:
        """What only manifests older than the kept ones name goes."""
        known = self.manifests(batch_id)
        old, kept = known[: -KEPT - 1], known[-KEPT - 1 :]
        if not old:
            return
        for i in old:
            files.remove(self.spark, f"{self.path}/manifest/{i}.json")
        live = {folder for i in kept for folders in self.manifest(i).values() for folder in folders}
        for name in files.names(self.spark, f"{self.path}/data"):
            if f"data/{name}" not in live and int(name.partition("=")[2]) <= old[-1]:
                files.remove(self.spark, f"{self.path}/data/{name}")
