"""Commands: produce events, run the stream, build a training set, check the stores.

    python -m tidemark produce --n 10000 --out events/
    python -m tidemark process --messages events/ --store store/
    python -m tidemark build-dataset --n 50000 --hours 48 --out training/
    python -m tidemark check --store store/ --entity user
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import default_catalog
from tidemark.config import Settings
from tidemark.operators import consistency, offline_store, snapshots, training
from tidemark.session import session
from tidemark.sources import events as source
from tidemark.sources import generator
from tidemark.streaming import pipeline


def produce(spark: SparkSession, args: argparse.Namespace) -> None:
    """Synthetic events as JSON lines, or to Kafka with --kafka."""
    made = generator.batch(spark, args.n, args.start, args.rate, args.seed, args.users, args.items)
    if args.kafka:
        source.write_kafka(made, Settings())
    else:
        source.to_messages(made).select("value").write.mode("append").text(args.out)


def process(spark: SparkSession, args: argparse.Namespace) -> None:
    """Messages to both stores: what is there, or as it comes with --follow."""
    messages = source.kafka_stream(spark, Settings(), args.starting) if args.kafka else source.json_stream(spark, args.messages)
    trigger = {"processingTime": "500 milliseconds"} if args.follow else {"availableNow": True}
    for query in pipeline.start(messages, pipeline.Paths(args.store), trigger=trigger):
        query.awaitTermination()


def build_dataset(spark: SparkSession, args: argparse.Namespace) -> None:
    """Events over some hours, hourly snapshots, labels, the point-in-time join and its audit; CSV at the end."""
    made = generator.historical(spark, args.n, args.end, args.hours, args.seed, args.users, args.items)
    end = F.lit(args.end).cast("timestamp")
    start = spark.range(1).select((end - F.make_dt_interval(hours=F.lit(args.hours - 1))).alias("s")).first()["s"]
    catalog = default_catalog()
    grids = {e: snapshots.materialise(made, e, start, args.end, args.freq) for e in ("user", "item")}
    labels = training.label_events(made, args.max_labels)
    data = training.build_training_set(labels, grids["user"], grids["item"], catalog.names("user"), catalog.names("item"))
    report = training.validate_no_leakage(data)
    print(report.summary())
    if not report.passed:
        raise SystemExit(1)
    training.export_csv(data, args.out)
    training.class_balance(labels).show()


def check(spark: SparkSession, args: argparse.Namespace) -> None:
    """The online values of all ids against the latest offline snapshot."""
    paths, key = pipeline.Paths(args.store), f"{args.entity}_id"
    offline = offline_store.latest_as_of(offline_store.read_snapshots(spark, paths.offline, args.entity), args.entity, args.as_of)
    names = [n for n in default_catalog().names(args.entity) if dict(offline.dtypes)[n] in ("double", "bigint")]
    long = pipeline.read_online(spark, paths).where(F.col("entity") == args.entity)
    # JSON has no infinity: a null online value isn't compared.
    online = long.groupBy(F.col("entity_id").alias(key)).agg(*[F.max(F.when(F.col("feature_name") == n, F.col("value_json"))).cast("double").alias(n) for n in names])
    report = consistency.check(online, offline, args.entity, names, offline.select(key))
    print(report.summary())
    if not report.passed:
        raise SystemExit(1)


def main(argv: list[str] | None = None) -> None:
    settings = Settings()
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)

    def command(name: str, run: object) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=run.__doc__)
        sub.set_defaults(run=run)
        sub.add_argument("--seed", type=int, default=42)
        sub.add_argument("--users", type=int, default=settings.n_users)
        sub.add_argument("--items", type=int, default=settings.n_items)
        return sub

    sub = command("produce", produce)
    sub.add_argument("--n", type=int, default=10_000)
    sub.add_argument("--rate", type=float, default=settings.events_per_second)
    sub.add_argument("--start", default="2024-01-01 00:00:00")
    sub.add_argument("--out", default="events")
    sub.add_argument("--kafka", action="store_true")
    sub = command("process", process)
    sub.add_argument("--messages", default="events")
    sub.add_argument("--store", default="feature_store")
    sub.add_argument("--starting", default="earliest")
    sub.add_argument("--follow", action="store_true")
    sub.add_argument("--kafka", action="store_true")
    sub = command("build-dataset", build_dataset)
    sub.add_argument("--n", type=int, default=50_000)
    sub.add_argument("--hours", type=int, default=48)
    sub.add_argument("--end", default="2024-01-03 00:00:00")
    sub.add_argument("--freq", default="1H", choices=sorted(snapshots.FREQUENCIES))
    sub.add_argument("--max-labels", type=int, default=5000)
    sub.add_argument("--out", default="training")
    sub = command("check", check)
    sub.add_argument("--store", default="feature_store")
    sub.add_argument("--entity", default="user", choices=["user", "item"])
    sub.add_argument("--as-of", default="9999-01-01 00:00:00")
    args = parser.parse_args(argv)
    args.run(session(), args)


if __name__ == "__main__":
    main()
