"""Run the pipeline as a Spark application.

spark-submit --py-files contexture.zip contexture/streaming/__main__.py \\
    --base s3a://lake --servers broker:9092
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from contexture.session import build_session, state_session
from contexture.sources.topics import FolderTopics, KafkaTopics
from contexture.streaming.pipeline import AVAILABLE_NOW, PipelineConfig, run


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="contexture.streaming", description=__doc__)
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--servers", help="Kafka bootstrap servers")
    source.add_argument("--folder", help="root of topic folders")
    parser.add_argument("--base", required=True, help="where tables are kept")
    parser.add_argument("--since", help="ISO time; earlier incidents are left out")
    parser.add_argument("--match", choices=["first", "nearest"], default="first")
    parser.add_argument("--every", default="60 seconds", help="processing interval")
    parser.add_argument(
        "--drain",
        action="store_true",
        help="process what is there, then stop; with --match nearest, incidents "
        "whose minute the watermark has not passed are answered by what is there",
    )
    parser.add_argument(
        "--state-partitions",
        type=int,
        default=200,
        help="kept from the first run on; about twice the cores of the cluster",
    )
    parser.add_argument("--max-offsets", help="Kafka offsets per micro-batch")
    return parser.parse_args(arguments)


def configure(
    options: argparse.Namespace,
) -> tuple[KafkaTopics | FolderTopics, PipelineConfig]:
    base = options.base.rstrip("/")
    since = None
    if options.since:
        since = datetime.fromisoformat(options.since)
        since = since if since.tzinfo else since.replace(tzinfo=timezone.utc)
    config = PipelineConfig(
        joined_path=f"{base}/weather_traffic_comb",
        observations_path=f"{base}/weather_duration",
        snapshot_path=f"{base}/snapshot",
        checkpoint_path=f"{base}/checkpoints",
        since=since,
        match=options.match,
        finish=options.drain,
        trigger=AVAILABLE_NOW if options.drain else {"processingTime": options.every},
    )
    if options.folder:
        return FolderTopics(options.folder), config
    limit = options.max_offsets
    read_options = {"maxOffsetsPerTrigger": limit} if limit else {}
    return KafkaTopics(options.servers, read_options), config


def main() -> None:
    options = parse()
    topics, config = configure(options)
    spark = state_session(build_session("contexture"), options.state_partitions)
    run(spark, topics, config)


if __name__ == "__main__":
    main()
