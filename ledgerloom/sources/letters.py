"""The dead-letter sink: encoded letters as files of records or on a topic, under the key of the failed record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import dlq
from ledgerloom.sources import tables

RECORD = "key string, value string"


def write_letter_files(letters: DataFrame, folder: str, batch_id: int = 0) -> None:
    """Write the letters of one batch as records; a replayed batch replaces its own."""
    tables.write_batch(dlq.encode_dlq(letters), folder, batch_id)


def read_letter_files(spark: SparkSession, folder: str) -> DataFrame:
    """The letters of all batches, decoded."""
    records = spark.read.schema(f"{RECORD}, batch bigint").option("basePath", folder).parquet(f"{folder}/batch=*")
    return dlq.decode_dlq(records)


def topic_options(brokers: str, topic: str) -> dict[str, str]:
    """A letter is lost only if every in-sync replica is."""
    return {"kafka.bootstrap.servers": brokers, "topic": topic, "kafka.acks": "all"}


def publish_letters(letters: DataFrame, brokers: str, topic: str) -> None:
    """Write the letters to a dead-letter topic (needs the public Kafka connector on the class path)."""
    dlq.encode_dlq(letters).write.format("kafka").options(**topic_options(brokers, topic)).save()
