"""Trade events from a topic, from request bodies or from typed rows.

A Kafka topic and a folder of files with the same columns are read alike, so
everything downstream is the same for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.functions.amounts import format_amount
from ledgerloom.functions.text import format_rfc3339, partition_key
from ledgerloom.schemas import TOPIC_RECORD, TYPED_EVENT
from ledgerloom.sources.tables import COMPRESSION

COLUMNS = ["topic", "partition", "offset", "key", "value", "timestamp"]


def _from_kafka(reader) -> DataFrame:
    return reader.load().select(
        "topic", "partition", "offset", F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"), "timestamp",
    )


def bounded_poll(max_records: int = 0, max_files: int = 0) -> dict[str, str]:
    """Source options that cap what one micro-batch takes; zero means no cap."""
    options = {}
    if max_records > 0:
        options["maxOffsetsPerTrigger"] = str(max_records)
    if max_files > 0:
        options["maxFilesPerTrigger"] = str(max_files)
    return options


def topic_options(
    brokers: str, topic: str, group: str | None = None, max_records: int = 0, start: str = "earliest",
    partitions: list[int] | None = None,
) -> dict[str, str]:
    """Options of the source: the whole topic, or the listed partitions only."""
    options = {"kafka.bootstrap.servers": brokers, "startingOffsets": start, **bounded_poll(max_records=max_records)}
    if partitions is None:
        options["subscribe"] = topic
    else:
        options["assign"] = "{" + f'"{topic}":[{",".join(map(str, partitions))}]' + "}"
    if group:
        options["kafka.group.id"] = group
    return options


def read_trade_topic(
    spark: SparkSession, brokers: str, topic: str, group: str | None = None, max_records: int = 0,
    start: str = "earliest",
) -> DataFrame:
    """Stream of topic records (needs the public Kafka connector on the class path).

    A first start reads what the topic already holds.
    """
    options = topic_options(brokers, topic, group, max_records, start)
    return _from_kafka(spark.readStream.format("kafka").options(**options))


def read_trade_files(
    spark: SparkSession, folder: str, max_files: int = 0, streaming: bool = True
) -> DataFrame:
    """Topic records kept as Parquet files, as a stream or as a table."""
    if not streaming:
        return spark.read.schema(TOPIC_RECORD).parquet(folder)
    return (
        spark.readStream.schema(TOPIC_RECORD)
        .options(**bounded_poll(max_files=max_files))
        .parquet(folder)
    )


def partition_list(text: str) -> list[int]:
    """Partitions from a comma-separated list such as ``0, 1, 2``."""
    numbers = [int(field.strip()) for field in text.split(",")]
    if any(n < 0 for n in numbers):
        raise ValueError(f"partitions must not be negative: {text!r}")
    return numbers


def read_topic_partitions(
    spark: SparkSession, brokers: str, topic: str, partitions: list[int], max_records: int = 0
) -> DataFrame:
    """Stream of the listed partitions only, each from its start."""
    options = topic_options(brokers, topic, max_records=max_records, partitions=partitions)
    return _from_kafka(spark.readStream.format("kafka").options(**options))


def read_partitions(records: DataFrame, partitions: list[int]) -> DataFrame:
    """The listed partitions of a table of records; prunes when it is laid out by partition."""
    return records.where(F.col("partition").isin(partitions))


def read_rest_events(
    spark: SparkSession, path: str, streaming: bool = False, separator: str | None = None
) -> DataFrame:
    """Request bodies in column ``value``, one per file or, with a separator, one between two of them.

    A body may hold line breaks, so a line is not a body.
    """
    reader = spark.readStream if streaming else spark.read
    if separator is None:
        return reader.text(path, wholetext=True)
    return reader.text(path, lineSep=separator)


def read_typed_events(
    spark: SparkSession, path: str, streaming: bool = False, extra: str | None = None
) -> DataFrame:
    """Typed event rows: amounts already scaled, side as a code; ``extra`` names columns that come with them."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(f"{TYPED_EVENT}, {extra}" if extra else TYPED_EVENT).parquet(path)


def encode_wire_event(trades: DataFrame) -> DataFrame:
    """Add the topic ``key`` and the JSON ``value`` of every trade; other columns stay."""
    value = F.to_json(
        F.struct(
            "event_id", "tenant_id", "schema_version", "instrument", "side",
            format_amount(F.col("quantity")).alias("quantity"),
            format_amount(F.col("price")).alias("price"),
            "currency",
            format_rfc3339(F.col("occurred_at")).alias("occurred_at"),
        )
    )
    return trades.withColumns(
        {"key": partition_key(F.col("tenant_id"), F.col("instrument")), "value": value}
    )


def wire_records(trades: DataFrame) -> DataFrame:
    """What the sink is handed: key, value and, where placement has set it, the partition."""
    encoded = encode_wire_event(trades)
    if "partition" in trades.columns:
        return encoded.select("key", "value", F.col("partition").cast("int").alias("partition"))
    return encoded.select("key", "value")


def publish_trades(trades: DataFrame, brokers: str, topic: str, checkpoint: str | None = None):
    """Write encoded trades to a topic, as a stream when ``trades`` is one.

    A column ``partition`` from ``placement.partition_for`` decides where each record goes.
    """
    encoded = wire_records(trades)
    if trades.isStreaming:
        return (
            encoded.writeStream.format("kafka")
            .option("kafka.bootstrap.servers", brokers)
            .option("topic", topic)
            .option("kafka.acks", "all")
            .option("checkpointLocation", checkpoint)
            .start()
        )
    return (
        encoded.write.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("topic", topic)
        .option("kafka.acks", "all")
        .save()
    )


def publish_files(records: DataFrame, folder: str) -> None:
    """Write topic records as files that ``read_trade_files`` reads back."""
    records.select(*COLUMNS).write.mode("append").parquet(folder, compression=COMPRESSION)
