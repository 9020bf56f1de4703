"""Dead letters: records that cannot be applied, kept with their reason and their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.text import format_rfc3339, key_tenant
from ledgerloom.operators.validate import decode_wire

MAX_RETRIES = 3


def dlq_envelope(failed: DataFrame, reason: str, attempts: Column, failed_at: Column) -> DataFrame:
    """The dead letter of every failed topic record."""
    return failed.select(
        F.col("topic").alias("original_topic"),
        F.col("partition").cast("int").alias("original_partition"),
        F.col("offset").alias("original_offset"),
        F.col("value").alias("payload"),
        F.col(reason).alias("failure_reason"),
        attempts.cast("int").alias("attempts"),
        failed_at.alias("failed_at"),
        "key",
    )


def route_decode_failures(decoded: DataFrame, failed_at: Column) -> DataFrame:
    """Undecodable records go to the dead letters at once."""
    return dlq_envelope(decoded.where("reason is not null"), "reason", F.lit(1), failed_at)


def route_reconcile_failures(
    checked: DataFrame, failed_at: Column, max_retries: int = MAX_RETRIES,
    reason: str = "check_reason",
) -> DataFrame:
    """Decoded records the ledger or the fold refuses.

    These failures are deterministic, so the retries are reported, not re-run.
    """
    failed = checked.where(F.col(reason).isNotNull())
    return dlq_envelope(failed, reason, F.lit(max_retries + 1), failed_at)


def dead_letters(checked: DataFrame, failed_at: Column, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Both kinds of failure in one pass over rows with ``reason`` and ``check_reason``."""
    undecodable = F.col("reason").isNotNull()
    why = F.coalesce("reason", "check_reason")
    failed = checked.withColumn("_why", why).where(F.col("_why").isNotNull())
    attempts = F.when(undecodable, 1).otherwise(max_retries + 1)
    return dlq_envelope(failed, "_why", attempts, failed_at)


def encode_dlq(letters: DataFrame) -> DataFrame:
    """Dead letters as topic records under the original key."""
    fields = [
        "original_topic", "original_partition", "original_offset", "payload", "failure_reason",
        "attempts",
    ]
    return letters.select(
        "key",
        F.to_json(
            F.struct(*fields, format_rfc3339(F.col("failed_at")).alias("failed_at"))
        ).alias("value"),
    )


def decode_dlq(records: DataFrame) -> DataFrame:
    schema = (
        "original_topic string, original_partition int, original_offset bigint, payload string, "
        "failure_reason string, attempts int, failed_at timestamp"
    )
    return records.select(F.from_json("value", schema).alias("d"), "key").select("d.*", "key")


def dlq_by_tenant(letters: DataFrame) -> DataFrame:
    """Failures per tenant and reason, from the key alone."""
    return letters.groupBy(key_tenant(F.col("key")).alias("tenant_id"), "failure_reason").agg(
        F.count("*").alias("letters"), F.max("attempts").cast("bigint").alias("attempts")
    )


def dlq_count(letters: DataFrame) -> DataFrame:
    return letters.groupBy("original_topic").agg(F.count("*").alias("letters"))


def replay_dlq(letters: DataFrame) -> DataFrame:
    """The original records, decoded again; de-duplication makes a repeat harmless."""
    return decode_wire(
        letters.select(
            F.col("original_topic").alias("topic"),
            F.col("original_partition").alias("partition"),
            F.col("original_offset").alias("offset"),
            "key",
            F.col("payload").alias("value"),
        )
    )
