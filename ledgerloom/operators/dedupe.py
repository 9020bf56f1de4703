"""Exactly-once view of at-least-once deliveries, and point lookups by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dedupe_events(deliveries: DataFrame, arrival: list[str], key: str = "event_id") -> DataFrame:
    """The first arrival of every event; later payloads are ignored even when they differ.

    One ``min`` over a struct that starts with the arrival order: copies are
    folded before the shuffle, so an event delivered a billion times costs one
    row per input task.
    """
    rest = [c for c in deliveries.columns if c != key and c not in arrival]
    first = F.min(F.struct(*arrival, *rest)).alias("first")
    return deliveries.groupBy(key).agg(first).select(
        *[F.col(key) if c == key else F.col(f"first.{c}").alias(c) for c in deliveries.columns]
    )


def new_events(
    batch: DataFrame, ledger: DataFrame, arrival: list[str], key: str = "event_id"
) -> DataFrame:
    """First arrivals of ``batch`` whose event the ledger does not hold yet.

    The ledger is only probed for the batch's ids: one column is scanned, and it
    is not shuffled while the batch's ids are small enough for Spark to broadcast.
    """
    first = dedupe_events(batch, arrival, key)
    known = ledger.select(key).join(batch.select(key).distinct(), key, "left_semi")
    return first.join(known, key, "left_anti")


def duplicate_report(deliveries: DataFrame) -> DataFrame:
    """Events delivered more than once: how often, and under how many tenants."""
    per_tenant = deliveries.groupBy("event_id", "tenant_id").agg(F.count("*").alias("copies"))
    per_event = per_tenant.groupBy("event_id").agg(
        F.sum("copies").alias("deliveries"), F.count("*").alias("tenants")
    )
    return per_event.where(F.col("deliveries") > 1)


def duplicates_by_tenant(deliveries: DataFrame, arrival: list[str]) -> DataFrame:
    """Per tenant: deliveries, and how many repeat an event that arrived earlier."""
    total = deliveries.groupBy("tenant_id").agg(F.count("*").alias("deliveries"))
    first = (
        dedupe_events(deliveries, arrival).groupBy("tenant_id").agg(F.count("*").alias("accepted"))
    )
    accepted = F.coalesce(F.col("accepted"), F.lit(0).cast("bigint"))
    return total.join(first, "tenant_id", "left").select(
        "tenant_id", "deliveries", accepted.alias("accepted"),
        (F.col("deliveries") - accepted).alias("duplicates"),
    )


def get_by_event_id(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per requested id with the ledger row, ``outcome`` found or not found."""
    found = ledger.withColumn("_found", F.lit(True))
    outcome = F.when(F.col("_found"), F.lit("found")).otherwise(F.lit("not found"))
    return requests.join(found, "event_id", "left").withColumn("outcome", outcome).drop("_found")


def list_by_tenant(ledger: DataFrame, tenant_id: str | Column, since: Column) -> DataFrame:
    """One tenant's trades from ``since`` on, ordered by trade time; empty when there are none."""
    return ledger.where(
        (F.col("tenant_id") == tenant_id) & (F.col("occurred_at") >= since)
    ).orderBy("occurred_at", "id")


def get_state(keys: DataFrame, state: DataFrame) -> DataFrame:
    """State per requested (tenant, instrument); an unseen pair starts from zero."""
    zero = F.lit(0).cast("bigint")
    return keys.join(state, ["tenant_id", "instrument"], "left").withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("position", "average_cost", "realized_pnl")}
    )


def skip_applied(trades: DataFrame, state: DataFrame) -> DataFrame:
    """Ledger rows above their key's watermark.

    Reads the ledger, not the batch of new events, so a row that was stored but
    never applied is picked up by the next run.
    """
    marks = state.select("tenant_id", "instrument", F.col("last_transaction_id").alias("_mark"))
    above = F.col("_mark").isNull() | (F.col("_mark") < F.col("id"))
    return trades.join(marks, ["tenant_id", "instrument"], "left").where(above).drop("_mark")
