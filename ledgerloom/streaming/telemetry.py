"""Call roll-ups by event time; the result of a finished stream is the batch result.

Counts and sums add up, so every micro-batch stores its own part of a window and readers add the
parts. No watermark is needed: a late call counts, however late it is, and no state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.operators.telemetry import LATENCY_BOUNDS_US

KEY = ["window_start", "window_end", "tenant_id", "outcome"]


def windowed_counts(calls: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Calls, latency sum and cumulative buckets per window, tenant and outcome of one batch."""
    latency = F.col("latency_us")
    return (
        calls.groupBy(F.window("ts", width), "tenant_id", "outcome")
        .agg(
            F.count("*").alias("calls"),
            F.sum("latency_us").alias("sum_us"),
            *[F.count(F.when(latency <= b, 1)).alias(f"le_{b}") for b in LATENCY_BOUNDS_US],
        )
        .withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")})
        .drop("window")
    )


def added_windows(parts: DataFrame) -> DataFrame:
    """Windows from the parts that the micro-batches stored, one folder per ``batch``."""
    values = [c for c in parts.columns if c not in (*KEY, "batch")]
    return parts.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in values])
