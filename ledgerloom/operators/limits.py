"""Request-path controls read from logs: rate-limit verdicts, outages, failure streaks."""

from __future__ import annotations

from fractions import Fraction

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions import bucketfold
from ledgerloom.operators.longkeys import SEGMENT_ROWS, long_keys, with_segments
from ledgerloom.operators.prefix import ranked_cells, running_sum
from ledgerloom.session import cut_lineage

cloudpickle.register_pickle_by_value(bucketfold)

# Default limit per key, and outcomes that say nothing about health.
REQUESTS_PER_SECOND = 50
BURST = 100
EXPECTED_OUTCOMES = ["duplicate", "not found", "stale"]

SEGMENT = ["key", "segment"]
ORDER = ["key", "segment", "ts_us", "call_id"]


def rate_limit_verdicts(
    calls: DataFrame,
    rate: float | Fraction = REQUESTS_PER_SECOND,
    burst: int = BURST,
    segment_rows: int = SEGMENT_ROWS,
    cell_us: int | None = None,
) -> DataFrame:
    """Per call of ``key, ts_us, call_id``: would a token bucket per key have let it pass?

    A key's first call sees a full bucket. Very long keys are cut into segments
    by rank, or by time in cells of ``cell_us``. What a segment makes of any number of
    tokens it may start with is a function of few pieces, found for all segments in
    parallel; walking along a key's segments then gives every entry, whatever the load.
    """
    exact = Fraction(rate).limit_denominator(1_000_000)
    units, refill = 1_000_000 * exact.denominator, exact.numerator
    decide = bucketfold.folder(units, refill, burst)
    calls = calls.select("key", "ts_us", "call_id")
    long = long_keys(calls, ["key"], segment_rows)
    any_long = not long.isEmpty()
    usual = calls
    if any_long:
        long = cut_lineage(long)
        usual = calls.join(long, "key", "left_anti")
    usual = usual.withColumn("segment", F.lit(0).cast("bigint"))
    verdicts = (
        usual.select(*ORDER).repartition("key").sortWithinPartitions(*ORDER)
        .mapInArrow(decide, bucketfold.VERDICT_SCHEMA)
    )
    if any_long:
        held = calls.join(long, "key", "left_semi")
        if cell_us is None:
            work = ranked_cells(held, ["key"], ["ts_us", "call_id"], segment_rows, "segment").select(*ORDER)
        else:
            held = with_segments(held, ["key"], "ts_us", segment_rows, cell_us).select(*ORDER)
            work = cut_lineage(held.repartition(*SEGMENT).sortWithinPartitions(*ORDER))
        entries = _entries(work, units, refill, burst)
        verdicts = verdicts.unionByName(
            work.join(entries, SEGMENT).sortWithinPartitions(*ORDER)
            .mapInArrow(decide, bucketfold.VERDICT_SCHEMA)
        )
    return verdicts.drop("segment")


def _entries(work: DataFrame, units: int, refill: int, burst: int) -> DataFrame:
    """Tokens and time every segment starts from; a task walks over one row per segment of a key."""
    effects = work.mapInArrow(bucketfold.effects(units, refill, burst), bucketfold.EFFECT_SCHEMA)
    chains = effects.repartition("key").sortWithinPartitions(*SEGMENT)
    return cut_lineage(
        chains.mapInArrow(bucketfold.walker(units, refill, burst), bucketfold.ENTRY_SCHEMA)
    )


def outage_intervals(samples: DataFrame) -> DataFrame:
    """Unbroken runs of one breaker state per ``dependency``, from scraped samples.

    A run lasts until the next run's first sample; the last one is still open.
    """
    order = Window.partitionBy("dependency").orderBy("ts")
    starts = F.coalesce(F.col("state") != F.lag("state").over(order), F.lit(True)).cast("int")
    runs = (
        samples.withColumn("_starts", starts)
        .withColumn("run", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("dependency", "run")
        .agg(
            F.first("state").alias("state"),
            F.min("ts").alias("started_at"),
            F.max("ts").alias("last_seen"),
            F.count("*").alias("samples"),
        )
    )
    ended = F.lead("started_at").over(Window.partitionBy("dependency").orderBy("run"))
    return runs.withColumn("ended_at", ended).select(
        "dependency", F.col("run").cast("bigint").alias("run"), "state", "started_at", "ended_at",
        "samples",
        F.expr("unix_micros(coalesce(ended_at, last_seen)) - unix_micros(started_at)").alias(
            "duration_us"
        ),
    )


def failure_streaks(
    calls: DataFrame, threshold: int, cell: Column | None = None, ignored: list[str] = EXPECTED_OUTCOMES
) -> DataFrame:
    """Runs of at least ``threshold`` failures in a row per ``dependency``.

    Expected outcomes neither extend nor end a run. Failures between the same
    two successes share the running count of successes, taken cell by cell, so
    a dependency with most of the calls is spread over its cells. These are ranges of the calls by
    rank, or what ``cell`` says.
    """
    counted = calls.where(~F.col("outcome").isin(list(ignored))).withColumn(
        "_ok", (F.col("outcome") == "success").cast("bigint")
    )
    if cell is None:
        counted = ranked_cells(
            counted.select("dependency", "ts", "call_id", "_ok"), ["dependency"], ["ts", "call_id"]
        )
    else:
        counted = counted.withColumn("_cell", cell)
    runs = running_sum(counted, ["dependency"], "_cell", ["ts", "call_id"], "_ok", "_run")
    return (
        runs.where("_ok = 0")
        .groupBy("dependency", "_run")
        .agg(
            F.min("ts").alias("started_at"),
            F.max("ts").alias("last_failure_at"),
            F.count("*").alias("failures"),
        )
        .where(F.col("failures") >= threshold)
        .drop("_run")
    )
