"""Throughput, latency, lag and breaker roll-ups, and look-backs over scraped samples.

Raw facts are always reduced by a combining aggregate first. Windows run on the
reduced series only: one row per series and scrape, so a series' length is
bounded by time, not by traffic.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window, functions as F

# Latency bucket bounds in microseconds, and the label of strangers.
LATENCY_BOUNDS_US = [
    25, 50, 100, 250, 500, 1_000, 2_500, 5_000, 10_000, 25_000, 50_000, 100_000,
]
UNKNOWN_TENANT = "unregistered"


def tenant_label(rows: DataFrame, known: DataFrame | None, tenant: str = "tenant_id") -> DataFrame:
    """Add ``tenant``: the id when it is known, else ``unregistered``.

    ``known`` is a plain join side; Spark broadcasts it when its measured size allows.
    """
    if known is None:
        return rows.withColumn("tenant", F.lit(UNKNOWN_TENANT))
    names = known.select(F.col("tenant_id").alias("_known")).distinct()
    joined = rows.join(names, rows[tenant] == names["_known"], "left")
    return joined.withColumn("tenant", F.coalesce("_known", F.lit(UNKNOWN_TENANT))).drop("_known")


def outcome_counts(calls: DataFrame, by: list[str] = ()) -> DataFrame:
    """Successes and failures; an outcome that never occurred counts zero."""
    counts = calls.groupBy(*by).agg(
        *[
            F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("success", "failure")
        ]
    )
    return counts.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(o).alias("outcome"), F.col(o).alias("calls"))
                    for o in ("success", "failure")
                ]
            )
        ).alias("c"),
    ).select(*by, "c.*")


def latency_histogram(
    calls: DataFrame, by: list[str], bounds_us: list[int] = LATENCY_BOUNDS_US
) -> DataFrame:
    """Cumulative buckets per series: ``le`` in seconds (``+Inf`` last), bucket, count and sum.

    One pass with a conditional count per bound; a series costs one shuffled row per task.
    """
    latency = F.col("latency_us")
    counted = calls.groupBy(*by).agg(
        *[F.count(F.when(latency <= b, 1)).alias(f"_b{i}") for i, b in enumerate(bounds_us)],
        F.count(latency).alias("observations"),
        F.sum(latency).alias("sum_us"),
    )
    buckets = [
        F.struct(F.lit(b / 1e6).alias("le"), F.col(f"_b{i}").alias("bucket"))
        for i, b in enumerate(bounds_us)
    ]
    last = F.struct(F.lit(float("inf")).alias("le"), F.col("observations").alias("bucket"))
    return counted.select(
        *by, "observations", "sum_us", F.explode(F.array(*buckets, last)).alias("h")
    ).select(*by, "h.le", "h.bucket", "observations", "sum_us")


def quantile_of(buckets: Column, q: float) -> Column:
    """Quantile of sorted cumulative ``array<struct<le, value>>`` by linear interpolation.

    The first bucket starts at zero; a rank in the ``+Inf`` bucket gives the last
    finite bound; no observations or no ``+Inf`` bucket give NULL.
    """
    size = F.size(buckets)
    total = F.element_at(buckets, -1)["value"]
    rank = F.lit(q) * total
    finite = F.slice(buckets, 1, F.greatest(size - 1, F.lit(0)))
    reached = F.filter(finite, lambda b: b["value"] >= rank)
    below = F.filter(finite, lambda b: b["value"] < rank)
    upper = F.try_element_at(reached, F.lit(1))
    lower = F.try_element_at(below, F.lit(-1))
    floor = F.coalesce(lower["le"], F.lit(0.0))
    base = F.coalesce(lower["value"], F.lit(0.0))
    inside = floor + (upper["le"] - floor) * ((rank - base) / (upper["value"] - base))
    return F.when(
        (size >= 2) & (F.element_at(buckets, -1)["le"] == float("inf")) & (total > 0),
        F.when(upper.isNull(), F.element_at(buckets, -2)["le"])
        .when(lower.isNull() & (upper["le"] <= 0), upper["le"])
        .otherwise(inside),
    )


def histogram_quantile(
    buckets: DataFrame, by: list[str], quantiles: dict[str, float], value: str = "value"
) -> DataFrame:
    """Quantile columns per series from rows ``by..., le, value``; equal bounds are summed first."""
    summed = buckets.groupBy(*by, "le").agg(F.sum(F.col(value).cast("double")).alias("value"))
    sorted_buckets = F.sort_array(F.collect_list(F.struct("le", "value")))
    return summed.groupBy(*by).agg(sorted_buckets.alias("_h")).select(
        *by, *[quantile_of(F.col("_h"), q).alias(name) for name, q in quantiles.items()]
    )


def exact_quantile(
    calls: DataFrame, by: list[str], quantiles: dict[str, float], cell_us: int = 1000
) -> DataFrame:
    """Exact nearest-rank quantiles of the raw latencies; calls without a latency do not count.

    Equal latencies are counted before any ordering. Cells of ``cell_us`` give
    the running count of a series, one row per cell; the at most ``cell_us``
    latencies of a cell are ordered only where a wanted rank falls into it.
    """
    timed = calls.where(F.col("latency_us").isNotNull())
    counted = timed.groupBy(
        *by, F.expr(f"latency_us div {cell_us}L").alias("_cell"), "latency_us"
    ).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        counted.groupBy(*by, "_cell").agg(F.sum("_n").alias("_in"))
        .withColumns({"_to": F.sum("_in").over(upto), "_total": F.sum("_in").over(whole)})
    )
    ranks = {
        name: F.greatest(F.ceil(F.lit(q) * F.col("_total")), F.lit(1)) for name, q in quantiles.items()
    }
    before = F.col("_to") - F.col("_in")
    holds = [(before < rank) & (rank <= F.col("_to")) for rank in ranks.values()]
    place = [*by, "_cell"]
    wanted = cells.where(functools.reduce(operator.or_, holds)).select(
        *[F.col(c).alias(f"_at_{c}") for c in place], before.alias("_before"), "_total"
    )
    inside = (
        Window.partitionBy(*place).orderBy("latency_us").rowsBetween(Window.unboundedPreceding, 0)
    )
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in place]
    ranked = counted.join(wanted, functools.reduce(operator.and_, same)).withColumn(
        "_upto", F.col("_before") + F.sum("_n").over(inside)
    )
    at = [
        F.min(F.when(F.col("_upto") >= rank, F.col("latency_us"))).alias(name)
        for name, rank in ranks.items()
    ]
    return ranked.groupBy(*by).agg(F.first("_total").alias("observations"), *at)


def consumer_lag(polls: DataFrame, known: DataFrame | None) -> DataFrame:
    """Lag gauge per poll and tenant label.

    Rows ``poll, partition, offset, tenant_id, decodable, high_watermark``. A
    partition's lag counts from its last record and is labelled with the tenant
    of its last decodable one. The gauge keeps the highest partition's value
    (``lag``), as a gauge that is set per partition does; sum and maximum are
    given beside it.
    """
    per_partition = polls.groupBy("poll", "partition").agg(
        F.max("offset").alias("last_offset"),
        F.max("high_watermark").alias("high_watermark"),
        F.max_by("tenant_id", F.when(F.col("decodable"), F.col("offset"))).alias("tenant_id"),
    )
    lag = F.greatest(F.col("high_watermark") - 1 - F.col("last_offset"), F.lit(0))
    labelled = tenant_label(per_partition.withColumn("_lag", lag), known)
    return labelled.groupBy("poll", "tenant").agg(
        F.max_by("_lag", "partition").alias("lag"),
        F.sum("_lag").alias("lag_sum"),
        F.max("_lag").alias("lag_max"),
    )


def active_consumers(polls: DataFrame, known: DataFrame | None) -> DataFrame:
    """Partitions with at least one record per poll and label of their last decodable tenant."""
    per_partition = polls.groupBy("poll", "partition").agg(
        F.max_by("tenant_id", F.when(F.col("decodable"), F.col("offset"))).alias("tenant_id")
    )
    return (
        tenant_label(per_partition, known)
        .groupBy("poll", "tenant")
        .agg(F.count("*").alias("active_partitions"))
    )


def breaker_state_value(state: Column) -> Column:
    """closed 0, half_open 1, open 2, anything else 3."""
    return (
        F.when(state == "closed", 0).when(state == "half_open", 1).when(state == "open", 2)
        .otherwise(3).cast("bigint")
    )


def instant_value(
    samples: DataFrame, series: list[str], by: list[str], low: int, high: int, scale: float = 1.0
) -> DataFrame:
    """Latest value per ``by``, rounded half away from zero.

    ``problem`` names why there is none: several series matched, or the value
    lies outside ``[low, high]``. A tenant without any series has no row here
    and is reported by ``join_spec_signals``.
    """
    latest = samples.groupBy(*by, *[s for s in series if s not in by]).agg(
        F.max_by("value", "ts").alias("value")
    )
    merged = latest.groupBy(*by).agg(
        F.count("*").alias("series"), F.first("value").alias("raw")
    )
    rounded = F.round(F.col("raw") * scale)
    problem = F.when(F.col("series") > 1, "several series matched").when(
        F.isnan("raw") | ~rounded.between(float(low), float(high)), "value out of range"
    )
    return merged.withColumn("problem", problem).select(
        *by, F.when(F.col("problem").isNull(), rounded).try_cast("bigint").alias("value"), "problem"
    )


def counter_increase(
    samples: DataFrame, series: list[str], window_s: int, extrapolate: bool = False
) -> DataFrame:
    """Reset-aware increase over the last ``window_s`` seconds, at every sample.

    A drop counts from zero. The first sample inside the window is the starting
    point, so only later steps count; fewer than two samples give NULL. With
    ``extrapolate`` the increase is stretched to the window's edges the way
    scraped counters are usually read.
    """
    order = Window.partitionBy(*series).orderBy("_us")
    span = order.rangeBetween(-(window_s * 1_000_000) + 1, 0)
    previous = F.lag("value").over(order)
    step = F.when(F.col("value") < previous, F.col("value")).otherwise(F.col("value") - previous)
    stepped = samples.withColumn("_us", F.unix_micros("ts")).withColumn(
        "_step", F.coalesce(step, F.lit(0.0))
    )
    looked = stepped.withColumns(
        {
            "_n": F.count("*").over(span),
            "_raw": F.sum("_step").over(span) - F.first("_step").over(span),
            "_first_us": F.min("_us").over(span),
            "_first": F.first("value").over(span),
        }
    )
    increase = F.col("_raw")
    if extrapolate:
        covered = (F.col("_us") - F.col("_first_us")) / 1e6
        gap = covered / (F.col("_n") - 1)
        to_start = F.lit(float(window_s)) - covered
        to_start = F.when(to_start >= gap * 1.1, gap / 2).otherwise(to_start)
        to_zero = F.when(
            (F.col("_raw") > 0) & (F.col("_first") >= 0), covered * F.col("_first") / F.col("_raw")
        )
        increase = increase * ((covered + F.least(to_start, to_zero)) / covered)
    return looked.withColumn("increase", F.when(F.col("_n") >= 2, increase)).drop(
        "_us", "_step", "_n", "_raw", "_first_us", "_first"
    )


def counter_rate(
    samples: DataFrame, series: list[str], window_s: int, extrapolate: bool = False
) -> DataFrame:
    """Increase per second over the window."""
    increased = counter_increase(samples, series, window_s, extrapolate)
    return increased.withColumn("rate", F.col("increase") / float(window_s))


def throughput_panel(samples: DataFrame, window_s: int, by: list[str] = ("outcome",)) -> DataFrame:
    """Rate per outcome and scrape, summed over the other labels."""
    series = sorted({*by, "tenant_id", "outcome"} & set(samples.columns))
    return (
        counter_rate(samples, series, window_s)
        .groupBy("ts", *by)
        .agg(F.sum(F.col("increase").cast("decimal(38,0)")).cast("bigint").alias("increase"))
        .withColumn("rate", F.col("increase") / float(window_s))
    )


def latency_panel(
    samples: DataFrame, series: list[str], by: list[str], window_s: int,
    quantiles: dict[str, float],
) -> DataFrame:
    """Quantiles per scrape from bucket counters ``series..., le, ts, value``."""
    increased = counter_increase(samples, [*series, "le"], window_s).where("increase is not null")
    return histogram_quantile(increased, ["ts", *by], quantiles, "increase")


def lag_panel(lag: DataFrame) -> DataFrame:
    """The last reported lag of every label."""
    return lag.groupBy("tenant").agg(
        F.max("poll").alias("poll"), F.max_by("lag", "poll").alias("lag"),
    )


def consumers_panel(active: DataFrame) -> DataFrame:
    return active.groupBy("tenant").agg(
        F.max("poll").alias("poll"),
        F.max_by("active_partitions", "poll").alias("active_partitions"),
    )


def breaker_panel(samples: DataFrame) -> DataFrame:
    """Current state of every breaker and the time spent in samples of each state."""
    return samples.groupBy("dependency").agg(
        F.max_by("state", "ts").alias("state"),
        *[
            F.count(F.when(F.col("state") == s, 1)).alias(name)
            for s, name in enumerate(("closed_samples", "half_open_samples", "open_samples"))
        ],
    )
