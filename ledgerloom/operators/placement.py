"""Which partition a (tenant, instrument) lives on.

Reserved tenants get contiguous ranges in tenant order, the others ranges of a
default size in order of first arrival, the rest share the pool by hash. Starts
are running sums over the tenant dimension. No range is empty, so the tables of
ranges have at most ``total`` rows: that bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.functions.text import fnv1a32


def _capacity(total: int) -> int:
    """Reservations leave one partition to the pool, unless there is only one."""
    return total - 1 if total > 1 else 1


def reservation_table(reserved: DataFrame, total: int) -> DataFrame:
    """Ranges of the tenants in ``reserved(tenant_id, size)`` that fit.

    Every reservation takes a partition at least, so no more than the first
    ``capacity`` tenants can fit; only these meet in the window.
    """
    capacity = _capacity(max(total, 1))
    wanted = F.greatest(F.coalesce(F.col("size"), F.lit(1)), F.lit(1)).cast("bigint")
    ends = F.sum("wanted").over(
        Window.orderBy("tenant_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        reserved.select("tenant_id", wanted.alias("wanted"))
        .orderBy("tenant_id")
        .limit(capacity)
        .withColumn("start", ends - F.col("wanted"))
        .where(F.col("start") < capacity)
        .select(
            "tenant_id", "start", F.least("wanted", F.lit(capacity) - F.col("start")).alias("size")
        )
    )


def dropped_tenants(reserved: DataFrame, total: int) -> DataFrame:
    """Reservations that got no partition at all."""
    fits = reservation_table(reserved, total)
    return reserved.select("tenant_id").join(fits, "tenant_id", "left_anti")


def _pool(explicit: DataFrame, total: int) -> tuple[Column, Column]:
    """Start and size of what reservations leave, as scalar subqueries."""
    taken = F.coalesce(explicit.agg(F.sum("size").alias("taken")).scalar(), F.lit(0).cast("bigint"))
    return taken, F.lit(max(total, 1)) - taken


def pool_ranges(
    arrivals: DataFrame, reserved: DataFrame, default_size: int, total: int
) -> DataFrame:
    """Ranges of unreserved tenants in order of ``arrivals(tenant_id, first_seen)``."""
    explicit = reservation_table(reserved, total)
    pool_start, pool_size = _pool(explicit, total)
    size = max(default_size, 1)
    # No more tenants than this can get a range, so the ordering below stays small.
    slots = -(-max(total, 1) // size)
    newcomers = (
        arrivals.join(explicit, "tenant_id", "left_anti")
        .orderBy("first_seen", "tenant_id")
        .limit(slots)
    )
    turn = F.row_number().over(Window.orderBy("first_seen", "tenant_id")) - 1
    offset = turn.cast("bigint") * size
    left = pool_size - F.col("offset")
    return newcomers.select("tenant_id", offset.alias("offset")).where(left > 0).select(
        "tenant_id",
        (pool_start + F.col("offset")).cast("bigint").alias("start"),
        F.least(F.lit(size), left).cast("bigint").alias("size"),
    )


def placement(
    arrivals: DataFrame, reserved: DataFrame, default_size: int, total: int
) -> DataFrame:
    """All ranges: ``tenant_id, start, size, kind``; at most ``total`` rows."""
    explicit = reservation_table(reserved, total).withColumn("kind", F.lit("reserved"))
    pool = pool_ranges(arrivals, reserved, default_size, total)
    return explicit.unionByName(pool.withColumn("kind", F.lit("pool")))


def partition_for(
    rows: DataFrame,
    arrivals: DataFrame,
    reserved: DataFrame,
    default_size: int,
    total: int,
    name: str = "partition",
) -> DataFrame:
    """Add the partition of every row; one map-side join, no shuffle of ``rows``."""
    pool_start, pool_size = _pool(reservation_table(reserved, total), total)
    ranges = placement(arrivals, reserved, default_size, total).select(
        "tenant_id", F.col("start").alias("_start"), F.col("size").alias("_size")
    )
    # With no pool at all everybody shares partition 0.
    in_pool = pool_start + fnv1a32(F.col("tenant_id")) % F.greatest(pool_size, F.lit(1))
    shared = F.when(pool_size > 0, in_pool).otherwise(F.lit(0).cast("bigint"))
    own = F.col("_start") + fnv1a32(F.col("instrument")) % F.col("_size")
    return (
        rows.join(F.broadcast(ranges), "tenant_id", "left")
        .withColumn(name, F.when(F.col("_start").isNotNull(), own).otherwise(shared))
        .drop("_start", "_size")
    )


def placement_moves(
    rows: DataFrame,
    arrivals: DataFrame,
    old: DataFrame,
    new: DataFrame,
    default_size: int,
    total: int,
) -> DataFrame:
    """Keys whose partition differs between two reservation maps, with their row counts.

    Rows are counted per key first, so the placement runs on the key dimension.
    """
    keys = rows.groupBy("tenant_id", "instrument").agg(F.count("*").alias("rows"))
    before = partition_for(keys, arrivals, old, default_size, total, "old_partition")
    after = partition_for(before, arrivals, new, default_size, total, "new_partition")
    return after.where(F.col("old_partition") != F.col("new_partition")).select(
        "tenant_id", "instrument", "old_partition", "new_partition", "rows"
    )


def owned_partitions(ranges: DataFrame) -> DataFrame:
    """One row per tenant and partition of its range."""
    return ranges.select(
        "tenant_id",
        F.explode(
            F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)
        ).alias("partition"),
    )


def assignment_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Partitions each tenant gains and loses between two tables of ranges."""
    before, after = owned_partitions(old), owned_partitions(new)
    return (
        after.exceptAll(before).withColumn("change", F.lit("added"))
        .unionByName(before.exceptAll(after).withColumn("change", F.lit("removed")))
    )


def partition_gauges(ranges: DataFrame) -> DataFrame:
    return ranges.select(
        "tenant_id", F.col("size").alias("partition_count"), F.col("start").alias("partition_start")
    )


def read_partition_map(texts: DataFrame, text: str = "value") -> DataFrame:
    """Rows ``tenant_id, start, count`` of maps ``{tenant: {start, count}}``; other columns stay."""
    others = [c for c in texts.columns if c != text]
    parsed = F.from_json(text, "map<string,struct<start int,count int>>")
    return texts.select(*others, F.explode(parsed).alias("tenant_id", "range")).select(
        *others, "tenant_id", F.col("range.start").alias("start"), F.col("range.count").alias("count")
    )


def valid_map_version(versions: DataFrame, text: str = "value") -> DataFrame:
    """Newest map the publisher can use, from ``versions(version, value)``.

    One entry below one partition spoils a whole version; a spoiled or
    unreadable version leaves the last good one in force.
    """
    parsed = F.from_json(text, "map<string,struct<start int,count int>>")
    flagged = versions.select("version", parsed.alias("ranges"))
    good = F.forall(
        F.map_values("ranges"), lambda r: F.coalesce(r["count"], F.lit(0)) >= 1
    )
    newest = (
        flagged.where(F.col("ranges").isNotNull() & good)
        .agg(F.max_by("ranges", "version").alias("ranges"), F.max("version").alias("version"))
    )
    return newest.select("version", F.explode("ranges").alias("tenant_id", "range")).select(
        "version", "tenant_id", F.col("range.count").cast("bigint").alias("size")
    )


def valid_tenant_ranges(versions: DataFrame, text: str = "value") -> DataFrame:
    """Newest usable range of every tenant, as its own consumer sees it.

    Only the tenant's own entry matters; a version without it, or with a count
    below one, is skipped for that tenant.
    """
    entries = read_partition_map(versions.select("version", text), text)
    usable = entries.where(F.col("count") >= 1)
    latest = F.max_by(F.struct("version", "start", "count"), "version")
    return usable.groupBy("tenant_id").agg(latest.alias("r")).select(
        "tenant_id", "r.version", F.coalesce("r.start", F.lit(0)).cast("bigint").alias("start"),
        F.col("r.count").cast("bigint").alias("size"),
    )
