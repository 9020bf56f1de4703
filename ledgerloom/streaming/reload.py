"""Tenant reservations that a stream reads again in every micro-batch.

A micro-batch is a poll: it takes the newest published version of the partition map. A version that cannot be
used (nothing published, an unreadable source, text that is no map, an entry below one partition) leaves the last good
one in force and counts as an error, so a bad write never drops a tenant's own partitions.

What a batch had in force is stored under its batch id before any row is placed. A replayed batch reads that again, so
its rows go where they went the first time, whatever was published since; the next batch goes on from there, also
after a restart. A map has an entry per tenant with partitions of its own, no more than the topic has partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ledgerloom.operators import placement
from ledgerloom.sources import tables

POLLS = "polled bigint, version bigint, ranges map<string,bigint>, problem string"
NO_VERSION, NO_MAP, TOO_FEW = "no version", "not a map", "a tenant with less than one partition"


@dataclass(frozen=True)
class Folders:
    """Outputs of a stream that reloads, below one shared root."""

    root: str

    @property
    def polls(self) -> str:
        return f"{self.root}/polls"

    @property
    def placed(self) -> str:
        return f"{self.root}/placed"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def newest_map(versions: DataFrame) -> DataFrame:
    """One row for the newest of ``versions(version, value)``: its ``ranges``, or the ``problem`` it has."""
    newest = versions.where("version is not null").agg(F.max_by(F.struct("version", "value"), "version").alias("m"))
    parsed = F.when(F.trim("m.value") == "null", F.create_map().cast("map<string,struct<count:int>>")).otherwise(
        F.from_json("m.value", "map<string,struct<count int>>")
    )
    sizes = F.transform_values("parsed", lambda _, r: F.coalesce(r["count"], F.lit(0)).cast("bigint"))
    problem = (
        F.when(F.col("m").isNull(), NO_VERSION)
        .when(F.col("parsed").isNull(), NO_MAP)
        .when(F.exists(F.map_values("ranges"), lambda n: n < 1), TOO_FEW)
    )
    return (
        newest.withColumn("parsed", parsed)
        .withColumn("ranges", sizes)
        .select(F.col("m.version").alias("polled"), "ranges", problem.alias("problem"))
    )


def _stored(spark: SparkSession, folders: Folders, batch_id: int) -> DataFrame | None:
    """What a batch had in force; none if it has not got so far."""
    try:
        return spark.read.schema(POLLS).parquet(f"{folders.polls}/batch={batch_id}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def poll(
    spark: SparkSession, read_versions: Callable[[], DataFrame], folders: Folders, batch_id: int
) -> DataFrame:
    """One row: what this batch polled and what is in force for it; read again if the batch is a replay."""
    # A write that was cut off leaves a folder without the row.
    done = _stored(spark, folders, batch_id)
    if done is not None and not done.isEmpty():
        return done
    before = None if batch_id == 0 else _stored(spark, folders, batch_id - 1)
    kept = None if before is None else before.first()
    try:
        found = newest_map(read_versions()).first()
        polled, ranges, problem = found["polled"], found["ranges"], found["problem"]
    except PySparkException as unreadable:
        polled, ranges, problem = None, None, unreadable.getCondition() or type(unreadable).__name__
    version = polled
    if problem is not None:
        version, ranges = (kept["version"], kept["ranges"]) if kept is not None else (None, {})
    row = spark.createDataFrame([(polled, version, ranges, problem)], POLLS)
    tables.write_batch(row.coalesce(1), folders.polls, batch_id)
    return _stored(spark, folders, batch_id)


def reservations(polled: DataFrame) -> DataFrame:
    """``tenant_id`` and ``size`` of the map in force."""
    return polled.select(F.explode("ranges").alias("tenant_id", "size"))


def place_batch(
    batch: DataFrame, batch_id: int, read_versions: Callable[[], DataFrame], folders: Folders, default_size: int,
    total: int,
) -> None:
    """Write the rows of a batch with their partition under the map in force."""
    spark = batch.sparkSession
    polled = poll(spark, read_versions, folders, batch_id)
    # Tenants without a reservation share the pool.
    newcomers = spark.createDataFrame([], "tenant_id string, first_seen bigint")
    placed = placement.partition_for(batch, newcomers, reservations(polled), default_size, total)
    tables.write_batch(placed, folders.placed, batch_id)


def start_placing(
    rows: DataFrame, read_versions: Callable[[], DataFrame], folders: Folders, default_size: int, total: int,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run ``place_batch`` over a stream with ``tenant_id`` and ``instrument``."""
    return (
        rows.writeStream.foreachBatch(
            lambda batch, n: place_batch(batch, n, read_versions, folders, default_size, total)
        )
        .option("checkpointLocation", folders.checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_polls(spark: SparkSession, folders: Folders) -> DataFrame:
    """A row per batch, with the errors counted up to it."""
    from pyspark.sql import Window

    polls = spark.read.schema(f"{POLLS}, batch bigint").option("basePath", folders.polls).parquet(
        f"{folders.polls}/batch=*"
    )
    # One row per micro-batch.
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    return polls.withColumn("reload_errors", F.sum(F.col("problem").isNotNull().cast("bigint")).over(upto))


def read_placed(spark: SparkSession, folders: Folders, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", folders.placed).parquet(
        f"{folders.placed}/batch=*"
    )
