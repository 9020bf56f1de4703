"""The ledger and the state as Parquet folders.

Parquet tables take no ``MERGE``. The ledger is one folder per batch, rewritten
whole when a batch is replayed. The state is a folder of changes per batch; the
current state is each key's change with the highest watermark, and
``compact_state`` writes it to a new folder. Where the session's table format supports it,
``merge_state`` runs the same rule as a merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.utils import AnalysisException

from ledgerloom.operators.dedupe import new_events
from ledgerloom.schemas import DLQ, RECONCILED_STATE, TRANSACTIONS

COMPRESSION = "zstd"  # ledger, letters and topic files hold long JSON texts
KEY = ["tenant_id", "instrument"]
VALUES = ["position", "average_cost", "realized_pnl", "last_transaction_id", "updated_at"]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    schema = f"{schema}, batch bigint"
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, TRANSACTIONS)


def read_state_changes(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, RECONCILED_STATE)


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """The first free id after every batch."""
    return _read(spark, path, "next_id bigint")


def read_letters(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, DLQ)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Replace one batch's folder, so a replayed batch leaves no second copy."""
    rows.drop("batch").write.mode("overwrite").parquet(f"{path}/batch={batch_id}", compression=COMPRESSION)


def assign_ids(records: DataFrame, first_id: int) -> DataFrame:
    """Ledger ids in arrival order per partition, starting at ``first_id``.

    Every partition gets a block of ids as wide as its span of offsets, so a
    row's id is its block plus its offset: unique, rising along each partition,
    with gaps, and without sorting the rows. Blocks are one row per partition, so they
    are broadcast: by their partition, the rows would meet in as few tasks.
    """
    spans = records.groupBy("topic", "partition").agg(
        F.min("offset").alias("_low"), (F.max("offset") - F.min("offset") + 1).alias("_span")
    )
    earlier = Window.orderBy("topic", "partition").rowsBetween(Window.unboundedPreceding, -1)
    block = F.lit(first_id) + F.coalesce(F.sum("_span").over(earlier), F.lit(0))
    blocks = spans.withColumn("_block", block).drop("_span")
    return (
        records.join(F.broadcast(blocks), ["topic", "partition"])
        .withColumn("id", F.col("_block") + F.col("offset") - F.col("_low"))
        .drop("_block", "_low")
    )


def append_transactions(
    batch: DataFrame, ledger: DataFrame, first_id: int, received_at, keep_place: bool = True
) -> DataFrame:
    """Ledger rows of the events the ledger does not hold yet, ids assigned in arrival order.

    Without ``keep_place`` topic, partition and offset, for which the id stands, go no further.
    """
    numbered = assign_ids(batch, first_id)
    if not keep_place:
        numbered = numbered.drop("topic", "partition", "offset")
    fresh = new_events(numbered, ledger, ["id"])
    return fresh.withColumn("received_at", received_at)


def latest_state(changes: DataFrame) -> DataFrame:
    """Current state: the change with the highest watermark per key, combined before the shuffle."""
    newest = F.max_by(F.struct(*VALUES), F.coalesce("last_transaction_id", F.lit(-1)))
    return changes.groupBy(*KEY).agg(newest.alias("s")).select(*KEY, "s.*")


def upsert_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State after a compare-and-swap: a change counts only where it advances the watermark."""
    mark = F.coalesce(F.col("last_transaction_id"), F.lit(-1))
    both = state.select(*KEY, *VALUES).withColumn("_new", F.lit(0)).unionByName(
        changes.select(*KEY, *VALUES).withColumn("_new", F.lit(1))
    )
    # On equal watermarks the stored row stays.
    newest = F.max_by(F.struct(*VALUES), F.struct(mark, -F.col("_new")))
    return both.groupBy(*KEY).agg(newest.alias("s")).select(*KEY, "s.*")


def merge_state(spark: SparkSession, table: str, changes: DataFrame) -> None:
    """The same rule as a merge, for table formats that support one."""
    changes.alias("c").mergeInto(
        table,
        F.expr(f"c.tenant_id = {table}.tenant_id and c.instrument = {table}.instrument"),
    ).whenMatched(
        F.expr(
            f"{table}.last_transaction_id is null "
            f"or {table}.last_transaction_id < c.last_transaction_id"
        )
    ).updateAll().whenNotMatched().insertAll().merge()


def compact_state(spark: SparkSession, path: str, target: str) -> None:
    """Write the current state as the first batch of a new folder."""
    write_batch(latest_state(read_state_changes(spark, path)), target, 0)
