"""The ledger as a stream: topic records in, ledger rows, state changes and dead letters out.

Every micro-batch writes one folder per output under its batch id. A batch that
is replayed after a failure overwrites its own folders and ignores what they
held, so nothing is applied twice and nothing is lost.

A record is decoded once: what was found is written to a folder that the next batch
overwrites, and every later step reads from it the columns it needs. Executors hold no
rows between steps. The text of a record goes on only if the record failed; de-duplication,
the ledger and the fold carry the decoded trade.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import dlq, validate, wac
from ledgerloom.schemas import DLQ, TRADE_EVENT, TRANSACTIONS
from ledgerloom.session import cut_lineage
from ledgerloom.sources import tables

# Every so many batches the state is written whole, and older changes are not read again.
SNAPSHOT_EVERY = 100
# So many refused trades are broadcast to find their records; beyond that the records are shuffled.
KNOWN_REFUSED = 100_000
PLACE = ["topic", "partition", "offset"]
TEXT = ["key", "value"]
EVENT = [f.split(" ")[0] for f in TRADE_EVENT.split(", ")]
WRITTEN = [f.split(" ")[0] for f in TRANSACTIONS.split(", ")]


@dataclass(frozen=True)
class Folders:
    """Output folders below one shared root."""

    root: str

    @property
    def ledger(self) -> str:
        return f"{self.root}/ledger"

    @property
    def state(self) -> str:
        return f"{self.root}/state"

    @property
    def letters(self) -> str:
        return f"{self.root}/letters"

    @property
    def marks(self) -> str:
        return f"{self.root}/marks"

    @property
    def checked(self) -> str:
        """The decoded records of the batch at work."""
        return f"{self.root}/checked"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def state_before(spark: SparkSession, folders: Folders, batch_id: int) -> DataFrame:
    """State after all earlier batches, read from the last whole snapshot on."""
    changes = tables.read_state_changes(spark, folders.state)
    base = (batch_id - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY
    recent = (F.col("batch") >= base) & (F.col("batch") < batch_id)
    return tables.latest_state(changes.where(recent))


def next_id(spark: SparkSession, folders: Folders, batch_id: int) -> int:
    """The first id after all earlier batches: a row per batch, of which the newest is read."""
    marks = tables.read_marks(spark, folders.marks).where(F.col("batch") < batch_id)
    newest = marks.where(F.col("batch") == batch_id - 1).first()
    if newest is None:
        newest = marks.orderBy(F.desc("batch")).first()
    return 0 if newest is None else newest["next_id"]


def _checked(batch: DataFrame, folders: Folders) -> DataFrame:
    """The decoded records of a batch, read from where they are written; of good ones without key and text."""
    decoded = validate.ledger_checks(validate.decode_wire(batch))
    failed = F.col("reason").isNotNull() | F.col("check_reason").isNotNull()
    decoded = decoded.select(
        *PLACE, *[F.when(failed, F.col(c)).alias(c) for c in TEXT], *EVENT, "reason", "check_reason"
    )
    decoded.write.mode("overwrite").parquet(folders.checked, compression=tables.COMPRESSION)
    return batch.sparkSession.read.schema(decoded.schema).parquet(folders.checked)


def _refused_letters(batch: DataFrame, numbered: DataFrame, refused: DataFrame, now: Column) -> DataFrame:
    """Letters of the trades that ``refused`` names by id, with key and text of their records."""
    refused = cut_lineage(refused)
    few = refused.count() <= KNOWN_REFUSED

    def side(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    places = numbered.select("id", *PLACE).distinct().join(side(refused), "id")
    records = batch.join(side(places.select(*PLACE)), PLACE, "left_semi")
    text = F.min(F.struct(*TEXT)).alias("text")
    found = records.groupBy(*PLACE).agg(text).select(*PLACE, "text.*")
    return dlq.route_reconcile_failures(places.join(found, PLACE), now)


def apply_batch(
    batch: DataFrame, batch_id: int, folders: Folders, segment_rows: int = wac.SEGMENT_ROWS,
    letter_sink: Callable[[DataFrame, int], None] | None = None,
) -> None:
    """Decode, check, append, fold and dead-letter one micro-batch.

    ``letter_sink`` is handed the letters as they were stored, and the batch id; a replayed batch hands them over again.
    """
    spark = batch.sparkSession
    now = F.current_timestamp()
    checked = _checked(batch, folders)
    good = checked.where("reason is null and check_reason is null").select(*PLACE, *EVENT)
    held = tables.read_transactions(spark, folders.ledger).where(F.col("batch") < batch_id)
    first_id = next_id(spark, folders, batch_id)
    fresh = tables.append_transactions(good, held, first_id, now, keep_place=False)
    tables.write_batch(fresh.select(*WRITTEN), folders.ledger, batch_id)
    appended = spark.read.parquet(f"{folders.ledger}/batch={batch_id}")
    highest = F.coalesce(F.max("id") + 1, F.lit(first_id)).cast("bigint").alias("next_id")
    tables.write_batch(appended.agg(highest), folders.marks, batch_id)

    state = state_before(spark, folders, batch_id)
    touched = state.join(appended.select(*wac.KEY).distinct(), wac.KEY, "left_semi")
    changes = wac.state_changes(appended, touched, segment_rows=segment_rows).withColumn(
        "updated_at", now
    )
    if batch_id % SNAPSHOT_EVERY == 0:
        none = F.lit(0).cast("bigint")
        rejected = changes.select(*wac.KEY, "rejected")
        changes = tables.upsert_state(state, changes).join(rejected, wac.KEY, "left")
        changes = changes.withColumn("rejected", F.coalesce("rejected", none))
    tables.write_batch(changes, folders.state, batch_id)

    letters = dlq.dead_letters(checked, now)
    written_state = spark.read.parquet(f"{folders.state}/batch={batch_id}")
    if not written_state.where("rejected > 0").isEmpty():
        refused = wac.wac_trace(appended, touched, segment_rows=segment_rows).where(
            "problem is not null"
        ).select("id", F.col("problem").alias("check_reason"))
        numbered = tables.assign_ids(good, first_id)
        letters = letters.unionByName(_refused_letters(batch, numbered, refused, now))
    tables.write_batch(letters, folders.letters, batch_id)
    if letter_sink is not None:
        letter_sink(spark.read.schema(DLQ).parquet(f"{folders.letters}/batch={batch_id}"), batch_id)


def start_ledger_stream(
    records: DataFrame, folders: Folders, trigger: dict | None = None,
    letter_sink: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Run ``apply_batch`` over a stream of topic records."""
    return (
        records.writeStream.foreachBatch(
            lambda batch, n: apply_batch(batch, n, folders, letter_sink=letter_sink)
        )
        .option("checkpointLocation", folders.checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_state(spark: SparkSession, folders: Folders) -> DataFrame:
    return tables.latest_state(tables.read_state_changes(spark, folders.state))
