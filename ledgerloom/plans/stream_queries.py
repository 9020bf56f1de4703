"""Queries that run as streams over the given tables, up to the data there is."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerloom.operators import dlq
from ledgerloom.plans import sqltext as S, views as V
from ledgerloom.plans.registry import query
from ledgerloom.session import shared_folder
from ledgerloom.sources import letters, tables, topic
from ledgerloom.streaming import ledger as ledger_stream, reload, telemetry, wac

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/streams/{uuid4().hex}"


def _finish(stream) -> None:
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


DELIVERIES = 3  # batches of the ledger stream; of all but the last, every fifth record comes again in the next


def _through_ledger(spark: SparkSession, sf: str) -> ledger_stream.Folders:
    """Publish all records as topic files, a range of offsets at a time, some of them twice, and run the
    ledger stream over each range from its checkpoint. Dead letters also go to the folder ``sent``."""
    folder = _run_folder(spark)
    folders = ledger_stream.Folders(folder)
    topic.publish_files(V.topic_records(spark, sf), f"{folder}/records")
    records = topic.read_trade_files(spark, f"{folder}/records", streaming=False)
    end = records.agg(F.max("offset")).first()[0] + 1
    delivery = F.expr(f"offset * {DELIVERIES} div {end}")
    for n in range(DELIVERIES):
        again = (delivery == n - 1) & (F.col("offset") % 5 == 0)
        topic.publish_files(records.where((delivery == n) | again), f"{folder}/topic")
        delivered = topic.read_trade_files(spark, f"{folder}/topic")
        _finish(
            ledger_stream.start_ledger_stream(
                delivered, folders,
                letter_sink=lambda found, batch: letters.write_letter_files(found, f"{folder}/sent", batch),
            )
        )
    return folders


@query(
    "ledger_stream",
    f"""with {S.APPLICABLE} {S.fold('ledger')}
    select tenant_id, instrument, cast(s.pos as bigint) as "position",
      cast(s.avg as bigint) as average_cost, cast(s.pnl as bigint) as realized_pnl from folded""",
)
def ledger_state(spark, sf) -> DataFrame:
    folders = _through_ledger(spark, sf)
    return ledger_stream.current_state(spark, folders).select(
        "tenant_id", "instrument", "position", "average_cost", "realized_pnl"
    )


@query(
    "read_trade_topic",
    f"""with {S.APPLICABLE} select event_id, tenant_id, instrument, side, quantity, price from ledger""",
)
def ledger_rows(spark, sf) -> DataFrame:
    """The ledger the stream has written."""
    folders = _through_ledger(spark, sf)
    return tables.read_transactions(spark, folders.ledger).select(
        "event_id", "tenant_id", "instrument", "side", "quantity", "price"
    )


@query(
    "dlq_stream",
    f"""with {S.APPLICABLE}, ends as (select max(id) + 1 as e from trades),
    counted as (select *, case when id % 5 = 0 and id * {DELIVERIES} // e < {DELIVERIES} - 1 then 2 else 1 end as times
      from decoded, ends)
    select split_part(key, ':', 1) as tenant_id, coalesce(reason, check_reason) as failure_reason,
      cast(sum(times) as bigint) as letters, cast(max(case when reason is null then 4 else 1 end) as bigint) as attempts
    from counted where reason is not null or check_reason is not null group by 1, 2""",
)
def dlq_letters(spark, sf) -> DataFrame:
    """What the stream sent to the dead-letter sink; a record that comes again and fails again is sent again."""
    folders = _through_ledger(spark, sf)
    return dlq.dlq_by_tenant(letters.read_letter_files(spark, f"{folders.root}/sent"))


def _ledger_files(spark: SparkSession, sf: str, folder: str, parts: int) -> DataFrame:
    V.trades(spark, sf).select("tenant_id", "instrument", "id", "side", "quantity", "price").write.parquet(
        f"{folder}/trades"
    )
    schema = "tenant_id string, instrument string, id bigint, side string, quantity bigint, price bigint"
    return spark.readStream.schema(schema).options(**topic.bounded_poll(max_files=parts)).parquet(
        f"{folder}/trades"
    )


@query(
    "wac_stream",
    f"with {S.TRADES} {S.fold('trades')} select {S.STATE_COLUMNS} from folded",
)
def wac_state_stream(spark, sf) -> DataFrame:
    folder = _run_folder(spark)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        states = wac.wac_stream(_ledger_files(spark, sf, folder, 0))
        _finish(
            states.writeStream.outputMode("update")
            .foreachBatch(lambda batch, n: tables.write_batch(batch, f"{folder}/states", n))
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    values = ["position", "average_cost", "realized_pnl", "last_transaction_id"]
    newest = F.max_by(F.struct(*values), "last_transaction_id")
    states = spark.read.option("basePath", f"{folder}/states").parquet(f"{folder}/states/batch=*")
    return states.groupBy("tenant_id", "instrument").agg(newest.alias("s")).select(
        "tenant_id", "instrument", "s.*"
    )


@query(
    "bounded_poll",
    f"""with {S.CALLS} select epoch_us(time_bucket(interval 1 hour, ts)) as window_start_us, tenant_id, outcome,
      count(*) as calls, cast(sum(latency_us) as bigint) as sum_us,
      count(*) filter (where latency_us <= 10000) as le_10000,
      count(*) filter (where latency_us <= 100000) as le_100000
    from call_log group by 1, 2, 3""",
)
def telemetry_stream(spark, sf) -> DataFrame:
    """Hourly call counts of a stream that takes one file per micro-batch.

    The files hold the calls in the order of a hash, so every batch brings late calls.
    """
    folder = _run_folder(spark)
    events = V.table(spark, sf, "events")
    events.repartitionByRange(4, F.xxhash64("event_id")).write.parquet(f"{folder}/events")
    polled = (
        spark.readStream.schema(events.schema)
        .options(**topic.bounded_poll(max_files=1))
        .parquet(f"{folder}/events")
    )

    def store(batch: DataFrame, n: int) -> None:
        tables.write_batch(telemetry.windowed_counts(batch, "1 hour"), f"{folder}/windows", n)

    _finish(
        V.calls_of(polled)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    parts = spark.read.option("basePath", f"{folder}/windows").parquet(f"{folder}/windows/batch=*")
    return telemetry.added_windows(parts).select(
        F.unix_micros("window_start").alias("window_start_us"), "tenant_id", "outcome", "calls",
        "sum_us", "le_10000", "le_100000",
    )


# --- partition maps read again --------------------------------------------------------------

RELOADS = 4  # batches: before any map, then three versions of which the second is spoiled
SPOILED = 2

_RELOADED = f"""daily as (
  select cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as bigint) as version,
    concat('tenant-', cast(o_custkey % 5 as varchar)) as tenant_id, count(*) % 7 as size
  from orders group by 1, 2),
versions as (select version, min(size) as least_size, {RELOADS} - row_number() over (order by version desc) as batch
  from daily group by version),
polls as (
  select b.batch, v.version as polled, v.version is not null and v.least_size >= 1 and b.batch <> {SPOILED} as good
  from (select unnest(range({RELOADS})) as batch) b left join versions v on v.batch = b.batch and v.batch >= 1),
in_force as (
  select p.batch, p.polled, p.good, (select max(g.polled) from polls g where g.good and g.batch <= p.batch) as version
  from polls p)"""


def _reloaded(spark: SparkSession, sf: str) -> reload.Folders:
    """Place trades in batches by their id; a new map is published before every batch but the first."""
    folder = _run_folder(spark)
    folders = reload.Folders(folder)
    schema = "tenant_id string, instrument string, id bigint"
    # Written once, by batch, so that a batch reads its own rows only.
    batch_of = (F.col("id") % RELOADS).alias("batch")
    V.trades(spark, sf).select("tenant_id", "instrument", "id", batch_of).write.partitionBy("batch").parquet(
        f"{folder}/trades_by_batch"
    )
    trades = spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/trades_by_batch")
    newest = V.map_versions(spark, sf).orderBy(F.desc("version")).limit(RELOADS - 1)
    turn = F.row_number().over(Window.orderBy("version"))
    text = F.when(turn == SPOILED, F.regexp_replace("value", r"\}", "")).otherwise(F.col("value"))
    # The few versions that this run publishes.
    published = newest.select("version", text.alias("value"), turn.alias("batch")).collect()

    def versions() -> DataFrame:
        return spark.read.schema("version bigint, value string").parquet(f"{folder}/maps")

    for n in range(RELOADS):
        for row in published:
            if row["batch"] == n:
                one = spark.createDataFrame([(row["version"], row["value"])], "version bigint, value string")
                one.coalesce(1).write.mode("append").parquet(f"{folder}/maps")
        trades.where(F.col("batch") == n).select("tenant_id", "instrument", "id").write.mode("append").parquet(f"{folder}/trades")
        source = spark.readStream.schema(schema).parquet(f"{folder}/trades")
        _finish(reload.start_placing(source, versions, folders, V.DEFAULT_PARTITIONS, V.TOTAL_PARTITIONS))
    return folders


@query(
    "map_reload",
    f"""with {S.TRADES}, {_RELOADED},
    wanted as (
      select f.batch, d.tenant_id, d.size, sum(d.size) over (partition by f.batch order by d.tenant_id) - d.size as start
      from in_force f join daily d on d.version = f.version),
    own as (
      select batch, tenant_id, start, least(size, {V.TOTAL_PARTITIONS} - 1 - start) as size from wanted
      where start < {V.TOTAL_PARTITIONS} - 1),
    pool as (
      select f.batch, f.version, coalesce(sum(o.size), 0) as taken from in_force f left join own o on o.batch = f.batch
      group by 1, 2)
    select p.batch, p.version, cast(case when o.start is not null then o.start + {S.fnv("t.instrument")} % o.size
        else p.taken + {S.fnv("t.tenant_id")} % ({V.TOTAL_PARTITIONS} - p.taken) end as bigint) as "partition",
      count(*) as trades
    from trades t join pool p on p.batch = t.id % {RELOADS} left join own o on o.batch = p.batch and o.tenant_id = t.tenant_id
    group by 1, 2, 3""",
)
def map_reload(spark, sf) -> DataFrame:
    """Trades per batch and partition, placed by the map that was in force for the batch."""
    folders = _reloaded(spark, sf)
    placed = reload.read_placed(spark, folders, "tenant_id string, instrument string, id bigint, partition bigint")
    polls = reload.read_polls(spark, folders).select("batch", "version")
    return placed.groupBy("batch", "partition").agg(F.count("*").alias("trades")).join(polls, "batch").select(
        "batch", "version", "partition", "trades"
    )


@query(
    "map_reload_errors",
    f"""with {_RELOADED} select batch, polled, version,
      cast(sum(case when good then 0 else 1 end) over (order by batch) as bigint) as reload_errors from in_force""",
)
def map_reload_errors(spark, sf) -> DataFrame:
    return reload.read_polls(spark, _reloaded(spark, sf)).select("batch", "polled", "version", "reload_errors")
