import json
import random
from uuid import UUID

from pyspark.sql import functions as F

from ledgerloom.operators import wac
from ledgerloom.schemas import TOPIC_RECORD
from ledgerloom.sources import tables, topic
from ledgerloom.streaming import ledger as stream
from ledgerloom.streaming.wac import wac_stream

U = 10**8


def _records(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        tenant, instrument = f"t{rng.randrange(2)}", "AAPL"
        body = {
            "event_id": str(UUID(int=i if rng.random() < 0.8 else rng.randrange(n))), "tenant_id": tenant,
            "schema_version": 1, "instrument": instrument,
            "side": "HOLD" if i % 17 == 0 else rng.choice(["BUY", "SELL"]),
            "quantity": "x" if i % 13 == 0 else str(rng.randrange(1, 9)), "price": f"{rng.randrange(1, 999)}.5",
            "currency": "USD", "occurred_at": "2026-01-01T00:00:00Z",
        }
        out.append(("trades", 0, i, f"{tenant}:{instrument}", json.dumps(body), None))
    return out


def _run(spark, root, records, batches):
    folders = stream.Folders(root)
    edges = [len(records) * b // batches for b in range(batches + 1)]
    for n, (a, b) in enumerate(zip(edges, edges[1:])):
        stream.apply_batch(spark.createDataFrame(records[a:b], TOPIC_RECORD), n, folders)
    return folders


def _state(spark, folders):
    return {
        (r.tenant_id, r.instrument): (r.position, r.average_cost, r.realized_pnl)
        for r in stream.current_state(spark, folders).collect()
    }


def test_micro_batches_give_the_batch_result_and_replays_change_nothing(spark, tmp_path):
    records = _records(120)
    one = _run(spark, str(tmp_path / "one"), records, 1)
    many = _run(spark, str(tmp_path / "many"), records, 4)
    assert _state(spark, one) == _state(spark, many)
    stream.apply_batch(spark.createDataFrame(records[90:], TOPIC_RECORD), 3, many)
    assert _state(spark, one) == _state(spark, many)

    ledger = tables.read_transactions(spark, many.ledger)
    assert ledger.count() == ledger.select("event_id").distinct().count()
    whole = {(r.tenant_id, r.instrument): (r.position, r.average_cost, r.realized_pnl)
             for r in wac.wac_state(ledger).collect()}
    assert whole == _state(spark, many)

    letters = tables.read_letters(spark, many.letters)
    undecodable = letters.where("attempts = 1").count()
    refused = letters.where("attempts = 4").count()
    assert undecodable == sum(i % 13 == 0 for i in range(120))
    assert refused == sum(i % 17 == 0 and i % 13 != 0 for i in range(120))


def test_trade_that_cannot_be_applied_is_dead_lettered(spark, tmp_path):
    records = _records(3)
    body = json.loads(records[1][4]) | {"quantity": "9000000000", "price": "9000000000", "side": "BUY",
                                        "event_id": str(UUID(int=500))}
    records[1] = (*records[1][:4], json.dumps(body), None)
    folders = _run(spark, str(tmp_path / "p"), records, 1)
    reasons = [r.failure_reason for r in tables.read_letters(spark, folders.letters).collect()]
    assert "compute trade cost: product out of range" in reasons
    assert tables.read_transactions(spark, folders.ledger).where(
        F.col("event_id") == str(UUID(int=500))
    ).count() == 1


def test_keyed_stream_over_several_batches_and_restart(spark, tmp_path):
    rng = random.Random(3)
    schema = "id bigint, tenant_id string, instrument string, side string, quantity bigint, price bigint"
    rows = [(i, f"t{rng.randrange(3)}", "X", rng.choice(["BUY", "SELL"]), rng.randrange(1, 5 * U),
             rng.randrange(1, 100 * U)) for i in range(90)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def advance():
        trades = spark.readStream.schema(schema).options(**topic.bounded_poll(max_files=1)).parquet(source)
        query = (
            wac_stream(trades).writeStream.outputMode("update")
            .foreachBatch(lambda b, n: tables.write_batch(b, out, n))
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    for a in (0, 30, 60):
        spark.createDataFrame(rows[a:a + 30], schema).coalesce(1).write.mode("append").parquet(source)
        advance()
    # The last third once more: every trade is at or below its key's watermark.
    spark.createDataFrame(rows[60:], schema).coalesce(1).write.mode("append").parquet(source)
    advance()
    states = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    values = F.struct("position", "average_cost", "realized_pnl", "last_transaction_id")
    got = {r.tenant_id: tuple(r.s) for r in states.groupBy("tenant_id").agg(
        F.max_by(values, "last_transaction_id").alias("s")).collect()}
    batch = {r.tenant_id: (r.position, r.average_cost, r.realized_pnl, r.last_transaction_id)
             for r in wac.wac_state(spark.createDataFrame(rows, schema)).collect()}
    assert got == batch


def test_upsert_keeps_the_higher_watermark(spark):
    schema = "tenant_id string, instrument string, position bigint, average_cost bigint, realized_pnl bigint, last_transaction_id bigint, updated_at timestamp"
    old = spark.createDataFrame([("a", "X", 1, 0, 0, 5, None), ("b", "X", 1, 0, 0, None, None)], schema)
    new = spark.createDataFrame(
        [("a", "X", 2, 0, 0, 5, None), ("b", "X", 2, 0, 0, 1, None), ("c", "X", 2, 0, 0, 1, None)], schema
    )
    got = {r.tenant_id: r.position for r in tables.upsert_state(old, new).collect()}
    assert got == {"a": 1, "b": 2, "c": 2}


def test_partition_list():
    assert topic.partition_list("0, 1,2") == [0, 1, 2]
    assert topic.bounded_poll() == {}


def test_ids_go_on_at_high_batch_numbers(spark, tmp_path):
    records = _records(60)
    folders = stream.Folders(str(tmp_path / "late"))
    for n, (a, b) in zip(range(2**23, 2**23 + 4), ((0, 20), (20, 40), (40, 50), (50, 60))):
        stream.apply_batch(spark.createDataFrame(records[a:b], TOPIC_RECORD), n, folders)
    ids = [(r.batch, r.id) for r in tables.read_transactions(spark, folders.ledger).select("batch", "id").collect()]
    assert len({i for _, i in ids}) == len(ids)
    by_batch = sorted(ids)
    assert [i for _, i in by_batch] == sorted(i for _, i in ids)
    assert _state(spark, folders) == _state(spark, _run(spark, str(tmp_path / "one"), records, 1))


def test_late_calls_count(spark, tmp_path):
    from datetime import datetime, timedelta

    from ledgerloom.streaming import telemetry

    at = datetime(2026, 1, 5)
    calls = [(at + timedelta(days=d, minutes=m), "t", "success", 10 * m) for d, m in ((0, 1), (2, 5), (1, 7), (-3, 2), (0, 3))]
    schema = "ts timestamp, tenant_id string, outcome string, latency_us bigint"
    for n, call in enumerate(calls):
        tables.write_batch(telemetry.windowed_counts(spark.createDataFrame([call], schema)), str(tmp_path / "w"), n)
    parts = spark.read.option("basePath", str(tmp_path / "w")).parquet(f"{tmp_path}/w/batch=*")
    got = sorted(map(tuple, telemetry.added_windows(parts).select("window_start", "calls", "sum_us").collect()))
    whole = telemetry.windowed_counts(spark.createDataFrame(calls, schema))
    assert got == sorted(map(tuple, whole.select("window_start", "calls", "sum_us").collect()))
    assert sum(g[1] for g in got) == 5


def test_request_bodies_may_hold_line_breaks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":\n1}\n')
    assert [r.value for r in topic.read_rest_events(spark, str(tmp_path)).collect()] == ['{"a":\n1}\n']
    (tmp_path / "a.json").write_text('{"a":\n1}\x1e{"b":2}\x1e')
    rows = topic.read_rest_events(spark, str(tmp_path), separator="\x1e").collect()
    assert [r.value for r in rows] == ['{"a":\n1}', '{"b":2}']


def test_the_sink_is_handed_the_partition(spark):
    row = (str(UUID(int=1)), "t", 1, "AAPL", "BUY", U, U, "USD")
    schema = "event_id string, tenant_id string, schema_version smallint, instrument string, side string, quantity bigint, price bigint, currency string"
    trades = spark.createDataFrame([row], schema).withColumn("occurred_at", F.current_timestamp())
    assert topic.wire_records(trades).columns == ["key", "value"]
    placed = topic.wire_records(trades.withColumn("partition", F.lit(3).cast("bigint")))
    assert placed.dtypes[2] == ("partition", "int") and placed.first()["partition"] == 3
