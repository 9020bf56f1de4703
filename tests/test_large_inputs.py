"""Work that must not be done twice, or in few tasks, however large the tables are."""

import json
from datetime import datetime
from uuid import UUID

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import jsonfields
from ledgerloom.operators import validate, wac
from ledgerloom.plans import ledger_queries, stream_queries, views
from ledgerloom.schemas import TOPIC_RECORD
from ledgerloom.sources import tables
from ledgerloom.streaming import ledger

LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_returnflag string, l_shipdate timestamp"
)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def lines(spark, tmp_path):
    rows = [
        (i, i % 9, i % 7, 1 + i % 3, 1.0 + i % 5, 10.0 + i, "RN"[i % 2], datetime(1997, 1, 1 + i % 28))
        for i in range(200)
    ]
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_ids_are_assigned_without_gathering_a_partition(spark):
    rows = [("t", i % 2, 10 + i, f"e{i}") for i in range(40)]
    records = spark.createDataFrame(rows, "topic string, partition int, offset bigint, event_id string")
    numbered = tables.assign_ids(records, 1)
    assert "strategy=broadcast" in _plan(numbered)
    assert len({r.id for r in numbered.collect()}) == 40


def test_bodies_are_checked_once_for_both_sides(spark, lines):
    found = ledger_queries.split_valid(spark, lines)
    assert "from_json" not in _plan(found)
    counted = {o: sum(r.events for r in found.collect() if r.outcome == o) for o in ("accepted", "rejected")}
    assert sum(counted.values()) == 200 and counted["rejected"] > 0


def test_trades_of_the_reload_are_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def trades(session, _):
        def row(i):
            made.add(1)
            return f"tenant-{i % 5}", f"P{i % 3}", i

        numbers = session.sparkContext.parallelize(range(40), 2)
        return session.createDataFrame(numbers.map(row), "tenant_id string, instrument string, id bigint")

    def versions(session, _):
        text = '{"tenant-1":{"start":0,"count":2}}'
        return session.createDataFrame([(v, text) for v in (1, 2, 3)], "version bigint, value string")

    monkeypatch.setattr(views, "trades", trades)
    monkeypatch.setattr(views, "map_versions", versions)
    placed = stream_queries.map_reload(spark, "unused")
    assert sum(r.trades for r in placed.collect()) == 40
    assert made.value == 40


def test_entries_of_an_object_are_searched_once_for_all_fields(spark):
    texts = ['{"Side":"BUY"}', '{"side":5}', '{"side":"BUY","SIDE":"SELL"}', '{"side":null,"schema_version":2}', "null", "[", None]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    read = jsonfields._read_any(F.col("value"), validate.STRING_FIELDS, ["schema_version"])
    read = df.select(read.alias("r")).select("r.json_problem", "r.side", "r.schema_version", "r.price")
    assert _plan(read).count("filter(") <= 2 * 4
    assert [tuple(r) for r in read.collect()] == [
        (None, "BUY", None, ""), ("malformed", "5", None, ""), ("malformed", "SELL", None, ""), (None, "", 2, ""),
        (None, "", None, ""), ("malformed", "", None, ""), ("malformed", "", None, ""),
    ]


def test_a_batch_is_not_held_by_executors_and_its_texts_stay_out_of_the_ledger(spark, tmp_path):
    body = {
        "tenant_id": "t", "schema_version": 1, "instrument": "AAPL", "side": "BUY", "currency": "USD",
        "quantity": "1", "price": "2", "occurred_at": "2026-01-01T00:00:00Z",
    }
    wrong = [{}, {"quantity": "x"}, {"side": "HOLD"}, {"quantity": "9000000000", "price": "9000000000"}]
    records = [
        ("trades", 0, i, f"t:{i}", json.dumps(body | {"event_id": str(UUID(int=i))} | other), None)
        for i, other in enumerate(wrong)
    ]
    # The record that the fold refuses comes twice.
    records.append(records[-1])
    folders, held = ledger.Folders(str(tmp_path)), []

    def sink(letters, _):
        held.append(len(spark.sparkContext._jsc.getPersistentRDDs()))

    batch = spark.createDataFrame(records, TOPIC_RECORD)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    ledger.apply_batch(batch, 0, folders, letter_sink=sink)
    assert held == [before]
    assert not {"key", "value"} & set(spark.read.parquet(f"{folders.ledger}/batch=0").columns)
    found = tables.read_letters(spark, folders.letters).collect()
    assert sorted((r.original_offset, r.key, r.payload, r.attempts) for r in found) == [
        (i, records[i][3], records[i][4], 1 if i == 1 else 4) for i in (1, 2, 3)
    ]
    assert tables.read_transactions(spark, folders.ledger).count() == 2


@pytest.mark.parametrize("block_rows", [10**6, 60])
def test_trades_of_long_keys_are_made_once_and_shuffled_once(spark, monkeypatch, block_rows):
    made = spark.sparkContext.accumulator(0)

    def row(i):
        made.add(1)
        return "t", f"P{i % 7 % 2}", i, "BUY" if i % 3 else "SELL", 10**8 * (1 + i % 5), 10**8 * (1 + i % 11)

    schema = "tenant_id string, instrument string, id bigint, side string, quantity bigint, price bigint"
    monkeypatch.setattr(wac, "BLOCK_ROWS", block_rows)
    sizing = spark.createDataFrame([("t", f"P{i % 7 % 2}") for i in range(300)], schema.split(", id")[0])
    trades = spark.createDataFrame(spark.sparkContext.parallelize(range(300), 2).map(row), schema)
    traced = wac.wac_trace(trades, sizing=sizing, segment_rows=8)
    if block_rows > 300:
        # One for the usual keys, one for the long ones.
        assert _plan(traced).count("RepartitionByExpression") == 2
    found = sorted(map(tuple, traced.drop("opened").collect()))
    assert made.value == 300
    whole = wac.wac_trace(trades).drop("opened")
    assert found == sorted(map(tuple, whole.collect()))
