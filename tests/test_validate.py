import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import validate as V

GOOD = {
    "event_id": "f47ac10b-58cc-0372-8567-0e02b2c3d479", "tenant_id": "tenant-a", "instrument": "AAPL",
    "side": "BUY", "quantity": "10", "price": "150.25", "currency": "USD",
    "occurred_at": "2026-08-03T10:00:00Z",
}


def _with(**changes):
    return json.dumps(GOOD | changes)


CASES = [
    (json.dumps(GOOD), None), (_with(instrument="BRK.B"), None), (_with(quantity="1e2"), None),
    (_with(quantity="10000000000"), None), (json.dumps(GOOD) + " \n\t", None),
    ("{not json", V.INVALID_BODY), (json.dumps(GOOD) + "garbage", V.TRAILING_DATA),
    (_with(currency="U" * 4200), V.INVALID_BODY), (_with(side=""), V.MISSING_FIELDS),
    (json.dumps({k: v for k, v in GOOD.items() if k != "price"}), V.MISSING_FIELDS),
    (_with(event_id="nope"), V.BAD_EVENT_ID), (_with(tenant_id="Tenant"), V.BAD_TENANT),
    (_with(tenant_id="a_b"), V.BAD_TENANT), (_with(tenant_id="a" * 65), V.BAD_TENANT),
    (_with(instrument="aapl"), V.BAD_INSTRUMENT), (_with(instrument="A$"), V.BAD_INSTRUMENT),
    (_with(instrument="A" * 17), V.BAD_INSTRUMENT), (_with(side="HOLD"), V.BAD_SIDE),
    (_with(side="buy"), V.BAD_SIDE), (_with(quantity="ten"), V.BAD_QUANTITY),
    (_with(quantity="0"), V.BAD_QUANTITY), (_with(quantity="-5"), V.BAD_QUANTITY),
    (_with(quantity="1e400"), V.BAD_QUANTITY), (_with(quantity="10000000001"), V.BAD_QUANTITY),
    (_with(price="0"), V.BAD_PRICE), (_with(price="-1.50"), V.BAD_PRICE),
    (_with(currency="usd"), V.BAD_CURRENCY), (_with(currency="US"), V.BAD_CURRENCY),
    (_with(currency="US1"), V.BAD_CURRENCY), (_with(occurred_at="2026-08-03"), V.BAD_OCCURRED_AT),
    (_with(quantity="0", price="0", side="HOLD"), V.BAD_SIDE),
]


def test_rest_rules(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, value string")
    got = {r.i: r.error for r in V.validate_rest(rows).collect()}
    assert got == {i: e for i, (_, e) in enumerate(CASES)}


def test_split_keeps_every_row(spark):
    rows = V.validate_rest(spark.createDataFrame([(t,) for t, _ in CASES], "value string"))
    accepted, rejected = V.split_valid(rows)
    assert (accepted.count(), rejected.count()) == (5, len(CASES) - 5)


@pytest.mark.parametrize(
    "changes,reason",
    [
        ({}, None), ({"tenant_id": ""}, None), ({"side": "HOLD"}, None),
        ({"event_id": "x"}, V.BAD_WIRE_ID), ({"schema_version": 40000}, V.BAD_PAYLOAD),
        ({"schema_version": "1"}, V.BAD_PAYLOAD), ({"quantity": 5}, V.BAD_PAYLOAD),
        ({"quantity": "x"}, V.BAD_WIRE_QUANTITY + '"x" is not a valid decimal number'),
        ({"price": ""}, V.BAD_WIRE_PRICE + "must not be empty"),
        ({"occurred_at": "2026-01-02"}, V.BAD_WIRE_TIME),
        ({"quantity": "x", "price": "x"}, V.BAD_WIRE_QUANTITY + '"x" is not a valid decimal number'),
    ],
)
def test_decode_order(spark, changes, reason):
    text = json.dumps(GOOD | {"schema_version": 1} | changes)
    row = V.decode_wire(spark.createDataFrame([(text,)], "value string")).first()
    assert row.reason == reason
    if reason is None:
        assert (row.quantity, row.price) == (1000000000, 15025000000)


def test_ledger_checks(spark):
    rows = spark.createDataFrame(
        [("BUY", 1, 1, "USD"), ("HOLD", 1, 1, "USD"), ("BUY", 0, 1, "USD"), ("BUY", -5, 1, "USD"),
         ("BUY", 1, 0, "USD"), ("BUY", 1, 1, "USDX")],
        "side string, quantity bigint, price bigint, currency string",
    )
    got = [r.check_reason for r in V.ledger_checks(rows).collect()]
    assert got == [None, V.SIDE_CHECK, V.QUANTITY_CHECK, V.QUANTITY_CHECK, V.PRICE_CHECK, V.TOO_LONG_CURRENCY]


def test_rescale_round_trip(spark):
    rows = spark.createDataFrame([("50000000000.12345678",), ("99999999999.5",)], "t string").select(
        F.col("t").cast("decimal(20,8)").alias("v")
    )
    assert V.rescale_audit(rows, ["v"]).count() == 1
    up = V.rescale_up(rows, ["v"])
    assert [r.v for r in up.collect()] == [5000000000012345678, None]
    assert str(V.rescale_down(up, ["v"]).first().v) == "50000000000.12345678"


@pytest.mark.parametrize("members", [9, 16, 17, 40])
@pytest.mark.parametrize("note", ["plain", "a\\nb"])
def test_of_a_repeated_key_the_last_value_counts(spark, members, note):
    """However many members a body has, and whether or not one of them holds an escape."""
    body = json.dumps(GOOD)[1:-1]
    more = "".join(f',"x{"abcdefghijklmnopqrstuvwxyz"[i % 26]}{"yz"[i // 26]}":"{note}"' for i in range(members - 9))
    known = f'{{"side":"HOLD",{body}{more},"note":"{note}"}}'
    unknown = f'{{"note":"{note}",{body}{more},"note":"other"}}'
    last_is_wrong = f'{{{body}{more},"note":"{note}","side":"HOLD"}}'
    rows = spark.createDataFrame([(0, known), (1, unknown), (2, last_is_wrong)], "id bigint, value string")
    got = {r["id"]: r["error"] for r in V.validate_rest(rows).collect()}
    assert got == {0: None, 1: None, 2: V.BAD_SIDE}
