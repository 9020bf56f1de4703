"""First failing rule per row, in rule order; a reject is a row, never an exception."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.binding import evaluated
from ledgerloom.functions.amounts import amount_problem, in_bounds, parse_amount
from ledgerloom.functions.jsonfields import MAX_BODY_BYTES, read_object
from ledgerloom.functions.text import (
    canonical_uuid,
    is_valid_currency,
    is_valid_event_id,
    is_valid_instrument,
    is_valid_tenant_id,
    parse_rfc3339,
    side_from_code,
)

STRING_FIELDS = [
    "event_id", "tenant_id", "instrument", "side", "quantity", "price", "currency", "occurred_at",
]
SCHEMA_VERSION = 1

# The messages a rejected request is answered with.
INVALID_BODY = "invalid request body"
TRAILING_DATA = "invalid request body: trailing data"
EVENT_REQUIRED = "event is required"
MISSING_FIELDS = "missing required fields"
BAD_EVENT_ID = "event_id must be a valid UUID"
BAD_TENANT = "tenant_id must be 1-64 lowercase letters, digits, or hyphens"
BAD_INSTRUMENT = "instrument must be 1-16 uppercase letters, digits, or dots"
BAD_SIDE = 'side must be "BUY" or "SELL"'
BAD_SIDE_CODE = "side must be SIDE_BUY or SIDE_SELL"
BAD_QUANTITY = "quantity must be a positive decimal number no greater than 10000000000.00000000"
BAD_PRICE = "price must be a positive decimal number no greater than 10000000000.00000000"
BAD_CURRENCY = "currency must be a 3-letter uppercase ISO 4217 code"
BAD_OCCURRED_AT = "occurred_at must be an RFC3339 timestamp"
BAD_TIMESTAMP = "occurred_at must be a valid timestamp"

# What a topic record that cannot be decoded is dead-lettered with.
DECODE = "decode transaction event: "
BAD_PAYLOAD = DECODE + "unmarshal payload"
BAD_WIRE_ID = DECODE + "parse event id"
BAD_WIRE_QUANTITY = DECODE + "parse quantity: amount "
BAD_WIRE_PRICE = DECODE + "parse price: amount "
BAD_WIRE_TIME = DECODE + "parse occurred_at"

# Names of the ledger's column checks.
LEDGER_CHECK = "reconcile: insert transaction: "
TOO_LONG_CURRENCY = LEDGER_CHECK + "value too long for type character(3)"
PRICE_CHECK = LEDGER_CHECK + "transactions_price_check"
QUANTITY_CHECK = LEDGER_CHECK + "transactions_quantity_check"
SIDE_CHECK = LEDGER_CHECK + "transactions_side_check"


def _any_empty(names: list[str]) -> Column:
    empty = F.lit(False)
    for n in names:
        empty = empty | (F.col(n) == "")
    return empty


def validate_rest(bodies: DataFrame, text: str = "value") -> DataFrame:
    """Request bodies to typed events; ``error`` holds the first failing rule or NULL."""
    rows = evaluated(
        read_object(bodies, text, STRING_FIELDS),
        {
            "_quantity": parse_amount(F.col("quantity")),
            "_price": parse_amount(F.col("price")),
            "_at": parse_rfc3339(F.col("occurred_at")),
        },
    )
    error = (
        F.when(
            F.coalesce(F.octet_length(text) > MAX_BODY_BYTES, F.lit(True))
            | F.coalesce(F.col("json_problem") == "malformed", F.lit(False)),
            INVALID_BODY,
        )
        .when(F.col("json_problem") == "trailing", TRAILING_DATA)
        .when(_any_empty(STRING_FIELDS), MISSING_FIELDS)
        .when(~is_valid_event_id(F.col("event_id")), BAD_EVENT_ID)
        .when(~is_valid_tenant_id(F.col("tenant_id")), BAD_TENANT)
        .when(~is_valid_instrument(F.col("instrument")), BAD_INSTRUMENT)
        .when(~F.col("side").isin("BUY", "SELL"), BAD_SIDE)
        .when(~in_bounds(F.col("_quantity")), BAD_QUANTITY)
        .when(~in_bounds(F.col("_price")), BAD_PRICE)
        .when(~is_valid_currency(F.col("currency")), BAD_CURRENCY)
        .when(F.col("_at").isNull(), BAD_OCCURRED_AT)
    )
    return (
        evaluated(rows, {"error": error})
        .withColumns(
            {
                "event_id": F.when(F.col("error").isNull(), canonical_uuid(F.col("event_id")))
                .otherwise(F.col("event_id")),
                "schema_version": F.lit(SCHEMA_VERSION).cast("smallint"),
                "quantity": F.col("_quantity"),
                "price": F.col("_price"),
                "occurred_at": F.col("_at"),
            }
        )
        .drop("json_problem", "_quantity", "_price", "_at")
    )


def validate_typed(events: DataFrame) -> DataFrame:
    """Typed events (amounts already scaled, side as a code); same rules, same order."""
    required = ["event_id", "tenant_id", "instrument", "currency"]
    absent = F.lit(True)
    for c in events.columns:
        absent = absent & F.col(c).isNull()
    rows = events.withColumn("_absent", absent).withColumns(
        {c: F.coalesce(c, F.lit("")) for c in required}
    )
    side = side_from_code(F.col("side"))
    error = (
        F.when(F.col("_absent"), EVENT_REQUIRED)
        .when(_any_empty(required) | F.col("occurred_at").isNull(), MISSING_FIELDS)
        .when(~is_valid_event_id(F.col("event_id")), BAD_EVENT_ID)
        .when(~is_valid_tenant_id(F.col("tenant_id")), BAD_TENANT)
        .when(~is_valid_instrument(F.col("instrument")), BAD_INSTRUMENT)
        .when(side.isNull(), BAD_SIDE_CODE)
        .when(~in_bounds(F.col("quantity")), BAD_QUANTITY)
        .when(~in_bounds(F.col("price")), BAD_PRICE)
        .when(~is_valid_currency(F.col("currency")), BAD_CURRENCY)
        .when(~F.year("occurred_at").between(1, 9999), BAD_TIMESTAMP)
    )
    return (
        evaluated(rows, {"error": error, "side": side})
        .withColumns(
            {
                "event_id": F.when(F.col("error").isNull(), canonical_uuid(F.col("event_id")))
                .otherwise(F.col("event_id")),
                "schema_version": F.lit(SCHEMA_VERSION).cast("smallint"),
            }
        )
        .drop("_absent")
    )


def decode_wire(records: DataFrame, text: str = "value") -> DataFrame:
    """Topic payloads to trades; ``reason`` holds why a payload cannot be decoded, or NULL.

    Tenant, instrument, side and currency are left to ``ledger_checks``.
    """
    rows = evaluated(
        read_object(records, text, STRING_FIELDS, ["schema_version"]),
        {
            "_quantity": parse_amount(F.col("quantity")),
            "_price": parse_amount(F.col("price")),
            "_at": parse_rfc3339(F.col("occurred_at")),
            "schema_version": F.coalesce("schema_version", F.lit(0).cast("bigint")),
        },
    )

    def amount_reason(prefix: str, name: str, value: str) -> Column:
        problem = amount_problem(F.col(name), F.col(value))
        quoted = F.concat(F.lit('"'), F.col(name), F.lit('" '))
        return F.concat(F.lit(prefix), F.when(F.col(name) == "", "").otherwise(quoted), problem)

    reason = (
        F.when(
            F.col("json_problem").isNotNull() | ~F.col("schema_version").between(-32768, 32767),
            BAD_PAYLOAD,
        )
        .when(~is_valid_event_id(F.col("event_id")), BAD_WIRE_ID)
        .when(F.col("_quantity").isNull(), amount_reason(BAD_WIRE_QUANTITY, "quantity", "_quantity"))
        .when(F.col("_price").isNull(), amount_reason(BAD_WIRE_PRICE, "price", "_price"))
        .when(F.col("_at").isNull(), BAD_WIRE_TIME)
    )
    return (
        evaluated(rows, {"reason": reason})
        .withColumns(
            {
                "event_id": canonical_uuid(F.col("event_id")),
                "schema_version": F.col("schema_version").try_cast("smallint"),
                "quantity": F.col("_quantity"),
                "price": F.col("_price"),
                "occurred_at": F.col("_at"),
            }
        )
        .drop("json_problem", "_quantity", "_price", "_at")
    )


def ledger_checks(trades: DataFrame) -> DataFrame:
    """Add ``check_reason``: the ledger check a row would fail, or NULL.

    The length of a value is checked before the named checks, and those run in
    the order of their names.
    """
    reason = (
        F.when(F.char_length("currency") > 3, TOO_LONG_CURRENCY)
        .when(~(F.col("price") > 0), PRICE_CHECK)
        .when(~(F.col("quantity") > 0), QUANTITY_CHECK)
        .when(~F.col("side").isin("BUY", "SELL"), SIDE_CHECK)
    )
    return evaluated(trades, {"check_reason": reason})


def split_valid(rows: DataFrame, reason: str = "error") -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; together they are all rows."""
    return rows.where(F.col(reason).isNull()).drop(reason), rows.where(F.col(reason).isNotNull())


def reject_summary(rows: DataFrame, reason: str = "error") -> DataFrame:
    return (
        rows.where(F.col(reason).isNotNull())
        .groupBy(F.col(reason).alias("reason"))
        .agg(F.count("*").alias("rejects"))
    )


def amount_audit(rows: DataFrame, names: list[str]) -> DataFrame:
    """Per amount column: how many values parse, fail (by reason) or lie outside (0, max]."""
    long = rows.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names])
        ).alias("a")
    ).select("a.field", "a.text")
    parsed = long.withColumn("amount", parse_amount(F.col("text")))
    verdict = F.when(
        F.col("amount").isNull(), amount_problem(F.col("text"), F.col("amount"))
    ).otherwise(F.when(in_bounds(F.col("amount")), "ok").otherwise("outside accepted range"))
    return (
        parsed.withColumn("verdict", verdict)
        .groupBy("field", "verdict")
        .agg(
            F.count("*").alias("rows"),
            F.sum(F.col("amount").cast("decimal(38,0)")).cast("string").alias("total"),
        )
    )


def rescale_up(rows: DataFrame, names: list[str]) -> DataFrame:
    """``numeric`` columns to scaled bigint; NULL where ``rescale_audit`` reports the row."""
    factor = F.lit(100_000_000).cast("decimal(9,0)")
    return rows.withColumns(
        {n: F.round(F.col(n).cast("decimal(28,8)") * factor).try_cast("bigint") for n in names}
    )


def rescale_audit(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows with an amount too large for a scaled bigint; the caller aborts when there are any."""
    limit = F.lit("92233720368.54775807").cast("decimal(19,8)")
    too_large = F.lit(False)
    for n in names:
        too_large = too_large | F.coalesce(F.abs(F.col(n)) > limit, F.lit(False))
    return rows.where(too_large)


def rescale_down(rows: DataFrame, names: list[str], coarse: list[str] = ()) -> DataFrame:
    """Scaled bigint back to ``numeric(20,8)``, or ``numeric(20,4)`` for the ``coarse`` columns."""
    factor = F.lit(100_000_000).cast("decimal(9,0)")

    def unscaled(n: str) -> Column:
        return (F.col(n).cast("decimal(19,0)") / factor).cast("decimal(28,8)")

    return rows.withColumns(
        {n: unscaled(n).cast("decimal(20,8)") for n in names}
        | {n: F.round(unscaled(n), 4).cast("decimal(20,4)") for n in coarse}
    )
