"""Checks and canonical forms for identifiers and timestamps, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted identifier shapes and the FNV-1a parameters.
TENANT_FORM = r"\A[a-z0-9-]{1,64}\z"
INSTRUMENT_FORM = r"\A[A-Z0-9.]{1,16}\z"
CURRENCY_FORM = r"\A[A-Z]{3}\z"
HYPHENATED_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
RFC3339_FORM = (
    r"\A([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{1,2}):([0-9]{2}:[0-9]{2})"
    r"(?:[.,]([0-9]+))?(Z|[+-][0-9]{2}:[0-9]{2})\z"
)
UTC_FORM = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,9})?Z\z"
FNV_OFFSET = 2166136261
FNV_PRIME = 16777619
UINT32_MASK = 4294967295

# Plain, URN, enclosed in one character on each side, and without hyphens.
UUID_FORM = (
    rf"\A(?:(?i:urn:uuid:)?{HYPHENATED_UUID}"
    rf"|[\x00-\x7f]{HYPHENATED_UUID}[\x00-\x7f]"
    r"|[0-9a-fA-F]{32})\z"
)


def is_valid_tenant_id(value: Column) -> Column:
    return F.regexp_like(value, F.lit(TENANT_FORM))


def is_valid_instrument(value: Column) -> Column:
    return F.regexp_like(value, F.lit(INSTRUMENT_FORM))


def is_valid_currency(value: Column) -> Column:
    return F.regexp_like(value, F.lit(CURRENCY_FORM))


def is_valid_event_id(value: Column) -> Column:
    return F.regexp_like(value, F.lit(UUID_FORM))


def canonical_uuid(value: Column) -> Column:
    """Lower-case hyphenated form of any accepted spelling, NULL for anything else."""
    found = F.regexp_extract(value, rf"({HYPHENATED_UUID}|\A[0-9a-fA-F]{{32}}\z)", 1)
    grouped = F.regexp_replace(
        F.replace(F.lower(found), F.lit("-"), F.lit("")),
        r"\A(.{8})(.{4})(.{4})(.{4})(.{12})\z",
        "$1-$2-$3-$4-$5",
    )
    is_canonical = F.regexp_like(
        value, F.lit(r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")
    )
    return F.when(is_canonical, value).when(is_valid_event_id(value), grouped)


def parse_rfc3339(value: Column) -> Column:
    """Timestamp of an RFC 3339 string with zone, to the microsecond; NULL for anything else.

    Offsets up to 24:60 are taken, wider than a zone cast allows, so the offset
    is subtracted from the UTC reading of the local part.
    """
    day = F.regexp_extract(value, RFC3339_FORM, 1)
    hour = F.lpad(F.regexp_extract(value, RFC3339_FORM, 2), 2, "0")
    rest = F.regexp_extract(value, RFC3339_FORM, 3)
    fraction = F.rpad(F.regexp_extract(value, RFC3339_FORM, 4), 6, "0")
    zone = F.regexp_extract(value, RFC3339_FORM, 5)
    local = F.concat(day, F.lit("T"), hour, F.lit(":"), rest, F.lit("."), fraction, F.lit("Z"))
    hours = F.substring(zone, 2, 2).try_cast("int")
    minutes = F.substring(zone, 5, 2).try_cast("int")
    shift = F.when(zone == "Z", F.lit(0)).when(
        (hours <= 24) & (minutes <= 60),
        F.when(zone.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes),
    )
    utc = local.try_cast("timestamp")
    shifted = F.timestamp_micros(F.unix_micros(utc) - shift.cast("bigint") * F.lit(60_000_000))
    return F.when(
        F.regexp_like(value, F.lit(UTC_FORM)), value.try_cast("timestamp")
    ).when(F.regexp_like(value, F.lit(RFC3339_FORM)), shifted)


def format_rfc3339(value: Column) -> Column:
    """UTC form with the fraction's trailing zeros removed, as the wire carries it."""
    text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+\z", ""), F.lit("Z"))


def side_from_code(code: Column) -> Column:
    return F.when(code == 1, F.lit("BUY")).when(code == 2, F.lit("SELL"))


def partition_key(tenant_id: Column, instrument: Column) -> Column:
    return F.concat_ws(":", tenant_id, instrument)


def key_tenant(key: Column) -> Column:
    """Part before the first colon; the whole key when there is none."""
    return F.substring_index(key, ":", 1)


def key_instrument(key: Column) -> Column:
    """Part after the first colon; empty when there is none."""
    at = F.instr(key, ":")
    return F.when(at > 0, F.substr(key, at + 1)).otherwise(F.lit(""))


def fnv1a32(value: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes, as bigint."""
    text = F.hex(F.encode(value, "UTF-8"))
    length = F.octet_length(value)
    # An empty string has no bytes; sequence(1, 0) would count down.
    steps = F.when(length > 0, F.sequence(F.lit(1), length)).otherwise(
        F.array().cast("array<int>")
    )
    one_byte_each = length == F.char_length(value)

    def mixed(state: Column, byte: Column) -> Column:
        return (state.bitwiseXOR(byte.cast("bigint")) * F.lit(FNV_PRIME)).bitwiseAND(
            F.lit(UINT32_MASK)
        )

    def ascii_step(state: Column, at: Column) -> Column:
        return mixed(state, F.ascii(F.substring(value, at, F.lit(1))))

    def byte_step(state: Column, at: Column) -> Column:
        return mixed(state, F.conv(F.substring(text, at * 2 - 1, F.lit(2)), 16, 10))

    start = F.lit(FNV_OFFSET).cast("bigint")
    return F.when(one_byte_each, F.aggregate(steps, start, ascii_step)).otherwise(
        F.aggregate(steps, start, byte_step)
    )
