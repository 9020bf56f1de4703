"""Exact fixed-point amounts: ``bigint`` scaled by 10^8.

Every function is a JVM-side Column expression. Products are formed in
``decimal(38,0)``, which holds the product of any two bigints, and the range is
checked before ``div`` because ``div`` wraps silently.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions.binding import let

# Fixed values of the amount format.
FRACTION_DIGITS = 8
SCALE = 100_000_000
MAX_AMOUNT = 1_000_000_000_000_000_000
INT64_MAX = 9_223_372_036_854_775_807
UINT64_MAX = 18_446_744_073_709_551_615
EXPONENT_LIMIT = 1000
POWER_LIMIT = 19

PLAIN_FORM = r"\A[+-]?[0-9]+(?:\.[0-9]{0,8})?\z"
MANTISSA_FORM = r"\A[0-9]+(?:\.[0-9]*)?\z"

# Reasons given for a rejected amount string.
EMPTY = "must not be empty"
MALFORMED = "is not a valid decimal number"
BAD_EXPONENT = "has an invalid exponent"
EXPONENT_RANGE = "has an exponent out of range"
OUT_OF_RANGE = "is out of range"
TOO_PRECISE = "has more than 8 fractional digits"


def _wide(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def _pow10(power: Column) -> Column:
    return F.rpad(F.lit("1"), power + 1, F.lit("0")).cast("decimal(20,0)")


def _general(text: Column) -> Column:
    """The whole grammar (sign, digits, fraction, exponent): ``struct<value, problem>``."""

    def split(rest: Column) -> Column:
        has_exponent = F.regexp_like(rest, F.lit("[eE]"))
        return F.struct(
            F.regexp_extract(rest, r"\A([^eE]*)", 1).alias("mantissa"),
            F.when(has_exponent, F.regexp_extract(rest, r"\A[^eE]*[eE]([\s\S]*)\z", 1))
            .otherwise(F.lit("0"))
            .alias("exponent"),
        )

    def numbers(part: Column) -> Column:
        exponent, mantissa = part["exponent"], part["mantissa"]
        # Leading zeros carry no value and would overflow the decimal cast.
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"\A0+(?=[0-9])", "")
        return F.struct(
            F.when(
                F.regexp_like(exponent, F.lit(r"\A[+-]?[0-9]+\z")),
                F.regexp_replace(exponent, r"\A([+-]?)0+(?=[0-9])", "$1").try_cast("bigint"),
            ).alias("exponent"),
            F.when(
                F.regexp_like(mantissa, F.lit(MANTISSA_FORM)) & (F.length(digits) <= 20), digits
            )
            .try_cast("decimal(20,0)")
            .alias("magnitude"),
            F.length(F.regexp_extract(mantissa, r"\.([0-9]*)\z", 1)).alias("fraction_length"),
        )

    def shifted(n: Column) -> Column:
        power = n["exponent"] - n["fraction_length"] + F.lit(FRACTION_DIGITS)
        return F.struct(
            n["exponent"].alias("exponent"),
            F.when(n["magnitude"] <= _wide(UINT64_MAX), n["magnitude"]).alias("magnitude"),
            F.when(n["exponent"].between(-EXPONENT_LIMIT, EXPONENT_LIMIT), power)
            .cast("int")
            .alias("power"),
            F.when(
                n["exponent"].between(-EXPONENT_LIMIT, EXPONENT_LIMIT),
                _pow10(F.least(F.abs(power), F.lit(POWER_LIMIT)).cast("int")),
            ).alias("factor"),
        )

    def verdict(v: Column) -> Column:
        magnitude, power, factor = v["magnitude"], v["power"], v["factor"]
        nothing = F.lit(None).cast("decimal(38,0)")
        # A zero mantissa takes any upward shift, but a divisor keeps its limit.
        value = (
            F.when(magnitude.isNull() | power.isNull(), nothing)
            .when((power >= 0) & (magnitude == 0), F.lit(0).cast("decimal(38,0)"))
            .when((power >= 0) & (power < POWER_LIMIT), (magnitude * factor).cast("decimal(38,0)"))
            .when((power >= 0) | (power < -POWER_LIMIT) | (magnitude % factor != 0), nothing)
            .otherwise(F.call_function("div", magnitude, factor).cast("decimal(38,0)"))
        )
        problem = (
            F.when(v["exponent"].isNull(), F.lit(BAD_EXPONENT))
            .when(power.isNull(), F.lit(EXPONENT_RANGE))
            .when(magnitude.isNull(), F.lit(MALFORMED))
            .when(
                (power < 0) & (power >= -POWER_LIMIT) & (magnitude % factor != 0),
                F.lit(TOO_PRECISE),
            )
            .otherwise(F.lit(OUT_OF_RANGE))
        )
        return F.struct(value.alias("value"), problem.alias("problem"))

    rest = F.regexp_replace(text, r"\A[+-]", "")
    return let(let(let(let(rest, split), numbers), shifted), verdict)


def parse_amount(text: Column) -> Column:
    """``bigint`` value of an amount string, NULL when it is rejected."""
    plain = F.regexp_like(text, F.lit(PLAIN_FORM))
    # At most eight fraction digits and no exponent: one exact decimal cast is enough.
    plain_value = text.try_cast("decimal(28,8)") * F.lit(SCALE).cast("decimal(9,0)")
    sign = F.when(text.startswith("-"), -1).otherwise(1).cast("decimal(1,0)")
    general = F.when(text.isNotNull(), sign * _general(text)["value"].try_cast("decimal(20,0)"))
    number = F.when(plain, plain_value.try_cast("decimal(38,0)")).otherwise(
        general.cast("decimal(38,0)")
    )
    return F.nullif(number.try_cast("bigint"), F.lit(-INT64_MAX - 1))


def amount_problem(text: Column, parsed: Column) -> Column:
    """Why ``text`` gave no value; NULL when ``parsed`` holds one."""
    return F.when(
        parsed.isNull(),
        F.when(text.isNull() | (text == ""), F.lit(EMPTY))
        .when(text.isin("+", "-"), F.lit(MALFORMED))
        .otherwise(_general(text)["problem"]),
    )


def in_bounds(value: Column) -> Column:
    """Positive and no greater than the largest accepted amount."""
    return F.coalesce((value > 0) & (value <= MAX_AMOUNT), F.lit(False))


def format_amount(value: Column) -> Column:
    """Decimal string with exactly eight fraction digits; safe for the smallest bigint."""
    return (
        (value.cast("decimal(19,0)") / F.lit(SCALE).cast("decimal(9,0)"))
        .cast("decimal(27,8)")
        .cast("string")
    )


def _product(a: Column, b: Column) -> Column:
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def mul_amount(a: Column, b: Column) -> Column:
    """``a * b / 10^8`` cut toward zero, NULL when it leaves the bigint range."""
    product = _product(a, b)
    above = _wide((INT64_MAX + 1) * SCALE)
    below = _wide(-(INT64_MAX + 2) * SCALE)
    fits = (product < above) & (product > below)
    return F.when(fits, F.call_function("div", product, F.lit(SCALE).cast("decimal(9,0)")))


def div_amount(a: Column, b: Column) -> Column:
    """``a * 10^8 / b`` cut toward zero, NULL for a zero divisor or out of range."""
    top = a.cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(9,0)")
    bottom = b.cast("decimal(19,0)")
    limit = F.abs(bottom) * _wide(INT64_MAX + 1).cast("decimal(19,0)")
    same_sign = (a >= 0) == (b >= 0)
    fits = (F.abs(top) < limit) | (~same_sign & (F.abs(top) < limit + F.abs(bottom)))
    return F.when((b != 0) & fits, F.call_function("div", top, bottom))


def signed_quantity(side: Column, quantity: Column) -> Column:
    """A buy adds, a sell subtracts, any other side has no quantity."""
    return F.when(side == "BUY", quantity).when(side == "SELL", -quantity)
