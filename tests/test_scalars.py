import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import amounts as A, text as T
from ledgerloom.functions.jsonfields import read_object

PARSED = {
    "10": 1000000000, "12.345": 1234500000, "0.00000001": 1, "-1.5": -150000000, "+2": 200000000,
    "1e2": 10000000000, "1.5e3": 150000000000, "1.23e-2": 1230000, "1e+2": 10000000000,
    "1.": 100000000, "0": 0, "-0": 0, "10000000000": 10**18, "10000000000.00000001": 10**18 + 1,
    "0e500": 0, "0e-27": 0, "9223372036854775807e-8": 2**63 - 1, "1.000000000": 100000000,
    "0" * 60 + "5": 500000000, "92233720368.54775807": 2**63 - 1,
}
REJECTED = {
    "": A.EMPTY, "ten": A.BAD_EXPONENT, "0.000000001": A.TOO_PRECISE, "1.23456789e-1": A.TOO_PRECISE,
    "1e400": A.OUT_OF_RANGE, "e2": A.MALFORMED, "1e2e3": A.BAD_EXPONENT,
    "0e9223372036854775807": A.EXPONENT_RANGE, "0e-30": A.OUT_OF_RANGE, "0e1001": A.EXPONENT_RANGE,
    "18446744073709551615": A.OUT_OF_RANGE, "18446744073709551616": A.MALFORMED, " 5": A.MALFORMED,
    ".5": A.MALFORMED, "5\n": A.MALFORMED, "５": A.MALFORMED, "-92233720368.54775808": A.OUT_OF_RANGE,
    "+": A.MALFORMED, "1.2.3": A.MALFORMED, "1e": A.BAD_EXPONENT, "1e99999999999999999999": A.BAD_EXPONENT,
}


def test_parse_amount_cases(spark):
    rows = spark.createDataFrame([(t,) for t in [*PARSED, *REJECTED]], "t string")
    value = A.parse_amount(F.col("t"))
    got = {r.t: (r.v, r.p) for r in rows.select(
        "t", value.alias("v"), A.amount_problem(F.col("t"), value).alias("p")
    ).collect()}
    assert got == {t: (v, None) for t, v in PARSED.items()} | {t: (None, p) for t, p in REJECTED.items()}


def _model(text: str) -> int | None:
    sign = -1 if text[:1] == "-" else 1
    body = text[1:] if text[:1] in "+-" and text else text
    mantissa, mark, exponent = body.lower().partition("e")
    whole, _, fraction = mantissa.partition(".")
    try:
        power = int(exponent) if mark else 0
    except ValueError:
        return None
    if not whole.isdigit() or (fraction and not fraction.isdigit()) or abs(power) > 1000:
        return None
    digits = int(whole + fraction)
    shift = power - len(fraction) + 8
    if digits >= 2**64 or (shift < 0 and -shift > 19):
        return None
    if shift >= 0:
        value = digits * 10**shift
    elif digits % 10**-shift:
        return None
    else:
        value = digits // 10**-shift
    return sign * value if value < 2**63 else None


def test_parse_amount_against_plain_integers(spark):
    rng = random.Random(7)
    texts = set()
    for _ in range(1500):
        text = rng.choice(["", "+", "-"]) + str(rng.randrange(10 ** rng.randrange(1, 22)))
        if rng.random() < 0.6:
            text += "." + "".join(rng.choice("0000123456789") for _ in range(rng.randrange(12)))
        if rng.random() < 0.4:
            text += rng.choice("eE") + rng.choice(["", "+", "-"]) + str(rng.randrange(25))
        texts.add(text)
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.v for r in rows.select("t", A.parse_amount(F.col("t")).alias("v")).collect()}
    assert got == {t: _model(t) for t in texts}


def test_arithmetic_against_plain_integers(spark):
    def cut(p, q):
        r = abs(p) // abs(q)
        r = r if (p >= 0) == (q >= 0) else -r
        return r if -(2**63) <= r < 2**63 else None

    edge = [-(2**63), 2**63 - 1, 1, -1, 10**18, -150000000, 250000000, 99999999, 0]
    rows = spark.createDataFrame([(a, b) for a in edge for b in edge], "a bigint, b bigint")
    for r in rows.select(
        "a", "b", A.mul_amount(F.col("a"), F.col("b")).alias("m"),
        A.div_amount(F.col("a"), F.col("b")).alias("d"),
    ).collect():
        assert r.m == cut(r.a * r.b, 10**8)
        assert r.d == (cut(r.a * 10**8, r.b) if r.b else None)


def test_format_amount(spark):
    values = {1: "0.00000001", -(2**63): "-92233720368.54775808", 2**63 - 1: "92233720368.54775807",
              0: "0.00000000", 1234500000: "12.34500000"}
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = {r.v: r.t for r in rows.select("v", A.format_amount(F.col("v")).alias("t")).collect()}
    assert got == values


def test_hash_matches_definition(spark):
    def fnv(data):
        h = 2166136261
        for b in data:
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    texts = ["", "AAPL", "BRK.B", "é", "日本", "tenant-a:AAPL"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.h for r in rows.select("t", T.fnv1a32(F.col("t")).alias("h")).collect()}
    assert got == {t: fnv(t.encode()) for t in texts}


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2026-01-02T15:04:05.999999999Z", "2026-01-02 15:04:05.999999"),
        ("2026-01-02T15:04:05+02:00", "2026-01-02 13:04:05"),
        ("2026-01-02T15:04:05-24:60", "2026-01-03 16:04:05"),
        ("2026-01-02T1:04:05Z", "2026-01-02 01:04:05"),
        ("2026-08-03", None), ("2026-02-30T00:00:00Z", None), ("2026-01-02T24:04:05Z", None),
        ("2026-01-02t15:04:05Z", None), ("2026-01-02T15:04:60Z", None), ("2026-01-02T15:04:05Z\n", None),
        ("2026-01-02T15:04:05+25:00", None),
    ],
)
def test_rfc3339(spark, text, expected):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(T.parse_rfc3339(F.col("t")).cast("string")).first()[0] == expected


def test_uuid_spellings(spark):
    plain = "f47ac10b-58cc-0372-8567-0e02b2c3d479"
    good = [plain, plain.upper(), "urn:uuid:" + plain, "{" + plain + "}", plain.replace("-", "")]
    bad = ["", "x", plain[:-1], plain + "0", "urn:uuid:" + plain.replace("-", "")]
    rows = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = {r.t: r.u for r in rows.select("t", T.canonical_uuid(F.col("t")).alias("u")).collect()}
    assert got == {t: plain for t in good} | {t: None for t in bad}


def test_key_split(spark):
    rows = spark.createDataFrame([("a:B",), ("a:b:c",), ("alone",), (":x",)], "k string")
    got = [tuple(r) for r in rows.select(T.key_tenant(F.col("k")), T.key_instrument(F.col("k"))).collect()]
    assert got == [("a", "B"), ("a", "b:c"), ("alone", ""), ("", "x")]


def test_strict_json(spark):
    cases = {
        '{"a":"x","n":1}': (None, "x", 1),
        '{"A":"x"}': (None, "x", None),
        ' {"a":"x"} \n': (None, "x", None),
        '{"a":null}': (None, "", None),
        '{"a":"q\\"uote","other":[1,{"b":2}]}': (None, 'q"uote', None),
        "null": (None, "", None),
        "{}": (None, "", None),
        '{"a":5}': ("malformed",), '{"n":"1"}': ("malformed",), '{"n":1.5}': ("malformed",),
        '{"a":"1","A":"2"}': ("malformed",), "[1]": ("malformed",), "": ("malformed",),
        '{"a":"x"': ("malformed",), '{"a":"x"} x': ("trailing",), '{"a":"x"}}': ("trailing",),
        '{"a":"x"}] x': ("trailing",), '{"a":"x"}} x': ("trailing",), '{"a":"x"}{"a":"y"}': ("trailing",),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in read_object(rows, "t", ["a"], ["n"]).collect():
        expected = cases[r.t]
        got = (r.json_problem, r.a, r.n)
        assert got[: len(expected)] == expected, r.t
