"""Strict reading of one JSON object per row.

Spark's JSON readers coerce numbers to strings and ignore whatever follows the
first value. A record in the usual spelling (only wanted fields, plain strings,
nothing behind) is recognised by one pattern and read by ``from_json``. Any
other text is parsed as ``variant`` twice, once inside an object and once inside
an array: trailing text cannot close both, so a value that survives both is the
whole text. Keys match without regard to case, ``null`` reads as empty, and of a
repeated key the last value counts on both ways.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.binding import evaluated, let

MAX_BODY_BYTES = 4096
MALFORMED, TRAILING = "malformed", "trailing"

# A bounded repeat: the pattern matcher recurses once per field. Longer records take the other way,
# with the same result.
USUAL_FIELDS = 16
SPACE = r"[ \t\r\n]*+"


def _usual(text: Column, integers: list[str]) -> Column:
    """Lower-case keys, strings without escapes, short whole numbers where one is wanted."""
    numbers = "|".join(integers) or "(?!)"
    pair = (
        rf'(?:"(?!(?:{numbers})")[a-z_]++"{SPACE}:{SPACE}"[^"\\\x00-\x1f]*+"'
        rf'|"(?:{numbers})"{SPACE}:{SPACE}(?:0|-?[1-9][0-9]{{0,4}}+))'
    )
    more = rf"(?:{SPACE},{SPACE}{pair}){{0,{USUAL_FIELDS - 1}}}"
    pattern = rf"\A{SPACE}\{{{SPACE}{pair}{more}{SPACE}\}}{SPACE}\z"
    return F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False))


def _read_any(text: Column, strings: list[str], integers: list[str]) -> Column:
    names = [*strings, *integers]

    # One pass over the entries for all wanted names.
    def wrong_type(e: Column) -> Column:
        accepted = F.when(e["k"].isin(names[: len(strings)]), "STRING").otherwise("BIGINT")
        return ~e["t"].isin("VOID") & (e["t"] != accepted)

    def parse(t: Column) -> Column:
        in_object = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
        in_array = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        return F.struct(
            F.try_variant_get(in_object, "$.v", "variant").alias("wrapped"),
            in_array.isNotNull().alias("closes"),
            F.try_parse_json(t).alias("bare"),
        )

    def describe(p: Column) -> Column:
        first = F.coalesce(p["wrapped"], p["bare"])
        return F.struct(
            (p["wrapped"].isNotNull() & p["closes"]).alias("whole"),
            F.schema_of_variant(first).alias("kind"),
            F.transform(
                F.map_entries(first.try_cast("map<string,variant>")),
                lambda e: F.struct(
                    F.lower(e["key"]).alias("k"),
                    F.schema_of_variant(e["value"]).alias("t"),
                    F.try_variant_get(e["value"], "$", "string").alias("s"),
                ),
            ).alias("entries"),
        )

    def pick(d: Column) -> Column:
        wanted = F.filter(d["entries"], lambda e: e["k"].isin(names))
        return F.struct(
            wanted.alias("entries"), F.transform(wanted, lambda e: e["k"]).alias("keys"),
            d["kind"].alias("kind"), d["whole"].alias("whole"),
        )

    def judge(d: Column) -> Column:
        once = F.size(F.array_distinct(d["keys"])) == F.size(d["keys"])
        well_typed = F.when(d["kind"] == "VOID", F.lit(True)).otherwise(
            F.coalesce(once & ~F.exists(d["entries"], wrong_type), F.lit(False))
        )
        problem = F.when(~well_typed, MALFORMED).when(~d["whole"], TRAILING)

        def field(n: str) -> Column:
            # No such key: its place is 0, and there is nothing at -1.
            return F.get(d["entries"], F.array_position(d["keys"], n).cast("int") - 1)["s"]

        return F.struct(
            F.when(d["kind"].isNull(), MALFORMED).otherwise(problem).alias("json_problem"),
            *[F.coalesce(field(n), F.lit("")).alias(n) for n in strings],
            *[field(n).try_cast("bigint").alias(n) for n in integers],
        )

    return let(let(let(let(text, parse), describe), pick), judge)


def read_object(df: DataFrame, text: str, strings: list[str], integers: list[str] = ()) -> DataFrame:
    """Add ``json_problem`` and one column per wanted field.

    String fields are ``''`` when absent or null, integer fields NULL.
    ``json_problem`` is ``malformed`` for text that does not start with a JSON
    object or holds a wanted field of the wrong type or in two spellings,
    ``trailing`` for an object followed by more text, else NULL.
    """
    value, usual = F.col(text), F.col("_usual")
    schema = ", ".join([f"{n} string" for n in strings] + [f"{n} bigint" for n in integers])
    read = evaluated(df, {"_usual": _usual(value, integers)})
    read = evaluated(
        read,
        {
            "_plain": F.when(usual, F.from_json(value, schema)),
            "_other": F.when(~usual, _read_any(value, strings, integers)),
        },
    )
    plain, other = F.col("_plain"), F.col("_other")
    return read.withColumns(
        {"json_problem": other["json_problem"]}
        | {n: F.when(usual, F.coalesce(plain[n], F.lit(""))).otherwise(other[n]) for n in strings}
        | {n: F.when(usual, plain[n]).otherwise(other[n]) for n in integers}
    ).drop("_usual", "_plain", "_other")
