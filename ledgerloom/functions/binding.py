"""Compute an intermediate value once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    Lambdas are not code-generated, so this is for branches few rows take.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that filters downstream see as plain values.

    A filter on a projected expression is pushed below the projection with the
    expression copied into it, once per use. For the long expressions of parsing
    and checking that means evaluating them again and a plan that grows with
    every stage. Columns that leave a generator are not copied.
    """
    kept = [c for c in df.columns if c not in columns]
    # The expressions stay in a projection, which compiles them; the generator
    # only passes their values on.
    computed = df.withColumns({f"__{name}": value for name, value in columns.items()})
    packed = F.struct(*[F.col(f"__{name}").alias(name) for name in columns])
    return computed.select(*kept, F.inline(F.array(packed)))
