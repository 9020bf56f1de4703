"""Running sums over fact rows without giving one task a whole key.

A window over a key sorts that key in one task. Here the key is cut into cells
of the order column; cell totals are aggregated map-side, the running total of
cells is a window over the few cells, and rows only meet the other rows of
their own cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.session import cut_lineage


CELL_ROWS = 1_000_000
LEAST_PART = 100_000  # rows; cells may be far smaller than what is worth a task


def ranked_cells(
    rows: DataFrame, keys: list[str], order: list[str], cell_rows: int = CELL_ROWS, name: str = "_cell"
) -> DataFrame:
    """Add ``name``, a number that never decreases along ``keys`` and ``order``, with at most ``cell_rows`` rows each.

    Ranges of the whole order are sorted and cut into cells by rank, so their size does not depend on how the
    values lie: a key with most of the rows, or with all of them in one moment, is cut like any other. Ranges are
    drawn from a sample; the result is written, so that every reader sees the same ones. It stays sorted, and a cell
    is in one partition.
    """
    parts = max(1, -(-rows.count() // max(cell_rows, LEAST_PART)))
    ranged = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = ranged.withColumn("_at", F.monotonically_increasing_id())  # the partition, and 33 bits for the row in it
    cell = F.shiftright("_at", 33) * F.lit(2**32) + F.expr(f"(_at & {2**33 - 1}L) div {cell_rows}L")
    return cut_lineage(placed.withColumn(name, cell).drop("_at"))


def running_sum(
    rows: DataFrame,
    keys: list[str],
    cell: str,
    order: list[str],
    value: str,
    name: str,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over earlier rows of the key, this row included.

    ``cell`` must be a column that never decreases along ``order``; ``order``
    must be unique within a key.
    """
    totals = rows.groupBy(*keys, cell).agg(F.sum(value).alias("_cell_sum"))
    earlier = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, cell, F.coalesce(F.sum("_cell_sum").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = (
        Window.partitionBy(*keys, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.join(offsets, [*keys, cell])
        .withColumn(name, F.col("_offset") + F.sum(value).over(inside))
        .drop("_offset")
    )


# --- running compositions -----------------------------------------------------------------

SEGMENT = 1024  # rows, segments and groups of segments that are put together; so a key has 2**30 rows at most


def segmented(rows: DataFrame, keys: list[str], cell: str, order: list[str]) -> DataFrame:
    """Add ``_place``, 1, 2, ... along ``order``, and ``_segment``: ``SEGMENT`` successive rows of a key."""
    placed = running_sum(
        rows.withColumn("_one", F.lit(1).cast("bigint")), keys, cell, order, "_one", "_place"
    ).drop("_one")
    return placed.withColumn("_segment", F.expr(f"(_place - 1) div {SEGMENT}"))


def step_below(threshold: Column, value: Column) -> Column:
    """The function that gives ``value`` below ``threshold`` and leaves the rest; the value is no larger
    than the threshold. Compositions of such functions are again of this form."""
    return F.struct(threshold.cast("bigint").alias("t"), value.cast("bigint").alias("v"))


def applied(step: Column, to: Column) -> Column:
    """A null step changes nothing."""
    return F.when(to < step["t"], step["v"]).otherwise(to)


def _then(first: Column, second: Column) -> Column:
    """``second`` after ``first``."""
    both = F.struct(F.greatest(first["t"], second["t"]).alias("t"), second["v"].alias("v"))
    return F.when(first["v"] < second["t"], both).otherwise(first)


def _composed(steps: Column) -> Column:
    """The steps of an array in turn, as one."""
    lowest = F.lit(-(2**62))
    return F.aggregate(steps, step_below(lowest, lowest), _then)


def _before(steps: Column, start: Column) -> Column:
    """The value that each step of an array finds."""
    none = F.array().cast("array<bigint>")
    walked = F.aggregate(
        steps, F.struct(start.cast("bigint").alias("at"), none.alias("seen")),
        lambda told, step: F.struct(
            applied(step, told["at"]).alias("at"), F.concat(told["seen"], F.array(told["at"])).alias("seen")
        ),
    )
    return walked["seen"]


def _gathered(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per key, with its at most ``SEGMENT`` rows as a sorted array ``_rows``."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("_rows"))


def _handed_down(gathered: DataFrame, keys: list[str], columns: list[str], step: str, start: str, name: str) -> DataFrame:
    found = F.transform(
        F.arrays_zip(F.col("_rows").alias("r"), _before(F.col("_rows")[step], F.col(start)).alias("b")),
        lambda x: F.struct(*[x["r"][c].alias(c) for c in columns], x["b"].alias(name)),
    )
    return gathered.select(*keys, F.inline(found))


def before_each(rows: DataFrame, keys: list[str], step: str, start: str, name: str) -> DataFrame:
    """Add ``name``: ``start``, which is the same for all rows of a key, with the steps of all earlier rows
    of the key applied in turn.

    ``rows`` come from ``segmented``. Segments are composed apart from each other, then groups of ``SEGMENT``
    segments; values go down the same way. No task holds more than ``SEGMENT`` entries of a key at a time, and a key
    of more than that many groups fails.
    """
    others = [c for c in rows.columns if c not in (*keys, "_segment", "_place")]
    low = _gathered(rows, [*keys, "_segment"], "_place", others)
    totals = low.select(
        *keys, "_segment", F.expr(f"_segment div {SEGMENT}").alias("_group"),
        _composed(F.col("_rows")[step]).alias("_step"), F.col("_rows")[0][start].alias("_start"),
    )
    middle = _gathered(totals, [*keys, "_group"], "_segment", ["_step", "_start"]).select(
        "*", _composed(F.col("_rows")["_step"]).alias("_step"), F.col("_rows")[0]["_start"].alias("_start")
    )
    high = _gathered(middle, keys, "_group", ["_step", "_start"]).withColumn(
        "_start", F.col("_rows")[0]["_start"]
    )
    fits = F.when(F.size("_rows") <= SEGMENT, F.col("_rows")).otherwise(
        F.raise_error(F.lit("too many rows of one key")).cast(high.schema["_rows"].dataType)
    )
    groups = _handed_down(high.withColumn("_rows", fits), keys, ["_group"], "_step", "_start", "_at")
    segments = _handed_down(
        middle.drop("_step", "_start").join(groups, [*keys, "_group"]), keys, ["_segment"], "_step", "_at", "_from"
    )
    return _handed_down(
        low.join(segments, [*keys, "_segment"]), [*keys, "_segment"], ["_place", *others], step, "_from", name
    ).drop(step)


def last_places(rows: DataFrame, keys: list[str], marks: dict[str, tuple[Column, bool]]) -> DataFrame:
    """For each name the last ``_place`` of the key that meets a condition, null without one.

    ``marks`` maps a name to the condition and whether the row itself counts. ``rows`` come from ``segmented``.
    """
    inner = Window.partitionBy(*keys, "_segment").orderBy("_place")
    outer = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_at_{n}": F.when(met, F.col("_place")) for n, (met, _) in marks.items()})
    carried = rows.groupBy(*keys, "_segment").agg(*[F.max(f"_at_{n}").alias(f"_seg_{n}") for n in marks])
    carried = carried.select(*keys, "_segment", *[F.max(f"_seg_{n}").over(outer).alias(f"_carry_{n}") for n in marks])
    rows = rows.join(carried, [*keys, "_segment"])
    for name, (_, itself) in marks.items():
        upto = inner.rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
        rows = rows.withColumn(name, F.coalesce(F.max(f"_at_{name}").over(upto), F.col(f"_carry_{name}")))
    return rows.drop(*[f"_{kind}_{n}" for kind in ("at", "carry") for n in marks])
