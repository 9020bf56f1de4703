"""Cut the rows of very long keys into bounded, ordered segments.

A key may hold a third of all rows, so no task may be given a whole key. Ledger
ids are unique, which gives a proven bound: ``CELL_IDS`` consecutive ids hold at
most that many rows of one key. Cells are counted (a small aggregate), packed
into segments of about ``segment_rows`` rows, and every row finds its segment by
an equi-join on its cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SEGMENT_ROWS = 1_000_000
CELL_IDS = 65_536


def long_keys(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keys with more than ``limit`` rows; at most ``rows / limit`` of them."""
    return rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).select(*keys)


def with_segments(
    rows: DataFrame, keys: list[str], order: str, segment_rows: int, cell_width: int | None = None
) -> DataFrame:
    """Add ``segment``: 0, 1, ... in ``order``; at most ``segment_rows`` and one cell of rows each.

    ``order`` is a bigint column. For unique ids the default cell is at most one
    more segment; for a clock, ``cell_width`` says how many ticks make a cell.
    """
    cell = F.expr(f"{order} div {cell_width or min(CELL_IDS, segment_rows)}L")
    cells = rows.groupBy(*keys, cell.alias("_cell")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    packed = cells.withColumn("_before", F.coalesce(before, F.lit(0).cast("bigint"))).select(
        *keys, "_cell", F.expr(f"_before div {segment_rows}L").alias("segment")
    )
    return rows.withColumn("_cell", cell).join(packed, [*keys, "_cell"]).drop("_cell")
