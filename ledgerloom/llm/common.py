"""Helpers the training-data operators share."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.session import scratch_folder

FOLDS = 5
SAMPLE_SALTS = 64  # parts a label's keys are cut in before the smallest ones are taken


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read again: a cut of the lineage that
    survives lost executors. The folder goes when the application ends."""
    path = f"{scratch_folder(frame.sparkSession, f'llm-{name}')}/rows"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column is called so; Spark ignores case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(key: Column) -> Column:
    """True for the fifth of the rows that no model learns from; a null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample_keys(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` distinct values of ``key`` per label, the smallest ones.

    ``key`` should be a hash. A label that holds most rows is no hot group: it is cut to
    ``per_label`` keys in each of ``SAMPLE_SALTS`` parts, taken from other bits of the hash than
    its order, before its parts meet.
    """
    part = F.pmod("key", F.lit(SAMPLE_SALTS)).alias("_part")
    order = Window.partitionBy(label, "_part").orderBy("key")
    cut = (
        rows.select("key", label)
        .groupBy("key", label)
        .agg(F.lit(1).alias("_one"))
        .select("key", label, part)
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= per_label)
    )
    return (
        cut.select("key", label)
        .withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy("key")))
        .where(F.col("_rank") <= per_label)
        .select("key", label)
    )


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as a list; null reads as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def batches(columns: dict[str, pa.DataType], rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[name], kind) for name, kind in columns.items()], names=list(columns)
    )


def release_memory() -> None:
    """Give freed memory back at the end of a partition: workers are used again, by other stages too."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
