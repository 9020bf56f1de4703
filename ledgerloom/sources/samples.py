"""Scraped metric samples and tenant partition maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.schemas import METRIC_SAMPLES


def read_metric_samples(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Long table of samples: ``metric, labels, ts, value``."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(METRIC_SAMPLES).parquet(path)


def series_of(samples: DataFrame, metric: str, labels: dict[str, str]) -> DataFrame:
    """Samples of one metric with the wanted labels as columns ``{column: label}``."""
    wanted: dict[str, Column] = {
        column: F.try_element_at(F.col("labels"), F.lit(label)) for column, label in labels.items()
    }
    return samples.where(F.col("metric") == metric).withColumns(wanted).drop("metric", "labels")
