"""Writers for results and datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(samples: DataFrame, summary: DataFrame, path: str) -> None:
    """Per-sample JSON lines below ``path/samples`` and the summary (a few rows, as one
    JSON file) below ``path/summary``."""
    samples.write.json(f"{path}/samples")
    summary.repartition(1).write.json(f"{path}/summary")


def write_dataset(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Publish a table as Parquet."""
    df.write.partitionBy(*partition_by).parquet(path)


def write_keyed_json(df: DataFrame, key: str, path: str) -> None:
    """JSON lines in one folder per key."""
    df.withColumn("_key", F.col(key)).write.partitionBy("_key").json(path)
