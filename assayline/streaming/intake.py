"""Incremental intake: only rows whose key has no result yet."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayline.operators.scale import broadcast_if_small, first_by
from assayline.session import materialize

KEY_FOLDER = "_keys"
KEY_PARTS = 256


def new_rows(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch form: rows without a finished key, one per key already finished or not."""
    return df.join(broadcast_if_small(done.select(*keys).distinct()), list(keys), "left_anti")


def deduplicated(
    stream: DataFrame, keys: Sequence[str], time: str | None = None, delay: str = "1 day"
) -> DataFrame:
    """Stream form: first row per key. With an event time the kept keys are bounded by
    the watermark; without one every key is kept as state."""
    if time is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def _hashed(keys: Sequence[str]) -> dict[str, Column]:
    """128-bit hash of a key and its part; nulls are values of their own."""
    cols = [F.col(k) for k in keys] + [F.col(k).isNull() for k in keys]
    first = F.xxhash64(*cols)
    return {
        "_a": first,
        "_b": F.xxhash64(*cols, F.lit(1)),
        "part": F.pmod(first, F.lit(KEY_PARTS)).cast("int"),
    }


def _batches(spark: SparkSession, path: str, below: str = "") -> set[str]:
    """Names of the batch folders of a table that hold files, from the file listing alone."""
    try:
        files = spark.read.schema("_a long").parquet(path).inputFiles()
    except AnalysisException as gone:
        if gone.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return set()
    found = (re.search(rf"/batch=([^/]+)/{below}", file) for file in files)
    return {unquote(hit[1]) for hit in found if hit}


def index_batch(spark: SparkSession, results_path: str, name: str, keys: Sequence[str]) -> None:
    """Write the key hashes of one result folder, then the mark that they are complete."""
    rows = spark.read.parquet(f"{results_path}/batch={name}")
    out = f"{results_path}/{KEY_FOLDER}/batch={name}"
    hashes = rows.select(*[col.alias(n) for n, col in _hashed(keys).items()]).distinct()
    hashes.repartition("part").write.mode("overwrite").partitionBy("part").parquet(out)
    mark = spark.range(1).select(
        F.lit(None).cast("long").alias("_a"), F.lit(None).cast("long").alias("_b"), F.lit(-1).alias("part")
    )
    mark.write.mode("append").partitionBy("part").parquet(out)


def known_keys(
    spark: SparkSession, results_path: str, parts: Sequence[int], own: str
) -> DataFrame:
    """Key hashes ``(_a, _b)`` of all batches but ``own``, from the named parts only."""
    table = spark.read.schema("_a long, _b long, batch string, part int")
    table = table.parquet(f"{results_path}/{KEY_FOLDER}")
    return table.where(F.col("part").isin(list(parts)) & (F.col("batch") != own)).select("_a", "_b")


def unseen(fresh: DataFrame, results_path: str, own: str, keys: Sequence[str]) -> DataFrame:
    """Rows of ``fresh`` whose key no other batch of the table has. Result folders without
    a complete key index (an older table, a run that broke off) are indexed first. Only the
    parts that the batch touches are read, and the index is not shuffled for a small batch."""
    spark = fresh.sparkSession
    written = _batches(spark, results_path) - {own}
    if not written:
        return fresh
    for name in sorted(written - _batches(spark, f"{results_path}/{KEY_FOLDER}", "part=-1/")):
        index_batch(spark, results_path, name, keys)
    rows = materialize(fresh.withColumns(_hashed(keys)), "intake")
    parts = [r["part"] for r in rows.select("part").distinct().collect()]
    known = known_keys(spark, results_path, parts, own)
    hits = known.join(broadcast_if_small(rows.select("_a", "_b")), ["_a", "_b"], "left_semi")
    left = rows.join(broadcast_if_small(hits.distinct()), ["_a", "_b"], "left_anti")
    return left.select(*fresh.columns)


def intake(
    stream: DataFrame,
    results_path: str,
    keys: Sequence[str],
    checkpoint: str,
    work: Callable[[DataFrame], DataFrame] = lambda df: df,
    available_now: bool = True,
    order: Sequence[str] = (),
) -> StreamingQuery:
    """Append results of new keys to a Parquet table, batch by batch.

    Each micro-batch is compared with the keys in the table, whoever wrote them, so a new
    checkpoint over an old table adds to it. The keys are kept beside the results as 128-bit
    hashes in ``KEY_PARTS`` parts, a hidden folder that readers of the table do not see; a
    micro-batch reads only the parts of its own keys. A key counts once its result is written.
    A folder is named by checkpoint and batch number: a batch that runs again after a failure
    overwrites its own folders and nothing else. Of rows with equal keys in a batch the first
    by ``order`` is taken; without an order, the first by all columns.
    """

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{number}"
        fresh = first_by(batch, list(keys), [F.col(c) for c in order or batch.columns])
        fresh = unseen(fresh, results_path, own, keys)
        work(fresh).write.mode("overwrite").parquet(f"{results_path}/batch={own}")
        index_batch(spark, results_path, own, keys)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
