"""Readers for question sets, corpora and recorded results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayline.operators.scale import broadcast_if_small

FILE_STEM = r"([^/]+?)(?:\.[^./]+)?$"


def file_name() -> Column:
    return F.col("_metadata.file_name")


def _text_field(row: Column, name: str) -> Column:
    """Field of a variant as text; missing gives the empty text."""
    return F.coalesce(F.try_variant_get(row, f"$.{name}", "string"), F.lit(""))


def read_qa(spark: SparkSession, path: str, question: str, answer: str) -> DataFrame:
    """Question and answer text from JSON lines (``*.jsonl``) or JSON files holding a
    list, or an object with the list under ``data`` or ``rows``."""
    if path.rstrip("/").endswith(".jsonl"):
        lines = spark.read.text(path).where(F.trim("value") != "")
        rows = lines.select(F.parse_json("value").alias("row"))
    else:
        whole = spark.read.text(path, wholetext=True)
        doc = F.parse_json("value")
        listed = F.coalesce(
            F.try_variant_get(doc, "$.data", "array<variant>"),
            F.try_variant_get(doc, "$.rows", "array<variant>"),
            F.try_variant_get(doc, "$", "array<variant>"),
        )
        rows = whole.select(F.explode(listed).alias("row"))
    row = F.col("row")
    return rows.select(
        _text_field(row, question).alias("question"), _text_field(row, answer).alias("answer")
    )


def read_split(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """A stored table. ``spread`` reshuffles a table with fewer partitions than cores,
    for work that is heavy per row; large tables are left as they are."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if spread and df.rdd.getNumPartitions() < cores else df


def read_ordered(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet sources as one table with the places of their rows: ``source_rank`` is the
    position in ``paths``, ``row_idx`` counts from 0 by file name and row in the file.

    Places are the same on every run and partitioning. Rows are not shuffled: only one row
    per file is counted up, and joined back by file. Sources need the same columns; a
    source without rows adds none.
    """
    parts = []
    for rank, path in enumerate(paths):
        rows = spark.read.parquet(path).withColumns(
            {"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}
        )
        files = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_n"))
        earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
        placed = rows.join(broadcast_if_small(files.select("_file", start)), "_file")
        place = {"source_rank": F.lit(rank), "row_idx": F.col("_start") + F.col("_row")}
        parts.append(placed.withColumns(place).drop("_file", "_row", "_start"))
    return reduce(DataFrame.unionByName, parts)


def read_subject_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Header-less CSV files, one per subject; the subject is the file stem without a
    trailing ``_test``, ``_dev`` or ``_val``. Files in folders ``subject=...`` take it
    from there."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    stem = F.regexp_replace(F.regexp_extract(file_name(), FILE_STEM, 1), "_(test|dev|val)$", "")
    rows = spark.read.csv(path, schema=schema, header=False, multiLine=True, escape='"')
    if "subject" not in rows.columns:
        rows = rows.withColumn("subject", stem)
    return rows.select("subject", *columns)


def read_corpus(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Corpus files of JSON lines, ``.zst`` compressed or plain: a line is a text or an
    object with ``text`` (a list is joined by blank lines) and optional ``meta`` (a text
    as it is, anything else as JSON with sorted keys, ``{}`` if missing). A folder may hold
    both kinds of files. Blank lines are left out; a line without text gives a null.

    Spark's text reader opens both kinds and decompresses as a stream, all frames of a file
    one after the other, so a file may have any size. A compressed file is one task, as its
    frames cannot be found without reading it; a plain one is split.
    """
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    row = F.parse_json("value")
    parts = F.try_variant_get(row, "$.text", "array<string>")
    bare = F.when(F.schema_of_variant(row) == "STRING", F.try_variant_get(row, "$", "string"))
    whole = F.coalesce(F.try_variant_get(row, "$.text", "string"), bare)
    meta = F.try_variant_get(row, "$.meta", "string")
    return lines.select(
        F.coalesce(F.array_join(parts, "\n\n"), whole).alias("text"),
        F.coalesce(meta, F.lit("{}")).alias("meta"),
        file_name().alias("file"),
    )


def read_keyed_json(spark: SparkSession, path: str, schema: str, key: str = "key") -> DataFrame:
    """A folder of JSON results, one file per key; the key is the file stem."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.withColumn(key, F.regexp_extract(file_name(), FILE_STEM, 1))


def combine_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON result files of a folder as one table."""
    return spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter="*.json")


def merge_shards(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Shard files of JSON lines that exist, ordered by task and index."""
    merged = spark.createDataFrame([], schema)
    for path in paths:
        try:
            merged = merged.unionByName(spark.read.schema(schema).json(path))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    return merged.orderBy("task", "index")


def latest_results(df: DataFrame, model: str, file: str) -> DataFrame:
    """Latest results file per model, by the timestamp in its name."""
    stamp = F.regexp_extract(file, r"(\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}(?:\.\d+)?)", 1)
    named = df.withColumn("_stamp", stamp).where("_stamp <> ''")
    return named.groupBy(model).agg(
        F.max_by(file, "_stamp").alias(file), F.max("_stamp").alias("stamp")
    )
