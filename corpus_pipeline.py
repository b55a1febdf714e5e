"""Corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. A stage works on all rows its predecessor kept. Side tables
(``labels``, ``benchmark``) are read from ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import decontaminate, lines, mixing, simhash, toxicity
from assayline.llm.common import materialize, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity model scores below 0.7; it learns from the rows of ``docs``.

    Null and empty texts score the bias alone and stay unless that is 0.7 or more.
    """
    scored = toxicity.score_documents(docs, read(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select("row.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three or more documents hold, the largest id aside.

    ``n_chars`` follows the text. A document whose lines all go stays with an empty text.
    """
    rows = lines.drop_frequent_lines(docs)
    row = F.col("row").withField("text", F.col("kept"))
    if "n_chars" in docs.columns:
        size = F.when(F.col("n_dropped") > 0, F.char_length("kept")).otherwise(F.col("row.n_chars"))
        row = row.withField("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return rows.select(row.alias("row")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: the smallest id."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window; null and empty texts have none."""
    rows = decontaminate.scan_documents(docs, read(spark, sf_dir, "benchmark"))
    return rows.where(F.size("found.hits") == 0).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, size, source_size, target, taken, source and training positions,
    range-sorted by the first position; documents that are not taken come last."""
    mixed = mixing.curriculum(docs)
    order = [F.try_element_at("positions", F.lit(1)).asc_nulls_last(), F.col("doc_id")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: The toxicity model and the fingerprints are not SQL; tests hold each stage against a
#: brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage but the last is stored in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
