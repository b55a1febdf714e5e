"""Result tables: metric report, sample report and task overview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def report_table(results: DataFrame) -> DataFrame:
    """Long report of ``task, version, filter, shots, metric, higher_is_better, value,
    stderr``: sorted metrics, four decimals, the task named in the first row only.

    There is one row per task and metric, so the windows are as small as a report.
    """
    place = Window.partitionBy("task").orderBy("metric", "filter")
    first = F.row_number().over(place) == 1
    known = F.col("stderr").isNotNull()
    up = F.col("higher_is_better")
    return results.select(
        F.col("task").alias("block"),
        F.row_number().over(place).alias("line"),
        F.when(first, F.col("task")).otherwise("").alias("Tasks"),
        F.when(first, F.coalesce(F.col("version").cast("string"), F.lit("    N/A")))
        .otherwise("")
        .alias("Version"),
        F.col("filter").alias("Filter"),
        F.col("shots").cast("string").alias("n-shot"),
        F.col("metric").alias("Metric"),
        F.when(up, "↑").when(~up, "↓").otherwise("").alias("direction"),
        F.format_string("%.4f", F.col("value")).alias("Value"),
        F.lit("±").alias("±"),
        F.when(known, F.format_string("%.4f", F.col("stderr"))).otherwise("   N/A").alias("Stderr"),
    )


def split_metrics(results: DataFrame, task: str, metrics: str) -> DataFrame:
    """Rows ``task, metric, filter, value, stderr`` from a map keyed ``metric,filter``,
    the errors being under ``metric_stderr,filter``."""
    long = results.select(task, F.explode(metrics).alias("_k", "_v"))
    name, part = F.split_part("_k", F.lit(","), F.lit(1)), F.split_part("_k", F.lit(","), F.lit(2))
    is_error = name.endswith("_stderr")
    rows = long.select(
        task,
        F.regexp_replace(name, "_stderr$", "").alias("metric"),
        part.alias("filter"),
        F.when(~is_error, F.col("_v")).alias("_value"),
        F.when(is_error, F.col("_v")).alias("_error"),
    )
    return rows.groupBy(task, "metric", "filter").agg(
        F.max("_value").alias("value"), F.max("_error").alias("stderr")
    )


def sample_report(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per sample whatever its output kind.

    Reads output_type, doc_id, prompt, target, choices, lls, resp, filtered_resp; the
    label of a multiple-choice sample is its target choice, the prediction its most
    likely one.
    """
    from assayline.functions.scores import argmax

    kind = F.col("output_type")
    choice = kind == "multiple_choice"
    place = F.col("target").try_cast("int")
    lettered = lambda i: F.get("choices", i)
    cols: list[Column] = [
        F.col("doc_id").alias("id"),
        F.col("prompt").alias("data"),
        F.length("prompt").alias("input_len"),
        kind.alias("output_type"),
        F.when(choice, lettered(place)).otherwise(F.col("target")).alias("label"),
        F.when(choice, F.array_join("choices", "\n")).alias("choices"),
        F.when(choice, lettered(argmax(F.col("lls"))))
        .when(kind == "generate_until", F.col("resp"))
        .otherwise(F.get("lls", F.lit(0)).cast("string"))
        .alias("raw_prediction"),
        F.when(kind == "generate_until", F.col("filtered_resp"))
        .when(choice, F.array_join(F.transform("lls", lambda x: F.round(x, 4).cast("string")), ","))
        .alias("filtered_prediction"),
    ]
    return df.select(*cols, *metrics)


def task_overview(
    docs: DataFrame, task: str, split: str, metric_list: DataFrame
) -> DataFrame:
    """Per task: which splits exist, evaluated documents (test, else validation), and
    its metric names."""
    has = lambda s: F.max((F.col(split) == s).cast("int"))
    count = lambda s: F.count_if(F.col(split) == s)
    sizes = docs.groupBy(task).agg(
        *[has(s).alias(s) for s in ("train", "validation", "test")],
        F.when(count("test") > 0, count("test")).otherwise(count("validation")).alias("docs"),
    )
    names = metric_list.groupBy(task).agg(
        F.array_join(F.array_sort(F.collect_set("metric")), ", ").alias("metrics")
    )
    mark = lambda c: F.when(F.col(c) == 1, "✓").otherwise(" ").alias(c)
    return sizes.join(names, task, "left").select(
        task, mark("train"), mark("validation"), mark("test"), "docs", "metrics"
    )
