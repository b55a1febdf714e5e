"""Unions, differences, intersections, sorts and limits."""

from __future__ import annotations

from collections.abc import Sequence
from fnmatch import translate as glob_pattern
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.operators.scale import broadcast_if_small, first_k


def union_sources(dfs: Sequence[DataFrame]) -> DataFrame:
    """Bag union in order; ``source_rank`` keeps the order of the sources."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(dfs)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def minus(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not in ``ids``."""
    return df.join(broadcast_if_small(ids.select(*keys).distinct()), list(keys), "left_anti")


def common_tasks(df: DataFrame, task: str, model: str, n_models: int | None = None) -> DataFrame:
    """Tasks that every model has results for."""
    wanted = n_models if n_models is not None else df.select(model).distinct().count()
    per_task = df.groupBy(task).agg(F.count_distinct(model).alias("models"))
    return per_task.where(F.col("models") == wanted).select(task)


def sort_top(df: DataFrame, keys: Sequence[Column | str], n: int | None = None) -> DataFrame:
    out = df.orderBy(*keys)
    return out if n is None else out.limit(n)


def match_names(df: DataFrame, col: str, globs: Sequence[str]) -> DataFrame:
    """Distinct names that match any wildcard pattern, sorted."""
    cond = F.lit(False)
    for pattern in globs:
        cond = cond | F.col(col).rlike("^" + _java(pattern) + "$")
    return df.where(cond).select(col).distinct().orderBy(col)


def _java(pattern: str) -> str:
    """Wildcard pattern as a regular expression both dialects read."""
    body = glob_pattern(pattern)
    return body.removeprefix("(?s:").rsplit(")", 1)[0]


def head_rows(df: DataFrame, keys: Sequence[str], row_idx: str, n: int) -> DataFrame:
    """First ``n`` rows per task."""
    return first_k(df, keys, [F.col(row_idx)], n, "_pos").drop("_pos")
