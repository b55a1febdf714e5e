"""Evaluation flow: samples and recorded responses → filtered answers → per-sample
scores → task metrics → group roll-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.operators import aggregate, vote


def score_responses(
    samples: DataFrame,
    responses: DataFrame,
    chains: Mapping[str, Sequence[vote.Step]],
    metrics: Mapping[str, Column],
    keys: Sequence[str] = ("task", "doc_id"),
) -> DataFrame:
    """Long sample scores ``(keys, metric, filter, value)``.

    ``responses`` holds ``keys, idx, resp``; each chain leaves one ``resp`` per sample;
    the metric columns read ``resp`` and the columns of ``samples``.
    """
    filtered = vote.apply_filters(responses, chains).select(*keys, "filter", "resp")
    joined = samples.join(filtered, list(keys))
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), score.cast("double").alias("value"))
            for name, score in metrics.items()
        ]
    )
    return joined.select(*keys, "filter", F.inline(entries))


def evaluate(
    scores: DataFrame, edges: DataFrame | None = None, config: DataFrame | None = None
) -> DataFrame:
    """Metrics per task, and of the groups above them when a task tree is given."""
    tasks = aggregate.aggregate_metrics(scores)
    if edges is None:
        return tasks
    groups = aggregate.group_rollup(tasks, edges, config)
    return tasks.unionByName(groups.withColumnRenamed("group", "task"))
