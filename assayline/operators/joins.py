"""Key joins between questions, traces, verdicts, lengths and predictions.

All are equi joins without hints: lookups counted as small are broadcast, the rest
is left to the shuffle join, whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.operators.scale import broadcast_if_small
from assayline.session import materialize


def question_hash(col: Column) -> Column:
    """Stable row key: first 16 hex characters of SHA-256."""
    return F.substring(F.sha2(col, 256), 1, 16)


def attach_attempts(
    questions: DataFrame, answers: DataFrame, key: str = "qhash"
) -> DataFrame:
    """Attach traces and attempts; questions without one are dropped."""
    return questions.join(answers, key, "inner")


def verdict_flag(grade: Column) -> Column:
    """Yes is true, No is false, everything else is null."""
    return F.when(grade == "Yes", True).when(grade == "No", False)


def attach_grade(
    questions: DataFrame,
    grades: DataFrame,
    col: str,
    key: str = "qhash",
    solution: str = "solution",
    grade: str = "grade",
) -> DataFrame:
    """Attach a verdict; null when it is missing or there is no solution."""
    side = grades.select(key, F.col(grade).alias("_grade"))
    flag = F.when(F.col(solution).isNotNull(), verdict_flag(F.col("_grade")))
    return questions.join(side, key, "left").withColumn(col, flag).drop("_grade")


def attach_domain(
    questions: DataFrame,
    codes_of: DataFrame,
    titles: DataFrame,
    key: str = "qhash",
    code: str = "code",
    title: str = "title",
    name: str = "domain",
) -> DataFrame:
    """Attach the category title through the code table; unknown codes give null."""
    side = broadcast_if_small(titles.select(code, F.col(title).alias(name)))
    return (
        questions.join(codes_of.select(key, code), key, "left")
        .join(side, code, "left")
        .drop(code)
    )


def attach_length(
    questions: DataFrame, lengths: DataFrame, length: str, key: str = "qhash"
) -> DataFrame:
    return questions.join(lengths.select(key, length), key, "left")


def exclude(df: DataFrame, held: DataFrame, col: str) -> DataFrame:
    """Rows whose value is not in the held-out set; nulls count as equal."""
    side = held.select(F.col(col).alias("_held")).distinct()
    return df.join(
        broadcast_if_small(side), F.equal_null(df[col], F.col("_held")), "left_anti"
    )


def keep_listed(df: DataFrame, listed: DataFrame | Sequence, col: str) -> DataFrame:
    """Rows whose value is in a table or a literal list."""
    if not isinstance(listed, DataFrame):
        return df.where(F.col(col).isin(list(listed)))
    return df.join(broadcast_if_small(listed.select(col).distinct()), col, "left_semi")


def _upper_tail(z: Column) -> Column:
    """P(N > z) for z >= 0: rational approximation of the error function, error
    below 1.5e-7 (Abramowitz and Stegun 7.1.26)."""
    # fixed values: coefficients of the approximation
    p = 0.3275911
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = z / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + p * x)
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    return 0.5 * poly * F.exp(-x * x)


def compare_runs(
    a: DataFrame,
    b: DataFrame,
    alpha: float = 0.05,
    task: str = "task",
    value: str = "value",
    stderr: str = "stderr",
) -> DataFrame:
    """Per task: difference, z score, two-sided p, and whether p exceeds ``alpha``."""
    left = a.select(task, F.col(value).alias("value_a"), F.col(stderr).alias("se_a"))
    right = b.select(task, F.col(value).alias("value_b"), F.col(stderr).alias("se_b"))
    diff = F.col("value_a") - F.col("value_b")
    spread = F.sqrt(F.col("se_a") * F.col("se_a") + F.col("se_b") * F.col("se_b"))
    z = F.try_divide(diff, spread)
    return (
        left.join(right, task)
        .withColumns({"diff": diff, "z": z, "p_value": 2 * _upper_tail(F.abs(z))})
        .withColumn("same", F.col("p_value") > alpha)
    )


SHALLOW = 16  # up to this depth the groups need not be counted to rule out a cycle


def leaf_tasks(
    edges: DataFrame, parent: str = "group", child: str = "child"
) -> DataFrame:
    """Leaf tasks below every group, as rows ``(group, task)``.

    Path doubling: after round k the table holds the leaves at most 2^k steps below a group
    and the inner nodes exactly 2^k steps below it; joining it to itself doubles both. Depth d
    takes log2(d) rounds. A node is a leaf when it has no children; paths that meet again are
    merged in every round. A group below itself is an error.
    """
    steps = edges.select(F.col(parent).alias("group"), F.col(child).alias("task")).distinct()
    inner = steps.select(F.col("group").alias("task"), F.lit(False).alias("_inner")).distinct()
    leaf = F.coalesce(F.col("_inner"), F.lit(True)).alias("leaf")
    reach = materialize(steps.join(inner, "task", "left").select("group", "task", leaf), "reach")
    span = 1
    while True:
        jumps = reach.where("NOT leaf").select("group", F.col("task").alias("_over"))
        if jumps.isEmpty():
            return reach.select("group", "task")
        if span >= SHALLOW and span >= inner.count():
            raise ValueError("the groups form a cycle")
        further = reach.select(F.col("group").alias("_over"), "task", "leaf")
        further = jumps.join(further, "_over").select("group", "task", "leaf")
        reach = materialize(reach.where("leaf").unionByName(further).distinct(), "reach")
        span *= 2


def join_predictions(
    samples: DataFrame, predictions: DataFrame, keys: Sequence[str] = ("task", "index")
) -> DataFrame:
    """Predictions joined by their stored position, never by row order."""
    return samples.join(predictions, list(keys), "inner")
