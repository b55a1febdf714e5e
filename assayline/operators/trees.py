"""Search-tree tables: frontier, budget allocation, leaf paths, token totals.

Nodes are rows ``(question, id, parent_id, depth, score, leaf, num_step_tokens)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.operators.scale import first_k, ranked
from assayline.session import materialize


def path_table(
    nodes: DataFrame, question: str, score: str, tokens: str | None = None
) -> DataFrame:
    """Scores from the root's child to each node, and tokens summed on the way.

    Built level by level: every node joins its parent once, so the work over all
    levels is one pass over the nodes. The number of levels is the tree depth.
    """
    step = F.col(tokens) if tokens else F.lit(0).cast("long")
    keep = nodes.select(
        F.col(question).alias("_q"),
        F.col("id").alias("_id"),
        F.col("parent_id").alias("_p"),
        F.col("depth").alias("_d"),
        F.col(score).cast("double").alias("_s"),
        step.alias("_t"),
        "leaf",
    )
    # one folder per level, so that each level reads its own rows only
    keep = materialize(keep, "nodes", ["_d"])
    depths = keep.agg(F.max("_d")).first()[0]
    level = keep.where("_d = 0").select(
        "_q", "_id", "_d", "leaf",
        F.array().cast("array<double>").alias("step_scores"),
        F.col("_t").alias("cum_tokens"),
    )
    out = level
    for depth in range(1, (depths or 0) + 1):
        parent = level.select(
            "_q", F.col("_id").alias("_p"), "step_scores", "cum_tokens"
        )
        level = keep.where(F.col("_d") == depth).join(parent, ["_q", "_p"]).select(
            "_q", "_id", "_d", "leaf",
            F.array_append("step_scores", F.col("_s")).alias("step_scores"),
            (F.col("cum_tokens") + F.col("_t")).alias("cum_tokens"),
        )
        level = materialize(level, "paths")
        out = out.unionByName(level)
    return out.select(
        F.col("_q").alias(question),
        F.col("_id").alias("id"),
        F.col("_d").alias("depth"),
        "leaf", "step_scores", "cum_tokens",
    )


def path_scores(nodes: DataFrame, question: str, score: str = "score") -> DataFrame:
    """Step scores of every leaf, root excluded, in root-to-leaf order."""
    paths = path_table(nodes, question, score)
    return paths.where("leaf").select(question, "id", "step_scores")


def frontier(
    nodes: DataFrame, question: str, width: int, max_tokens: int, cum_tokens: str
) -> DataFrame:
    """Per question and depth: leaving nodes, open nodes, width left, and whether the
    search goes on. Leaves and over-budget nodes use up width for good."""
    leaves = F.col("leaf") | (F.col(cum_tokens) >= max_tokens)
    levels = nodes.groupBy(question, "depth").agg(
        F.count_if(leaves).alias("leaving"), F.count_if(~leaves).alias("open")
    )
    # one row per tree level from here on
    w = Window.partitionBy(question).orderBy("depth").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    left = F.lit(width) - F.sum("leaving").over(w)
    out = levels.withColumn("width_left", left)
    goes = (F.col("width_left") > 0) & (F.col("open") > 0)
    return out.withColumn("goes_on", F.min(goes.cast("int")).over(w) == 1)


def allocate(
    df: DataFrame,
    keys: Sequence[str],
    node: str,
    score: str,
    width: int,
    temperature: float = 1.0,
    keep_ratio: float | None = None,
) -> DataFrame:
    """Expansions per node of a frontier: best score first, each node takes
    ``ceil(width left * weight / weight left)`` of what is left.

    Every node reached with width left takes at least one, so only the best
    ``width`` nodes can get any; they alone are folded, the others get 0. Equal
    scores: the larger node id goes first.
    """
    order = [F.col(score).desc(), F.col(node).desc()]
    rows = df
    if keep_ratio is not None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        unique = [*order, *[F.col(k) for k in keys]]
        rows = (
            ranked(df, keys, unique, "_place")
            .join(sizes, list(keys))
            .where(F.col("_place") <= F.ceil(F.col("_n") * keep_ratio))
            .select(*df.columns)
        )
    weight = F.exp(F.col(score) / temperature)
    totals = rows.groupBy(*keys).agg(F.sum(weight).alias("_sum"))
    top = first_k(rows, keys, order, width, "_rn")
    lists = top.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct("_rn", F.col(node).alias("n"), weight.alias("w")))
        ).alias("_top")
    )
    given = F.aggregate(
        "_top",
        F.struct(
            F.lit(width).cast("long").alias("left"),
            F.col("_sum").alias("sum"),
            F.array().cast("array<bigint>").alias("out"),
        ),
        lambda st, x: _take(st, x),
        lambda st: st["out"],
    )
    picked = (
        lists.join(totals, list(keys))
        .select(*keys, F.inline(F.arrays_zip(F.col("_top.n").alias("n"), given.alias("expand"))))
        .withColumnRenamed("n", node)
    )
    return rows.join(picked, [*keys, node], "left").withColumn(
        "expand", F.coalesce("expand", F.lit(0).cast("long"))
    )


def _take(state: Column, node: Column) -> Column:
    share = state["left"] * node["w"] / F.greatest(state["sum"], node["w"])
    # the small slack keeps rounding of the running sum from adding one
    number = F.least(state["left"], F.ceil(share - 1e-9).cast("long"))
    return F.struct(
        (state["left"] - number).alias("left"),
        (state["sum"] - node["w"]).alias("sum"),
        F.array_append(state["out"], number).alias("out"),
    )


def token_totals(nodes: DataFrame, question: str, tokens: str) -> DataFrame:
    """Generated tokens per question and overall (null question)."""
    return nodes.rollup(question).agg(F.sum(tokens).alias("total_tokens"))
