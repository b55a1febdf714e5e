"""Response selection, voting, coverage and step scores.

Input is one row per response: ``keys`` name the question, ``idx`` is a unique
integer giving the order in which the responses came.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.operators import leaders
from assayline.operators.scale import broadcast_if_small, first_by, first_k, running
from assayline.session import materialize

Step = Callable[[DataFrame], DataFrame]


def take_first(df: DataFrame, keys: Sequence[str], idx: str) -> DataFrame:
    return first_by(df, keys, [F.col(idx)])


def short_groups(df: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Questions with fewer than ``k`` responses."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


def take_first_k(
    df: DataFrame, keys: Sequence[str], idx: str, k: int, check: bool = True
) -> DataFrame:
    """First ``k`` responses; with ``check`` a question with fewer is an error."""
    if check and not short_groups(df, keys, k).isEmpty():
        raise ValueError(f"some questions have fewer than {k} responses")
    lead = F.coalesce(F.col(idx).cast("double"), F.lit(float("-inf")))
    return first_k(df, keys, [F.col(idx)], k, lead=lead)


def majority_vote(
    df: DataFrame, keys: Sequence[str], idx: str, answer: str
) -> DataFrame:
    """Most frequent answer; ties go to the answer seen first."""
    votes = df.groupBy(*keys, answer).agg(
        F.count(F.lit(1)).alias("votes"), F.min(idx).alias("_first")
    )
    best = F.max_by(
        F.struct(answer, "votes"), F.struct(F.col("votes"), -F.col("_first"))
    )
    return votes.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def apply_filters(df: DataFrame, chains: Mapping[str, Sequence[Step]]) -> DataFrame:
    """Several named filter chains over the same responses, stacked with a name."""
    out = None
    for name, steps in chains.items():
        part = df
        for step in steps:
            part = part.transform(step)
        part = part.withColumn("filter", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def agg_steps(scores: Column, how: str, version: int = 1) -> Column:
    """One score from the step scores; an empty list gives 0.

    Version 1: min starts at 1 and skips nulls, mean and product become null with a
    null step. Version 2 skips nulls everywhere. ``last`` reads a null as 0.
    """
    known = F.filter(scores, lambda s: s.isNotNull())
    used = scores if version == 1 else known
    zero = F.lit(0.0)
    total = F.aggregate(used, F.lit(0.0), lambda acc, s: acc + s)
    if how == "min":
        low = F.array_min(known)
        value = F.least(F.coalesce(low, F.lit(1.0)), F.lit(1.0)) if version == 1 else low
    elif how == "mean":
        value = F.when(F.size(used) == 0, zero).otherwise(total / F.size(used))
    elif how == "prod":
        value = F.aggregate(used, F.lit(1.0), lambda acc, s: acc * s)
    elif how == "last":
        value = F.coalesce(F.get(scores, F.size(scores) - 1), zero)
    else:
        raise ValueError(f"unknown step aggregation: {how}")
    return F.when(F.size(scores) == 0, zero).otherwise(value)


def best_of_n(
    df: DataFrame, keys: Sequence[str], idx: str, answer: str, score: str
) -> DataFrame:
    """Answer of the first response with the largest score."""
    best = F.max_by(F.struct(answer, score), F.struct(F.col(score), -F.col(idx)))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def answer_links(
    df: DataFrame, keys: Sequence[str], answer: str, forms: Sequence[Callable[[Column], Column]]
) -> DataFrame:
    """One row per form an answer has, with a text that names question, form and value."""
    parts = [F.struct(F.lit(i).alias("form"), f(F.col(answer)).alias("value")) for i, f in enumerate(forms)]
    spread = df.withColumn("_form", F.explode(F.array(*parts))).where("_form.value IS NOT NULL")
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    link = F.to_json(F.struct(*named, "_form.form", F.col("_form.value").cast("string").alias("value")))
    return spread.withColumn("_link", link).drop("_form")


def leader_classes(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    answer: str,
    forms: Sequence[Callable[[Column], Column]],
) -> DataFrame:
    """Classes of the answers of a question: rows ``(keys, answer, _class, _since)``.

    Two answers are equal if any of ``forms`` maps them to one value, which is not
    transitive. In order of first use, an answer opens a class unless an earlier opener is
    equal to it; it belongs to every class whose opener it equals, and does not merge them
    if these are two. ``_since`` is the first use of the opener. An answer
    without any form (null) is in no class. Only distinct answers are compared, by their
    forms; no pairs of answers are made.
    """
    used = df.where(F.col(answer).isNotNull()).groupBy(*keys, answer).agg(F.min(idx).alias("_since"))
    links = materialize(answer_links(used, keys, answer, forms), "answer-links")
    place = [*keys, answer]
    joined = leaders.displaced(links, place, "_since", "_link")
    openers = links.join(
        broadcast_if_small(leaders.side(joined, place)), leaders.same(place), "left_anti"
    ).select("_link", F.col(answer).alias("_class"), "_since")
    members = links.drop("_since").join(broadcast_if_small(openers), "_link")
    return members.drop("_link").distinct()


def weighted_vote(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    answer: str,
    weight: Column | None = None,
    same: Callable[[Column], Column] | None = None,
    forms: Sequence[Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Vote over answer classes by running weight (plain vote: every weight is 1).

    Answers are of one class if ``same`` maps them to one value (the answer itself if not
    given; ``answers.answer_class`` for graded equality). With ``forms`` the classes are those
    of ``leader_classes``: a response adds its weight to every class open by then that it
    equals, and an answer without a form is always new. The text shown is that of the
    response with which the class took the lead.

    The lead changes only when a *repeated* answer's running weight exceeds the best
    so far; an unrepeated answer leads only while the best is still zero. Weights
    must not be negative. So the winner is the first response that has weight, or
    the repeat with the largest running weight if that is strictly larger; with no
    weight at all, the last answer that was new.
    """
    one = F.lit(1).cast("long")
    rows = df.select(
        *keys,
        idx,
        answer,
        (F.lit(1.0) if weight is None else weight).cast("double").alias("_w"),
        (same or (lambda a: a))(F.col(answer)).alias("_class"),
    )
    if forms is not None:
        place = [*keys, answer]
        found = leader_classes(df, keys, idx, answer, forms)
        named = {c: f"_k{i}" for i, c in enumerate(place)}
        found = found.withColumnsRenamed(named)
        open_by_then = leaders.same(place) & (F.col(idx) >= F.col("_since"))
        rows = rows.drop("_class").join(broadcast_if_small(found), open_by_then, "left")
        rows = rows.drop("_since", *named.values())
        rows = materialize(rows, "classed")
    rows = running(rows, [*keys, "_class"], idx, {"_run": F.col("_w"), "_seen": one})
    if forms is not None:
        alone = F.col("_class").isNull()
        rows = rows.withColumns({
            "_run": F.when(alone, F.col("_w")).otherwise(F.col("_run")),
            "_seen": F.when(alone, one).otherwise(F.col("_seen")),
        })
    is_repeat, order = F.col("_seen") > 1, -F.col(idx)
    cell = F.struct(F.col("_run").alias("run"), order.alias("o"), F.col(answer).alias("a"))
    opening = F.struct(F.col(idx).alias("i"), F.col("_run").alias("run"), F.col(answer).alias("a"))
    newest = F.struct(F.col(idx).alias("i"), F.col(answer).alias("a"))
    out = rows.groupBy(*keys).agg(
        F.max(F.when(is_repeat, cell)).alias("_rep"),
        F.min(F.when(F.col("_w") > 0, opening)).alias("_open"),
        F.max(F.when(~is_repeat, newest)).alias("_new"),
    )
    overtaken = F.col("_rep.run") > F.col("_open.run")
    winner = (
        F.when(F.col("_open").isNull(), F.col("_new.a"))
        .when(F.coalesce(overtaken, F.lit(False)), F.col("_rep.a"))
        .otherwise(F.col("_open.a"))
    )
    vote = (
        F.when(F.col("_open").isNull(), F.lit(0.0))
        .when(F.coalesce(overtaken, F.lit(False)), F.col("_rep.run"))
        .otherwise(F.col("_open.run"))
    )
    return out.select(*keys, winner.alias(answer), vote.alias("vote"))


def cov_maj_at_n(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    answer: str,
    truth: str,
    ns: Sequence[int] = (2, 4, 8, 16, 32, 64),
) -> DataFrame:
    """Per question ``cov_n`` (any right answer) and ``maj_n`` (majority right) over
    the first n responses; null when there are fewer than n."""
    top = first_k(df, keys, [F.col(idx)], max(ns), "_pos")
    spread = top.withColumn(
        "_n", F.explode(F.filter(F.array(*[F.lit(n) for n in ns]), lambda n: n >= F.col("_pos")))
    )
    votes = spread.groupBy(*keys, "_n", answer, truth).agg(
        F.count(F.lit(1)).alias("_v"), F.min("_pos").alias("_f")
    )
    right = (F.col(answer) == F.col(truth)).cast("int")
    per_n = votes.groupBy(*keys, "_n").agg(
        F.sum("_v").alias("_have"),
        F.max(right).alias("cov"),
        F.max_by(right, F.struct(F.col("_v"), -F.col("_f"))).alias("maj"),
    ).where(F.col("_have") == F.col("_n"))
    return per_n.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_n") == n, F.col(m))).alias(f"{m}_{n}") for n in ns for m in ("cov", "maj")]
    )
