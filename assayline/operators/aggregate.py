"""Metrics over many samples: means, errors, F1, roll-ups and statistics."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.functions.text import words
from assayline.operators.joins import leaf_tasks
from assayline.operators.scale import first_k, ranked, running, running_in_order


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def accuracy_by_task(df: DataFrame, task: str, grade: str) -> DataFrame:
    """Total, graded, correct and accuracy per task and overall (null task).

    Rows without a grade count in the denominator.
    """
    return (
        df.rollup(task)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col(grade).isin("Yes", "No")).alias("graded"),
            F.count_if(F.col(grade) == "Yes").alias("correct"),
        )
        .withColumn("accuracy", F.round(F.try_divide(F.col("correct"), F.col("total")), 4))
    )


def agg_mean(value: Column) -> Column:
    return F.avg(value)


def agg_bypass(value: Column) -> Column:
    """Constant -1 for metrics that are computed elsewhere."""
    return F.max(F.lit(-1))


def agg_mean_last(
    df: DataFrame, keys: Sequence[str], idx: str, value: str, last: int = 30
) -> DataFrame:
    """Mean of the last rows per key; -1 when there are fewer."""
    tail = first_k(df, keys, [F.col(idx).desc()], last, "_rn")
    mean = F.when(F.count(F.lit(1)) < last, F.lit(-1.0)).otherwise(F.avg(value))
    return tail.groupBy(*keys).agg(mean.alias("mean_last"))


def agg_median(value: Column) -> Column:
    """True median as an aggregate; its buffer holds the distinct values of a group, so
    use ``median`` where a group may be large."""
    return F.percentile(value, 0.5)


def median(
    df: DataFrame, keys: Sequence[str], value: str, accuracy: int = 100_000
) -> DataFrame:
    """True median per key for groups of any size.

    An approximate quantile sketch brackets the middle, exactly counted rows below the
    bracket give its offset, and only values inside it are put in order.
    """
    slack = min(2.0 / accuracy, 0.5)
    bracket = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.percentile_approx(value, [0.5 - slack, 0.5 + slack], accuracy).alias("_b"),
        F.count(F.lit(1)).alias("_n"),
    )
    # null keys are groups as well
    bracket = bracket.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = df.select(*keys, F.col(value).alias("_v"))
    rows = rows.join(bracket, same) if keys else rows.crossJoin(bracket)  # one bracket row
    low, high = F.col("_b")[0], F.col("_b")[1]
    # everything below the bracket merges into one row with a null value
    near = (
        rows.where(F.col("_v") <= high)
        .withColumn("_v", F.when(F.col("_v") >= low, F.col("_v")))
        .groupBy(*keys, "_n", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    order = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    frame = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = near.withColumn("_upto", F.sum("_c").over(frame))
    before = F.col("_upto") - F.col("_c")

    def value_at(place: Column) -> Column:
        return F.max(F.when((before < place) & (place <= F.col("_upto")), F.col("_v")))

    first, last = F.floor((F.col("_n") - 1) / 2) + 1, F.floor(F.col("_n") / 2) + 1
    return placed.groupBy(*keys).agg(((value_at(first) + value_at(last)) / 2).alias("median"))


def middle_element(
    df: DataFrame, keys: Sequence[str], idx: str, value: str
) -> DataFrame:
    """Element at position n // 2 in input order, unsorted (compatible median)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(df, keys, idx, {"_pos": F.lit(1).cast("long")})
    hit = placed.join(sizes, list(keys)).where(
        F.col("_pos") - 1 == F.floor(F.col("_n") / 2)
    )
    return hit.select(*keys, F.col(value).alias("median"))


def perplexity(ll: Column) -> Column:
    return F.exp(-F.avg(ll))


def weighted_perplexity(ll: Column, weight: Column) -> Column:
    return F.exp(-F.sum(ll) / F.sum(weight))


def bits_per_byte(ll: Column, size: Column) -> Column:
    return -(F.sum(ll) / F.sum(size)) / F.log(F.lit(2.0))


def label_counts(
    df: DataFrame, gold: str, pred: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Per label: true positives, false positives, false negatives, support."""
    pairs = df.groupBy(*keys, gold, pred).agg(F.count(F.lit(1)).alias("_n"))
    n, zero = F.col("_n"), F.lit(0).cast("long")
    hit = F.col(gold) == F.col(pred)
    sides = F.array(
        F.struct(
            F.col(gold).alias("label"),
            F.when(hit, n).otherwise(zero).alias("tp"),
            zero.alias("fp"),
            F.when(hit, zero).otherwise(n).alias("fn"),
            n.alias("support"),
            zero.alias("predicted"),
        ),
        F.struct(
            F.col(pred).alias("label"),
            zero.alias("tp"),
            F.when(hit, zero).otherwise(n).alias("fp"),
            zero.alias("fn"),
            zero.alias("support"),
            n.alias("predicted"),
        ),
    )
    long = pairs.select(*keys, F.inline(sides))
    return long.groupBy(*keys, "label").agg(
        *[F.sum(c).alias(c) for c in ["tp", "fp", "fn", "support", "predicted"]]
    )


def f1(
    df: DataFrame,
    gold: str,
    pred: str,
    average: str = "binary",
    labels: Sequence | None = None,
    positive: int | str = 1,
    keys: Sequence[str] = (),
) -> DataFrame:
    """F1: ``binary``, ``macro``, ``micro`` or ``weighted``; ``labels`` restricts the
    averaged labels (a label without any row counts as 0 in a macro mean)."""
    per = label_counts(df, gold, pred, keys)
    if average == "binary":
        labels = [positive]
    if labels is not None:
        per = per.where(F.col("label").isin(list(labels)))
    double_tp = 2.0 * F.col("tp")
    one = F.coalesce(
        F.try_divide(double_tp, double_tp + F.col("fp") + F.col("fn")), F.lit(0.0)
    )
    if average == "micro":
        pooled = 2.0 * F.sum("tp")
        score = F.try_divide(pooled, pooled + F.sum("fp") + F.sum("fn"))
    elif average == "weighted":
        score = F.try_divide(F.sum(one * F.col("support")), F.sum("support"))
    elif labels is not None:
        score = F.sum(one) / len(labels)
    else:
        score = F.avg(one)
    return per.groupBy(*keys).agg(F.coalesce(score, F.lit(0.0)).alias("f1"))


def mcc(df: DataFrame, gold: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Matthews correlation for any number of labels; 0 when undefined."""
    per = label_counts(df, gold, pred, keys)
    p, t = F.col("predicted").cast("double"), F.col("support").cast("double")
    sums = per.groupBy(*keys).agg(
        F.sum("tp").cast("double").alias("c"),
        F.sum(t).alias("s"),
        F.sum(p * t).alias("pt"),
        F.sum(p * p).alias("pp"),
        F.sum(t * t).alias("tt"),
    )
    s2 = F.col("s") * F.col("s")
    below = F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))
    score = F.try_divide(F.col("c") * F.col("s") - F.col("pt"), below)
    return sums.select(*keys, F.coalesce(score, F.lit(0.0)).alias("mcc"))


def brier(probs: Column, gold: Column) -> Column:
    """Aggregate: mean over rows of the squared distance to the one-hot gold."""
    parts = F.transform(
        probs, lambda p, i: F.pow(p - F.when(i == gold, 1.0).otherwise(0.0), 2)
    )
    return F.avg(F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x))


def acc_all(df: DataFrame, keys: Sequence[str], right: str) -> DataFrame:
    """Share of groups in which every row is right, with its standard error."""
    groups = df.groupBy(*keys).agg(F.bool_and(right).cast("double").alias("_ok"))
    return groups.agg(
        F.avg("_ok").alias("acc"),
        F.count(F.lit(1)).alias("n_groups"),
        mean_stderr(F.col("_ok")).alias("stderr"),
    )


def group_em(df: DataFrame, key: str, gold: str, pred: str) -> DataFrame:
    """Share of groups whose labels are all predicted, in percent."""
    groups = df.groupBy(key).agg(
        F.bool_and(F.col(gold) == F.col(pred)).cast("double").alias("_ok")
    )
    return groups.agg((100 * F.avg("_ok")).alias("em"))


def qa_suite(
    df: DataFrame, doc: str, exact: str, f1_col: str, has_answer: str, empty: str, na_prob: str
) -> DataFrame:
    """One row: exact and F1 over all, answerable and unanswerable rows, and the best
    value over a threshold on the no-answer probability. All in percent."""
    has = F.col(has_answer)

    def pct(col: str, cond: Column | None = None) -> Column:
        value = F.col(col).cast("double")
        return 100 * F.avg(value if cond is None else F.when(cond, value))

    plain = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~has).alias("_na"),
        pct(exact).alias("exact"),
        pct(f1_col).alias("f1"),
        pct(exact, has).alias("has_ans_exact"),
        pct(f1_col, has).alias("has_ans_f1"),
        pct(exact, ~has).alias("no_ans_exact"),
        pct(f1_col, ~has).alias("no_ans_f1"),
    )
    # rows by rising no-answer probability; answering a row changes the score by step
    penalty = F.when(F.col(empty), 0.0).otherwise(-1.0)
    steps = {
        f"_run_{name}": F.when(has, F.col(col).cast("double")).otherwise(penalty)
        for name, col in (("exact", exact), ("f1", f1_col))
    }
    slim = df.select(doc, exact, f1_col, has_answer, empty, na_prob)
    walked = running_in_order(slim, [], [F.col(na_prob), F.col(doc)], steps)
    peaks = walked.agg(
        *[F.greatest(F.max(f"_run_{n}"), F.lit(0.0)).alias(f"_peak_{n}") for n in ("exact", "f1")]
    )
    # two one-row results side by side
    stacked = plain.unionByName(peaks, allowMissingColumns=True)
    row = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
    best = {
        f"best_{n}": 100 * (F.col("_na") + F.col(f"_peak_{n}")) / F.col("total")
        for n in ("exact", "f1")
    }
    return row.withColumns(best).drop("_na", "_peak_exact", "_peak_f1")


def inst_accuracy(df: DataFrame, flags: str) -> DataFrame:
    """Mean over all flags of all rows."""
    return df.select(F.explode(flags).alias("_f")).agg(
        F.avg(F.col("_f").cast("double")).alias("inst_accuracy")
    )


def pooled_score(df: DataFrame, keys: Sequence[str], scores: str) -> DataFrame:
    """Sum of all list entries over the number of entries."""
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)
    return df.groupBy(*keys).agg(
        F.try_divide(F.sum(total), F.sum(F.size(scores))).alias("score")
    )


def subtask_diff(scores: DataFrame, task: str, value: str, a: str, b: str) -> DataFrame:
    """Score of subtask ``a`` minus score of subtask ``b``."""
    pick = lambda name: F.max(F.when(F.col(task) == name, F.col(value)))
    return scores.agg((pick(a) - pick(b)).alias("diff"))


def mean_stderr(value: Column) -> Column:
    """Standard error of the mean; null (shown as N/A) for fewer than two rows."""
    n = F.count(value)
    return F.when(n > 1, F.stddev_samp(value) / F.sqrt(n))


def pooled_stderr(stderr: str = "stderr", size: str = "n") -> Column:
    """Aggregate: pooled standard error of subtasks, from their errors and sizes."""
    n, se = F.col(size), F.col(stderr)
    variance = F.sum((n - 1) * se * se * n) / (F.sum(n) - F.count(F.lit(1)))
    return F.sqrt(variance / F.sum(n))


def combined_stderr(
    df: DataFrame, keys: Sequence[str], order: str, stderr: str, size: str, value: str
) -> DataFrame:
    """Pairwise combined error in subtask order (kept for comparison, not advised).

    One row per subtask of a group is folded, which is as small as the task list.
    """
    parts = df.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col(order).alias("o"),
                    F.col(stderr).cast("double").alias("se"),
                    F.col(size).cast("double").alias("n"),
                    F.col(value).cast("double").alias("m"),
                )
            )
        ).alias("_parts")
    )
    first = F.get("_parts", F.lit(0))
    start = F.struct(
        (first["se"] * first["se"]).alias("var"), first["n"].alias("n"), first["m"].alias("m")
    )

    def step(acc: Column, x: Column) -> Column:
        both = acc["n"] + x["n"]
        mean = (acc["m"] * acc["n"] + x["m"] * x["n"]) / both
        inner = ((acc["n"] - 1) * acc["var"] + (x["n"] - 1) * x["se"] * x["se"]) / (both - 1)
        between = acc["n"] * x["n"] / (both * (both - 1)) * F.pow(mean - x["m"], 2)
        # the size is that of the first subtask throughout
        return F.struct((inner + between).alias("var"), acc["n"].alias("n"), mean.alias("m"))

    rest = F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0)))
    folded = F.aggregate(rest, start, step, lambda acc: F.sqrt(acc["var"]))
    return parts.select(*keys, folded.alias("stderr"))


def subtask_mean(value: str, size: str, weight_by_size: bool = True) -> Column:
    """Aggregate: mean over subtasks, weighted by their sizes or plain."""
    weight = F.col(size) if weight_by_size else F.lit(1)
    return F.sum(F.col(value) * weight) / F.sum(weight)


def group_rollup(metrics: DataFrame, edges: DataFrame, config: DataFrame) -> DataFrame:
    """Metrics of groups from those of all tasks below them.

    ``metrics``: task, metric, filter, value, stderr, samples. ``edges``: group,
    child. ``config``: group, metric, filter, weight_by_size. A missing error of one
    task makes the group's error missing.
    """
    members = leaf_tasks(edges).join(config, "group")
    rows = members.join(metrics, ["task", "metric", "filter"])
    n, by_size = F.col("samples"), F.col("weight_by_size")
    weight = F.when(by_size, n).otherwise(1)
    known = F.count("stderr") == F.count(F.lit(1))
    return rows.groupBy("group", "metric", "filter").agg(
        (F.sum(F.col("value") * weight) / F.sum(weight)).alias("value"),
        F.when(known, pooled_stderr("stderr", "samples")).alias("stderr"),
        F.sum(n).alias("samples"),
    )


def aggregate_metrics(
    samples: DataFrame,
    keys: Sequence[str] = ("task", "metric", "filter"),
    how: Mapping[str, str] | None = None,
) -> DataFrame:
    """Value, standard error and count per task, metric and filter.

    Samples carry ``value``; ``how`` names for a metric one of ``mean`` (the default),
    ``median``, ``perplexity`` or ``bypass``. Errors are those of a mean, null for others.
    """
    how = {m: h for m, h in (how or {}).items() if h != "mean"}
    value = F.col("value")
    other = F.col("metric").isin(list(how)) if how else F.lit(False)
    out = samples.groupBy(*keys).agg(
        F.avg("value").alias("value"),
        F.exp(-F.avg("value")).alias("_perplexity"),
        mean_stderr(value).alias("stderr"),
        F.count(F.lit(1)).alias("samples"),
    )
    if not how:
        return out.drop("_perplexity")
    named = lambda kind: F.col("metric").isin([m for m, h in how.items() if h == kind])
    middle = median(samples.where(named("median")), keys, "value")
    middle = middle.withColumnsRenamed({k: f"_m{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_m{i}")) for i, k in enumerate(keys)]
    score = F.when(named("median"), F.col("median")).when(named("perplexity"), F.col("_perplexity"))
    score = score.when(named("bypass"), F.lit(-1.0)).otherwise(F.col("value"))
    return out.join(middle, same, "left").select(
        *keys, score.alias("value"), F.when(~other, F.col("stderr")).alias("stderr"), "samples"
    )


def direction(df: DataFrame, keys: Sequence[str], higher_is_better: str) -> DataFrame:
    """Common direction per group and metric; null when the tasks disagree."""
    flag = F.col(higher_is_better)
    same = F.bool_and(flag) == F.bool_or(flag)
    known = F.count(flag) == F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        F.when(same & known, F.bool_and(flag)).alias("higher_is_better")
    )


def trace_columns(
    response: str, allowed_tokens: int | None = None, counted: bool = False
) -> dict[str, Column]:
    """Per-sample trace measures of a response with think and answer sections. In the
    ``counted`` form every step says how many are left, and its own line is no part of it."""
    # fixed values: section markers and answer marks
    answer_mark, think_mark = "<|im_start|>answer", "<|im_start|>think"
    section_mark, left_mark = "<|im_start|>", " steps left\n"
    text = F.col(response)
    before = F.substring_index(text, answer_mark, 1)
    lines = F.split(before, "\n")
    steps = F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0)))
    after = F.when(text.contains(answer_mark), F.substring_index(text, answer_mark, -1))
    # the rest of the marker's own line does not belong to the answer
    body = F.regexp_replace(F.coalesce(after, F.lit("")), r"^[^\n]*\n", "")
    step_count = F.size(lines) - 2
    no_thinking = ~text.contains(think_mark)
    if counted:
        parts = F.split(text, re.escape(section_mark))
        inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
        steps = F.transform(inner, lambda s: F.regexp_replace(s, r"^[^\n]*(\n|$)", ""))
        step_count = F.size(F.split(text, left_mark)) - 1
        no_thinking = ~text.contains(left_mark)
        body = F.coalesce(F.get(F.split(text, re.escape(answer_mark)), F.lit(1)), F.lit(""))
    thinking_words = F.size(words(F.array_join(steps, "\n")))
    out = {
        "steps": step_count,
        "pieces": F.size(steps),
        "step_words": F.transform(steps, lambda s: F.size(words(s))),
        "thinking_words": thinking_words,
        "total_words": F.size(words(text)),
        "answer_words": F.size(words(body)),
        "no_thinking": no_thinking,
        "no_answer": ~text.contains("Answer:") & ~text.contains("\\boxed"),
    }
    if allowed_tokens is not None:
        out["over_budget"] = thinking_words > allowed_tokens
    return out


def trace_stats(
    df: DataFrame,
    response: str,
    correct: str | None = None,
    allowed_steps: int | None = None,
    allowed_tokens: int | None = None,
    keys: Sequence[str] = (),
    counted: bool = False,
) -> DataFrame:
    """Averages and extremes of step, thinking, answer and total lengths, and how many
    samples lack thinking or an answer or go over the budget. ``counted``: see
    ``trace_columns``."""
    rows = df.withColumns(trace_columns(response, allowed_tokens, counted))
    avg = lambda c: F.round(F.avg(c), 1)
    cols = [
        F.count(F.lit(1)).alias("samples"),
        avg("steps").alias("avg_steps"),
        F.round(F.try_divide(F.sum("thinking_words"), F.sum("pieces")), 1).alias("avg_step"),
        F.min(F.array_min("step_words")).alias("min_step"),
        F.max(F.array_max("step_words")).alias("max_step"),
        F.min("thinking_words").alias("min_thinking"),
        F.max("thinking_words").alias("max_thinking"),
        F.min("answer_words").alias("min_answer"),
        F.max("answer_words").alias("max_answer"),
        F.min("total_words").alias("min_total"),
        F.max("total_words").alias("max_total"),
        avg("thinking_words").alias("avg_thinking"),
        avg("answer_words").alias("avg_answer"),
        avg("total_words").alias("avg_total"),
        F.count_if("no_answer").alias("without_answer"),
        F.count_if("no_thinking").alias("without_thinking"),
    ]
    if allowed_steps is not None:
        cols.append(F.count_if(F.col("steps") > allowed_steps).alias("too_many_steps"))
    if allowed_tokens is not None:
        cols.append(F.count_if("over_budget").alias("too_many_tokens"))
    if correct is not None:
        cols.append(F.avg(F.col(correct).cast("double")).alias("accuracy"))
    return rows.groupBy(*keys).agg(*cols)


def correctness_by_length(df: DataFrame, response: str, correct: str, idx: str) -> DataFrame:
    """Samples in order of thinking length: position, length, correctness."""
    rows = df.withColumns(
        {"thinking_words": trace_columns(response)["thinking_words"]}
    )
    slim = rows.select(idx, "thinking_words", correct)
    out = ranked(slim, [], [F.col("thinking_words"), F.col(idx)], "place")
    return out.select("place", idx, "thinking_words", correct)


def sorted_lengths(df: DataFrame, response: str, idx: str, counted: bool = False) -> DataFrame:
    """Lengths in words in rising order, as rows ``(kind, place, idx, step, words)``: one per
    sample for thinking, answer and total, and one per step (``step`` from 1, else 0)."""
    found = trace_columns(response, counted=counted)
    cell = lambda kind, step, size: F.struct(
        F.lit(kind).alias("kind"), step.cast("int").alias("step"), size.alias("words")
    )
    whole = [cell(k, F.lit(0), found[f"{k}_words"]) for k in ("thinking", "answer", "total")]
    steps = F.transform(found["step_words"], lambda size, i: cell("step", i + 1, size))
    rows = df.select(idx, F.inline(F.concat(F.array(*whole), steps)))
    out = ranked(rows, ["kind"], [F.col("words"), F.col(idx), F.col("step")], "place")
    return out.select("kind", "place", idx, "step", "words")


def sample_counts(df: DataFrame, keys: Sequence[str], limit: int | None) -> DataFrame:
    """Original and effective number of samples."""
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        n.alias("original"),
        (n if limit is None else F.least(n, F.lit(limit))).alias("effective"),
    )


def task_hash(
    df: DataFrame, keys: Sequence[str], position: str, sample_hash: str, chunk: int = 1 << 14
) -> DataFrame:
    """Hash over the sample hashes of a task in order (``position`` counts from 1).

    A tree of three levels for every task, however small: hashes of ``chunk`` samples
    each, hashes of ``chunk`` of those, and the hash of all that are left. No task is
    ever joined into one text.
    """
    level = df.select(
        *keys, (F.col(position) - 1).alias("_at"), F.col(sample_hash).alias("_h")
    )
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_h")))
    joined = F.sha2(F.array_join(F.transform(ordered, lambda x: x["_h"]), ""), 256)
    for _ in range(2):
        level = level.groupBy(*keys, F.floor(F.col("_at") / chunk).alias("_c")).agg(
            joined.alias("_h")
        )
        level = level.withColumnRenamed("_c", "_at")
    return level.groupBy(*keys).agg(joined.alias("task_hash"))



def token_cost(
    df: DataFrame, task: str, tokens: str, prices_per_1000: Mapping[str, float]
) -> DataFrame:
    """Tokens and price per task plus a total row (null task)."""
    out = df.rollup(task).agg(F.sum(tokens).alias("tokens"))
    return out.withColumns(
        {name: F.col("tokens") / 1000 * price for name, price in prices_per_1000.items()}
    ).orderBy(F.col(task).isNull(), F.col("tokens").desc())


def request_cost(
    prompt: Column, cached: Column, output: Column, price: tuple[float, float, float]
) -> Column:
    """Price of a call from per-million prices of fresh, cached and output tokens."""
    fresh, kept, out = price
    return ((prompt - cached) * fresh + cached * kept + output * out) / 1_000_000


