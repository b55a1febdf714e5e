"""Aggregations as mergeable statistics: what a row adds, how sums merge, how they finish.

Any number of such aggregations compile into one aggregation of plain sums. Label metrics
keep counts of (gold, predicted) pairs: the rows are first grouped by their labels as well,
and a group then holds one entry per pair of labels. The bootstrap weighs the same sums: a
row's weight in a replicate comes from a hash of its ids, so the draws are the same on every
run and partitioning, and no row is copied but for one in ``DRAWS`` replicates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline import fixed_values as V
from assayline.functions.text import words
from assayline.operators import text_scores as S
from assayline.operators.scale import running_in_order

Sums = Mapping[str, Column]
#: Replicates whose weights come from one hash of 128 bits, 16 bits each.
DRAWS = 8
#: Replicates of scores that are costly to finish or to add up.
FEW = 100


@dataclass(frozen=True)
class Statistic:
    """``rows`` gives the additive columns of a score column (null adds nothing), ``finish`` the
    value from their sums. With ``pair`` the score is a struct (gold, pred) and ``finish`` finds
    the counted pairs as ``pairs``, an array of (gold, pred, n)."""

    finish: Callable[[Sums], Column]
    rows: Callable[[Column], Sums] = lambda score: {}
    pair: bool = False
    replicates: int = 1000


@dataclass(frozen=True)
class Ranked:
    """An aggregation that needs the order of rows: (rows, keys, score, order) to a DataFrame of
    the keys and ``value``."""

    build: Callable[[DataFrame, Sequence[str], str, str | None], DataFrame]


Items = Mapping[str, tuple[Statistic, Column]]


def _mean_rows(value: Column) -> Sums:
    return {"total": value, "n": F.when(value.isNotNull(), 1.0)}


def _mean(sums: Sums) -> Column:
    return F.try_divide(sums["total"], sums["n"])


def _ll_rows(score: Column) -> Sums:
    return {"ll": score["ll"], "size": score["size"]}


def _per_size(sums: Sums) -> Column:
    return -F.try_divide(sums["ll"], sums["size"])


mean = Statistic(_mean, _mean_rows)
bypass = Statistic(lambda sums: F.lit(-1))
perplexity = Statistic(lambda sums: F.exp(-_mean(sums)), _mean_rows)
weighted_perplexity = Statistic(lambda sums: F.exp(_per_size(sums)), _ll_rows)
bits_per_byte = Statistic(lambda sums: _per_size(sums) / math.log(2.0), _ll_rows)


def _squared_distance(score: Column) -> Column:
    """Of class probabilities to the one-hot gold class."""
    parts = F.transform(
        score["probs"], lambda p, i: F.pow(p - F.when(i == score["gold"], 1.0).otherwise(0.0), 2)
    )
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


brier = Statistic(_mean, lambda score: _mean_rows(_squared_distance(score)))


def _label_sums(pairs: Column) -> Column:
    """Array of (label, tp, support, predicted); a null label is a label that is never hit."""
    labels = F.array_distinct(F.concat(pairs["gold"], pairs["pred"]))
    count = lambda kept: F.aggregate(
        F.filter(pairs, kept), F.lit(0.0), lambda total, x: total + x["n"]
    )
    return F.transform(
        labels,
        lambda label: F.struct(
            label.alias("label"),
            count(lambda x: (x["gold"] == label) & (x["pred"] == label)).alias("tp"),
            count(lambda x: x["gold"].eqNullSafe(label)).alias("support"),
            count(lambda x: x["pred"].eqNullSafe(label)).alias("predicted"),
        ),
    )


def _total(rows: Column, value: Callable[[Column], Column]) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda total, x: total + value(x))


def f1(
    average: str = "binary", positive: int | str = 1, labels: Sequence | None = None
) -> Statistic:
    """F1 over pairs of labels, as ``aggregate.f1``; labels are a bounded set."""
    chosen = [positive] if average == "binary" else labels

    def finish(sums: Sums) -> Column:
        per = _label_sums(sums["pairs"])
        if chosen is not None:
            per = F.filter(per, lambda x: x["label"].isin(list(chosen)))
        one = lambda x: F.coalesce(
            F.try_divide(2.0 * x["tp"], x["support"] + x["predicted"]), F.lit(0.0)
        )
        support = _total(per, lambda x: x["support"])
        if average == "micro":
            both = support + _total(per, lambda x: x["predicted"])
            score = F.try_divide(2.0 * _total(per, lambda x: x["tp"]), both)
        elif average == "weighted":
            score = F.try_divide(_total(per, lambda x: one(x) * x["support"]), support)
        else:
            score = F.try_divide(_total(per, one), F.lit(len(chosen)) if chosen else F.size(per))
        return F.coalesce(score, F.lit(0.0))

    return Statistic(finish, pair=True)


def _mcc(sums: Sums) -> Column:
    per = _label_sums(sums["pairs"])
    every = _total(per, lambda x: x["support"])
    cross = _total(per, lambda x: x["support"] * x["predicted"])
    spread = [every * every - _total(per, lambda x, s=s: x[s] * x[s]) for s in ("support", "predicted")]
    score = (_total(per, lambda x: x["tp"]) * every - cross) / F.sqrt(spread[0] * spread[1])
    return F.when((spread[0] > 0) & (spread[1] > 0), score).otherwise(0.0)


mcc = Statistic(_mcc, pair=True)


def _gram_rows(tokens: Callable[[Column], Column], orders: Sequence[int]) -> Callable:
    def rows(score: Column) -> Sums:
        found = S.overlap_counts(tokens(score["pred"]), tokens(score["ref"]), orders)
        return {f"{n}_{k}": found[f"{n}_{k}"] for n in ("match", "pred", "ref") for k in orders}

    return rows


def _edit_rows(score: Column) -> Sums:
    split = lambda c: words(F.coalesce(c, F.lit("")))
    found = S.move_edits(split(score["pred"]), F.array(split(score["ref"])))
    return {"edits": found["edits"], "size": found["size"]}


bleu = Statistic(
    lambda sums: S.bleu_score(lambda n, k: sums[f"{n}_{k}"]),
    _gram_rows(S.translation_tokens, S.ORDERS),
    replicates=FEW,
)
chrf = Statistic(
    lambda sums: S.chrf_score(lambda n, k: sums[f"{n}_{k}"]),
    _gram_rows(S.characters, tuple(range(1, V.CHRF_ORDER + 1))),
    replicates=FEW,
)
ter = Statistic(
    lambda sums: 100 * F.try_divide(sums["edits"], sums["size"]), _edit_rows, replicates=FEW
)


def _rows(df: DataFrame, keep: Sequence[str], items: Items) -> DataFrame:
    """Kept columns and what every row adds."""
    cols = []
    for i, (how, score) in enumerate(items.values()):
        cols += [c.cast("double").alias(f"_s{i}_{name}") for name, c in how.rows(score).items()]
        if how.pair:
            cols += [score[side].alias(f"_{side}{i}") for side in ("gold", "pred")]
    return df.select(*keep, *cols)


def _labelled(items: Items) -> dict[int, list[str]]:
    return {i: [f"_gold{i}", f"_pred{i}"] for i, (how, _) in enumerate(items.values()) if how.pair}


def _sums(
    rows: DataFrame, keys: Sequence[str], items: Items, weights: Sequence[Column | None]
) -> tuple[DataFrame, list[list[Column]]]:
    """Sums per key, and for every weight the columns of its sums under common names."""
    added = [c for c in rows.columns if c.startswith("_s")]
    pairs = _labelled(items)
    sums = []
    for r, w in enumerate(weights):
        sums += [F.sum(F.col(c) if w is None else F.col(c) * w).alias(f"{c}_{r}") for c in added]
        sums.append(F.sum(F.lit(1.0) if w is None else w).alias(f"_n_{r}"))
    names = [f"{c}_{r}" for r in range(len(weights)) for c in [*added, "_n"]]
    grouped = rows.groupBy(*keys, *[c for own in pairs.values() for c in own]).agg(*sums)
    if pairs:
        counts = [F.col(f"_n_{r}") for r in range(len(weights))]
        lists = [
            F.collect_list(F.struct(F.col(g).alias("gold"), F.col(p).alias("pred"), *counts)).alias(f"_pairs{i}")
            for i, (g, p) in pairs.items()
        ]
        grouped = grouped.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names], *lists)
    cells = []
    for r in range(len(weights)):
        cell = [F.col(f"{c}_{r}").alias(c) for c in [*added, "_n"]]
        for i in pairs:
            held = F.col(f"_pairs{i}")
            sides = [held["gold"].alias("gold"), held["pred"].alias("pred"), held[f"_n_{r}"].alias("n")]
            cell.append(F.arrays_zip(*sides).alias(f"_pairs{i}"))
        cells.append(cell)
    return grouped, cells


def _finish(sums: DataFrame, items: Items) -> dict[str, Column]:
    """Finished columns over the common names of ``_sums``."""
    out = {}
    for i, (name, (how, _)) in enumerate(items.items()):
        prefix = f"_s{i}_"
        own = {c[len(prefix) :]: F.col(c) for c in sums.columns if c.startswith(prefix)}
        if how.pair:
            own["pairs"] = F.col(f"_pairs{i}")
        out[name] = how.finish(own)
    return out


def aggregate(df: DataFrame, keys: Sequence[str], items: Items) -> DataFrame:
    """Keys and one column per item; null keys are a group, groups without a score get what
    ``finish`` makes of no sums (a null mean, F1 of 0)."""
    grouped, (cell,) = _sums(_rows(df, keys, items), keys, items, [None])
    sums = grouped.select(*keys, *cell)
    return sums.select(*keys, *[c.alias(name) for name, c in _finish(sums, items).items()])


def poisson_limits(draws: int = 1 << 16) -> list[int]:
    """Limits of a uniform number below ``draws``; as many as it reaches is a Poisson(1) draw."""
    steps, total = [], 0.0
    for k in range(9):
        total += math.exp(-1) / math.factorial(k)
        steps.append(int(total * draws))
    return [s for s in steps if s < draws]


def replicate_weights(ids: Sequence[str], seed: int, block: str) -> Column:
    """``DRAWS`` Poisson(1) weights of a row for the replicates of a block, as an array."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ids]
    code = F.md5(F.concat_ws("|", *parts, F.lit(str(seed)), F.col(block).cast("string")))
    limits = F.array(*[F.lit(s) for s in poisson_limits()])
    number = lambda r: F.conv(F.substring(code, 4 * r + 1, 4), 16, 10).cast("int")
    return F.transform(
        F.array(*[number(r) for r in range(DRAWS)]),
        lambda n: F.size(F.filter(limits, lambda s: n >= s)).cast("double"),
    )


def _weighed(rows: DataFrame, ids: Sequence[str], iters: int, seed: int) -> DataFrame:
    """A row per block of replicates with their weights ``_w``."""
    blocks = -(-iters // DRAWS)
    rows = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.withColumn("_w", replicate_weights(ids, seed, "_block"))


def bootstrap(
    df: DataFrame,
    keys: Sequence[str],
    items: Items,
    ids: Sequence[str],
    iters: int = FEW,
    seed: int = 42,
) -> DataFrame:
    """Keys and ``<name>_stderr`` per item: the standard deviation of the value over ``iters``
    replicates (at most ``replicates`` of the statistic).

    ``ids`` name a row; rows that share them share their draws. A replicate that drew no row
    of a group does not count, and under two replicates the error is null. Row statistics are
    made once; one row per group and block of replicates leaves a task.
    """
    rows = _weighed(_rows(df, [*keys, *[c for c in ids if c not in keys]], items), ids, iters, seed)
    weights = [F.col("_w")[r] for r in range(DRAWS)]
    grouped, cells = _sums(rows, [*keys, "_block"], items, weights)
    each = [
        F.struct((F.col("_block") * DRAWS + r).alias("_replicate"), *cell)
        for r, cell in enumerate(cells)
    ]
    sums = grouped.select(*keys, F.inline(F.array(*each))).where(F.col("_n") > 0)
    values = _finish(sums, items)
    every = sums.select(*keys, "_replicate", *[c.cast("double").alias(n) for n, c in values.items()])
    used = {n: min(iters, how.replicates) for n, (how, _) in items.items()}
    return every.groupBy(*keys).agg(
        *[
            F.stddev_samp(F.when(F.col("_replicate") < used[n], F.col(n))).alias(f"{n}_stderr")
            for n in items
        ]
    )


def bootstrap_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ids: Sequence[str],
    iters: int = FEW,
    seed: int = 42,
) -> DataFrame:
    """Keys and ``stderr`` of the median, from the same weights as ``bootstrap``.

    Equal values of a group are merged, and weights are summed along the values in ordered
    chunks, so a group of any size stays spread over tasks. Null values do not count.
    """
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, *[c for c in ids if c not in keys], F.col(value).alias("_v")
    )
    places = [f"_w{r}" for r in range(DRAWS)]
    group = [*keys, "_block"]
    merged = _weighed(rows, ids, iters, seed).groupBy(*group, "_v").agg(
        *[F.sum(F.col("_w")[r]).alias(w) for r, w in enumerate(places)]
    )
    upto = {f"_u{w}": F.col(w) for w in places}
    walked = running_in_order(merged, group, [F.col(c) for c in [*group, "_v"]], upto)
    totals = merged.groupBy(*group).agg(*[F.sum(w).alias(f"_t{w}") for w in places])
    totals = totals.withColumnsRenamed({c: f"_k{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in group]
    walked = walked.join(totals, same).drop(*[f"_k{c}" for c in group])

    def at_least(w: str, above: bool) -> Column:
        twice, total = 2 * F.col(f"_u{w}"), F.col(f"_t{w}")
        return F.min(F.when((twice > total if above else twice >= total) & (F.col(w) > 0), F.col("_v")))

    middles = walked.groupBy(*group).agg(
        *[((at_least(w, False) + at_least(w, True)) / 2).alias(f"_m{w}") for w in places]
    )
    cells = F.array(
        *[
            F.struct((F.col("_block") * DRAWS + r).alias("_replicate"), F.col(f"_m{w}").alias("_m"))
            for r, w in enumerate(places)
        ]
    )
    every = middles.select(*keys, F.inline(cells)).where(F.col("_replicate") < iters)
    return every.groupBy(*keys).agg(F.stddev_samp("_m").alias("stderr"))
