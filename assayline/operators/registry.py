"""Extension points: metrics, aggregations, filters and per-task hooks.

Everything registered is a builder of columns or DataFrames, so user extensions stay
inside the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline import fixed_values as V
from assayline.functions import answers
from assayline.operators import aggregate as A
from assayline.operators import statistics, vote
from assayline.operators.statistics import Ranked, Statistic

#: A mergeable statistic, an aggregate of an ordered group, or an aggregate column of a score.
Aggregation = Statistic | Ranked | Callable[[Column], Column]
Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Metric:
    name: str
    score: Callable[..., Column]
    aggregation: str = "mean"
    higher_is_better: bool = True
    output_type: str = "generate_until"


METRICS: dict[str, Metric] = {}
AGGREGATIONS: dict[str, Aggregation] = {}
FILTERS: dict[str, Callable[..., DataFrame]] = {}


def _add(registry: dict, name: str, value: object) -> None:
    if name in registry:
        raise ValueError(f"{name} is registered already")
    registry[name] = value


def register_metric(
    name: str,
    higher_is_better: bool = True,
    output_type: str = "generate_until",
    aggregation: str = "mean",
) -> Callable:
    def add(score: Callable[..., Column]) -> Callable[..., Column]:
        _add(METRICS, name, Metric(name, score, aggregation, higher_is_better, output_type))
        return score

    return add


def register_aggregation(name: str) -> Callable[[Aggregation], Aggregation]:
    def add(build: Aggregation) -> Aggregation:
        _add(AGGREGATIONS, name, build)
        return build

    return add


def register_filter(name: str) -> Callable:
    def add(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _add(FILTERS, name, step)
        return step

    return add


for _name in (
    "mean", "bypass", "perplexity", "weighted_perplexity", "bits_per_byte", "brier", "mcc",
    "bleu", "chrf", "ter",
):
    register_aggregation(_name)(getattr(statistics, _name))
register_aggregation("f1")(statistics.f1())
register_aggregation("median")(
    Ranked(lambda rows, keys, score, order: A.median(rows, keys, score).withColumnRenamed("median", "value"))
)
register_aggregation("mean_last")(
    Ranked(
        lambda rows, keys, score, order: A.agg_mean_last(
            rows, keys, order, score
        ).withColumnRenamed("mean_last", "value")
    )
)


def _on_answer(build: Callable[..., Column]) -> Callable[..., DataFrame]:
    """Filter step that rewrites the answer column."""

    def step(df: DataFrame, keys: Sequence[str], idx: str, answer: str, **options) -> DataFrame:
        return df.withColumn(answer, build(F.col(answer), **options))

    return step


register_filter("take_first")(lambda df, keys, idx, answer: vote.take_first(df, keys, idx))
register_filter("take_first_k")(
    lambda df, keys, idx, answer, **options: vote.take_first_k(df, keys, idx, **options)
)
register_filter("majority_vote")(vote.majority_vote)
register_filter("regex")(
    _on_answer(
        lambda col, regex_pattern, group_select=0, fallback=V.INVALID: answers.regex_filter(
            col, regex_pattern, group_select, fallback
        )
    )
)
register_filter("multi_choice_regex")(
    _on_answer(
        lambda col, regex_pattern, choices, **options: answers.choice_regex(
            col, regex_pattern, F.col(choices), **options
        )
    )
)
register_filter("map")(
    _on_answer(
        lambda col, mapping_dict, default_value=None: answers.map_values(
            col, mapping_dict, default_value
        )
    )
)
register_filter("lowercase")(_on_answer(F.lower))
register_filter("uppercase")(_on_answer(F.upper))
register_filter("remove_whitespace")(_on_answer(answers.ltrim_space))


def filter_chains(
    declared: Sequence[Mapping], keys: Sequence[str], idx: str, answer: str
) -> dict[str, list[Step]]:
    """Chains for ``apply_filters`` from a declared list, as in a task file:
    ``[{"name": ..., "filter": [{"function": "regex", "regex_pattern": ...}, ...]}, ...]``.
    """

    def step(options: Mapping) -> Step:
        build = FILTERS[options["function"]]
        rest = {k: v for k, v in options.items() if k != "function"}
        return lambda df: build(df, keys, idx, answer, **rest)

    return {chain["name"]: [step(o) for o in chain["filter"]] for chain in declared}


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two tables with one row per key, side by side; null keys meet."""
    right = right.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    both = left.join(right, same, "left") if keys else left.crossJoin(right)  # one row each
    return both.drop(*[f"_k{i}" for i in range(len(keys))])


def evaluate_metrics(
    df: DataFrame,
    keys: Sequence[str],
    scores: Mapping[str, Sequence[Column]],
    errors: bool = False,
    ids: Sequence[str] = (),
    order: str | None = None,
    iters: int = statistics.FEW,
    seed: int = 42,
) -> DataFrame:
    """Aggregate registered metrics: metric name to its score arguments.

    All mergeable statistics share one aggregation, plain aggregate columns another, and a
    ranked one (``median``, ``mean_last``, which needs ``order``) has its own. With ``errors``
    every metric has a column ``<name>_stderr``: for means the standard error, else with
    ``ids``, which name a row, the bootstrap error over ``iters`` replicates, at most 100 for
    bleu, chrf and ter. Without a way to an error it is null (shown as N/A).
    """
    rows = df.withColumns(
        {f"_m_{name}": METRICS[name].score(*args) for name, args in scores.items()}
    )
    how = {name: AGGREGATIONS[METRICS[name].aggregation] for name in scores}
    merged = {n: (h, F.col(f"_m_{n}")) for n, h in how.items() if isinstance(h, Statistic)}
    plain = [n for n, h in how.items() if not isinstance(h, (Statistic, Ranked))]
    parts = [statistics.aggregate(rows, keys, merged)] if merged else []
    if plain:
        parts.append(rows.groupBy(*keys).agg(*[how[n](F.col(f"_m_{n}")).alias(n) for n in plain]))
    for name, h in how.items():
        if isinstance(h, Ranked):
            kept = [c for c in dict.fromkeys([*keys, order]) if c]
            part = h.build(rows.select(*kept, f"_m_{name}"), keys, f"_m_{name}", order)
            parts.append(part.select(*keys, F.col("value").alias(name)))
    if errors:
        means = [n for n in scores if METRICS[n].aggregation == "mean"]
        if means:
            error = [A.mean_stderr(F.col(f"_m_{n}")).alias(f"{n}_stderr") for n in means]
            parts.append(rows.groupBy(*keys).agg(*error))
        drawn = {n: m for n, m in merged.items() if n not in means} if ids else {}
        if drawn:
            parts.append(statistics.bootstrap(rows, keys, drawn, ids, iters, seed))
        for name in scores:
            if ids and METRICS[name].aggregation == "median":
                part = statistics.bootstrap_median(rows, keys, f"_m_{name}", ids, iters, seed)
                parts.append(part.withColumnRenamed("stderr", f"{name}_stderr"))
    out = parts[0]
    for part in parts[1:]:
        out = _beside(out, part, keys)
    cols = [c for n in scores for c in ([n, f"{n}_stderr"] if errors else [n])]
    none = F.lit(None).cast("double")
    return out.select(*keys, *[F.col(c) if c in out.columns else none.alias(c) for c in cols])


@dataclass
class TaskHooks:
    """Per-task functions on DataFrames: prepare documents, build prompts and targets,
    filter responses, score."""

    name: str
    process_docs: Step = lambda df: df
    doc_to_text: Callable[[DataFrame], Column] | None = None
    doc_to_target: Callable[[DataFrame], Column] | None = None
    filters: Sequence[Step] = field(default_factory=tuple)
    process_results: Step = lambda df: df

    def requests(self, docs: DataFrame) -> DataFrame:
        """Documents with prompt and target."""
        out = self.process_docs(docs)
        if self.doc_to_text:
            out = out.withColumn("prompt", self.doc_to_text(out))
        if self.doc_to_target:
            out = out.withColumn("target", self.doc_to_target(out))
        return out

    def results(self, docs: DataFrame, responses: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Scored samples: requests joined with filtered recorded responses."""
        for step in self.filters:
            responses = responses.transform(step)
        return self.process_results(self.requests(docs).join(responses, list(keys)))
