"""Curation flow: sources → decontaminated, unique questions → features → hard, varied
sample → training text."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline import fixed_values as V
from assayline.operators import joins, ngrams, reshape, selection
from assayline.operators.scale import broadcast_if_small
from assayline.session import materialize


@dataclass(frozen=True)
class CurationRules:
    """What differs from one dataset to the next."""

    benchmark_sources: Sequence[str] = ()
    contest_part: str = ""
    diagram_source: str = ""
    features: Sequence[str] = ("domain", "length", "correct", "weak_a", "weak_b")
    weak_verdicts: Sequence[str] = ("weak_a", "weak_b")
    ngram: int = V.QUESTION_NGRAM
    sample_size: int = V.SAMPLE_SIZE
    uniform_draws: int = V.UNIFORM_DRAWS
    min_length: int = V.LONG_TRACE
    seed: int = 42


def collect_questions(
    sources: Sequence[DataFrame],
    protected: DataFrame,
    protected_text: str,
    rules: CurationRules,
    select: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Common-schema sources in order: decontaminated against the protected texts and
    the kept rows of earlier sources, first copy of each question kept, key added.
    ``select`` picks among the clean rows of a source; what it leaves out protects nothing."""
    kept = ngrams.decontaminate_sources(
        sources, protected, ["row_idx"], "question", protected_text, rules.ngram, select
    )
    unique = selection.dedup_first(kept, "question", ["source_rank", "row_idx"])
    return unique.withColumn("qhash", joins.question_hash(F.col("question")))


def filter_questions(
    questions: DataFrame, features: DataFrame, order: str, rules: CurationRules
) -> DataFrame:
    """Complete features, no odd markup, failed by every weak model."""
    full = selection.drop_incomplete(questions, features, "qhash", order, rules.features)
    clean = selection.drop_patterns(full, "question", "source_type", rules.diagram_source)
    return selection.keep_hard(clean, rules.weak_verdicts)


def select_sample(
    hard: DataFrame, first_mix: str, second_mix: str, rules: CurationRules
) -> DataFrame:
    """Preselected rows plus draws over domains, weighted by the domain mix of the two
    benchmark sources named."""
    hard = materialize(hard, "hard")
    chosen = selection.preselect(
        hard, "correct", "source_type", "length", rules.benchmark_sources,
        rules.contest_part, rules.min_length,
    ).select("qhash")
    of = lambda name: hard.where(F.col("source_type") == name)
    weights = selection.domain_weights(of(first_mix), of(second_mix), "domain")
    ids = selection.diversity_sample(
        hard, chosen, weights, "qhash", "domain", "length",
        rules.sample_size, rules.uniform_draws, rules.seed,
    )
    return hard.join(broadcast_if_small(ids), "qhash", "left_semi")


def training_text(sample: DataFrame, answers: DataFrame) -> DataFrame:
    """Chat text per selected question from its recorded trace and attempt."""
    rows = joins.attach_attempts(sample, answers)
    text = reshape.render_sft(
        F.col("question"), F.col("thinking_trajectories"), F.col("attempt")
    )
    return rows.select("qhash", text.alias("text"))
