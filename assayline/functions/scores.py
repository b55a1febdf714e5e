"""Per-sample scores as column expressions: choices, likelihoods, matches, maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayline import fixed_values as V
from assayline.functions.rewrite import trim_space


def argmax(arr: Column) -> Column:
    """0-based position of the first maximum; NaN counts as missing."""
    known = F.transform(arr, lambda x: F.when(~F.isnan(x), x))
    return (F.array_position(known, F.array_max(known)) - 1).cast("int")


def exact_match(
    pred: Column,
    ref: Column,
    regexes: Sequence[str] = (),
    ignore_case: bool = False,
    ignore_punct: bool = False,
    ignore_digits: bool = False,
) -> Column:
    def tidy(c: Column) -> Column:
        for r in regexes:
            c = F.regexp_replace(c, r, "")
        if ignore_case:
            c = F.lower(c)
        if ignore_punct:
            c = F.translate(c, V.PUNCTUATION, "")
        return F.translate(c, V.DIGITS, "") if ignore_digits else c

    return tidy(pred) == tidy(ref)


def choice_scores(
    lls: Column,
    choices: Column,
    gold: Column,
    greedy: Column | None = None,
    uncond: Column | None = None,
) -> dict[str, Column]:
    """Scores of a multiple-choice sample by name. A gold outside the choices scores 0
    and is flagged. ``uncond`` holds the unconditional likelihoods per choice."""
    inside = (gold >= 0) & (gold < F.size(choices))
    safe = F.when(inside, gold)
    norm = F.zip_with(lls, choices, lambda ll, c: ll / F.length(c))
    hit = lambda arr: F.coalesce((argmax(arr) == safe).cast("double"), F.lit(0.0))
    out = {"acc": hit(lls), "acc_norm": hit(norm), "gold_error": ~inside}
    if greedy is not None:
        out["exact_match"] = F.coalesce(F.get(greedy, safe).cast("int"), F.lit(0))
    if uncond is not None:
        out["acc_mutual_info"] = hit(F.zip_with(lls, uncond, lambda c, u: c - u))
    return out


def acc_multi(pred: Column, golds: Column) -> Column:
    return F.array_contains(golds, pred).cast("double")


def softmax(arr: Column) -> Column:
    top = F.array_max(arr)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.transform(arr, lambda x: F.exp(x - top) / total)


def sum_exp(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x))


def truth_mass(lls: Column, labels: Column) -> Column:
    """Probability share of the true options, which come before the first 0 label."""
    true_count = (F.array_position(labels, 0) - 1).cast("int")
    return sum_exp(F.slice(lls, F.lit(1), true_count)) / sum_exp(lls)


def pair_preference(first: Column, second: Column) -> tuple[Column, Column]:
    """Absolute likelihood difference, and 1 when the first is more likely."""
    return F.abs(first - second), F.when(first > second, 1.0).otherwise(0.0)


def rank_scores(scores: Column, gold: Column) -> dict[str, Column]:
    """Recall at 1 and 2 and reciprocal rank of the gold option."""
    place = F.array_position(F.sort_array(scores, asc=False), F.get(scores, gold))
    first = (argmax(scores) == gold).cast("int")
    return {
        "r1": first,
        "r2": (place == 2).cast("int") + first,
        "mrr": F.lit(1.0) / place,
    }


def contains_any(pred: Column, labels: Column) -> Column:
    """Any label occurs in the prediction, ignoring case."""
    low = F.lower(pred)
    return F.exists(labels, lambda x: F.contains(low, F.lower(x))).cast("int")


def is_included(ref: Column, pred: Column) -> Column:
    return F.contains(pred, ref)


def emotion_score(pred: Column, ref: Column) -> tuple[Column, Column]:
    """Distance score of four rated emotions and whether the answer was readable.

    Both are maps from emotion to score; all four names have to agree.
    """
    names = F.map_keys(pred)
    readable = (F.size(names) == 4) & F.forall(names, lambda k: F.map_contains_key(ref, k))

    def scaled(k: Column) -> Column:
        d = F.abs(F.try_element_at(pred, k) - F.try_element_at(ref, k))
        curve = V.EMOTION_SCALE / (1 + F.exp(V.EMOTION_SLOPE * (d - V.EMOTION_MIDDLE)))
        return F.when(d == 0, 0.0).when(d <= V.EMOTION_NEAR, curve).otherwise(d)

    total = F.aggregate(F.transform(names, scaled), F.lit(0.0), lambda acc, x: acc + x)
    score = 10 * (10 - total * V.EMOTION_CONSTANT)
    return (
        F.when(readable, score).otherwise(0.0),
        F.when(readable, 100).otherwise(0),
    )


def referent_match(pred: Column, ref: Column, label: Column) -> Column:
    """1 when "same referent" (word subset either way, same apostrophe use) equals the
    boolean label."""

    def tidy(c: Column) -> Column:
        parts = F.split(F.lower(trim_space(c)), " ")
        kept = F.filter(parts, lambda w: ~w.isin(V.DETERMINERS))
        return F.array_join(kept, " ")

    p, r = tidy(pred), tidy(ref)
    pw, rw = F.split(p, " "), F.split(r, " ")
    subset = (F.size(F.array_except(pw, rw)) == 0) | (F.size(F.array_except(rw, pw)) == 0)
    same = (p.contains("'") == r.contains("'")) & subset
    return (same == label).cast("double")


def ll_tuples(ll: Column, text: Column) -> dict[str, Column]:
    """Likelihood with word and UTF-8 byte counts of the text."""
    return {
        "ll": ll,
        "words": F.size(F.split(text, r"(?U)\s+")),
        "bytes": F.octet_length(text),
    }


def toxic_flag(score: Column, cut: float = 0.5) -> Column:
    return (score >= cut).cast("int")


def sample_hashes(doc: Column, prompt: Column, target: Column) -> dict[str, Column]:
    """SHA-256 of the document (as JSON text), the prompt and the target."""
    return {
        "doc_hash": F.sha2(doc, 256),
        "prompt_hash": F.sha2(prompt, 256),
        "target_hash": F.sha2(target.cast("string"), 256),
    }


def clean_keyed(col: Column) -> Column:
    """Answer text of a question sheet: trimmed, lower case, plain quotes."""
    out = F.btrim(trim_space(col), F.lit("."))
    out = F.lower(F.regexp_replace(out, " +", " "))
    out = F.replace(out, F.lit("+"), F.lit(""))
    return F.translate(out, "‘’“”", "''\"\"")


def keyed_score(pred: Column, ref: Column) -> Column:
    """List with one score per key of ``ref`` (map to text or to alternatives)."""

    def one(key: Column) -> Column:
        given, right = clean_keyed(F.try_element_at(pred, key)), F.try_element_at(ref, key)
        hit = F.exists(right, lambda r: clean_keyed(r) == given)
        blank = F.size(right) == 0
        return F.when(blank, 1.0).when(F.coalesce(given, F.lit("")) == "", 0.0).when(hit, 1.0).otherwise(0.0)

    return F.transform(F.map_keys(ref), one)


