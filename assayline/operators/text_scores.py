"""Token, n-gram and edit scores between predictions and references.

Overlaps are counted inside the row: both sides of a sample lie in it, so no gram is
shuffled, and only counts leave the task. Samples with equal ids stay apart.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline import fixed_values as V
from assayline.functions.answers import normalize_qa
from assayline.functions.rewrite import apply_rules, trim_space
from assayline.functions.text import words


def overlap(
    df: DataFrame,
    ids: Sequence[str],
    pred: str,
    ref: str,
    orders: Sequence[int] = (1,),
) -> DataFrame:
    """Per sample and order k: shared grams ``match_k``, and gram counts ``pred_k`` and
    ``ref_k`` of the token arrays ``pred`` and ``ref``; a null array has no grams."""
    found = overlap_counts(F.col(pred), F.col(ref), orders)
    return df.select(*ids, found.alias("_o")).select(*ids, "_o.*")


#: Tokens of a slice of rows that are counted together; one row is never cut.
SLICE_TOKENS = 1 << 19


def overlap_counts(pred: Column, ref: Column, orders: Sequence[int]) -> Column:
    """The counts of ``overlap`` as a struct of two token arrays, or of two texts, whose tokens
    are their characters. A batch is counted in slices of about ``SLICE_TOKENS`` tokens."""
    names = [f"{n}_{k}" for k in orders for n in ("match", "pred", "ref")]

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def count(preds: pa.Array, refs: pa.Array) -> pa.Array:
        sizes = np.cumsum(np.maximum(token_sizes(preds), token_sizes(refs)))
        parts, start = [], 0
        while start < len(preds):
            limit = (sizes[start - 1] if start else 0) + SLICE_TOKENS
            stop = max(start + 1, int(np.searchsorted(sizes, limit, "right")))
            codes, ends = coded([side.slice(start, stop - start) for side in (preds, refs)])
            parts.append(shared_counts(codes, ends, orders))
            start = stop
        table = np.concatenate(parts, axis=1) if parts else np.zeros((len(names), 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(c) for c in table], names)

    return count(pred, ref)


def _is_text(side: pa.Array) -> bool:
    return pa.types.is_string(side.type) or pa.types.is_large_string(side.type)


def token_sizes(side: pa.Array) -> np.ndarray:
    """Tokens of every row; a null has none."""
    sizes = pc.utf8_length(side) if _is_text(side) else pc.list_value_length(side)
    return pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def coded(sides: Sequence[pa.Array]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Tokens of the sides in row order as small numbers, equal where the tokens are, and how
    many there are up to the end of every row."""
    ends = [np.cumsum(token_sizes(side)) for side in sides]
    if _is_text(sides[0]):
        texts = ["".join(t or "" for t in side.to_pylist()) for side in sides]
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.unique(flat, return_inverse=True)[1]
    else:
        flat = [side.flatten() for side in sides]
        # parts without a token are left out: joining them to others failed
        kept = pa.chunked_array([f for f in flat if len(f)], flat[0].type).combine_chunks()
        codes = kept.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    cuts = np.cumsum([int(e[-1]) if len(e) else 0 for e in ends])[:-1]
    return np.split(codes.astype(np.int64), cuts), ends


def code_lists(sides: Sequence[pa.Array]) -> list[list[list[int]]]:
    """The rows of ``coded`` sides as lists of numbers."""
    out = []
    for codes, ends in zip(*coded(sides)):
        flat, ends = codes.tolist(), ends.tolist()
        out.append([flat[a:b] for a, b in zip([0, *ends], ends)])
    return out


def grouped(rows: Sequence, side: pa.Array) -> list[Sequence]:
    """The elements of the lists of a side, as lists again; a null has none."""
    ends = np.cumsum(token_sizes(side)).tolist()
    return [rows[a:b] for a, b in zip([0, *ends], ends)]


def shared_counts(
    codes: Sequence[np.ndarray], ends: Sequence[np.ndarray], orders: Sequence[int]
) -> np.ndarray:
    """Per order and row of two sides: grams in both, counted as often as in the poorer one, and
    grams of each. A gram of k tokens is its first k - 1 tokens, numbered, and its last one."""
    rows = len(ends[0])
    sizes = [np.diff(e, prepend=0) for e in ends]
    row = np.concatenate([np.repeat(np.arange(rows), n) for n in sizes])
    token = np.concatenate(codes)
    total, first = len(token), len(codes[0])
    left = np.concatenate([np.repeat(e, n) for e, n in zip(ends, sizes)])
    left = left - np.concatenate([np.arange(len(c)) for c in codes])  # tokens up to the row's end
    place, gram, many = np.arange(total), token, int(token.max(initial=0)) + 1
    kinds, out = many, []
    for k in range(1, max(orders) + 1):
        if k > 1:
            long = left[place] >= k
            place, gram = place[long], gram[long]
            if rows * many * kinds >= 1 << 61:
                known, gram = np.unique(gram, return_inverse=True)
                many = len(known)
            gram, many = gram * kinds + token[place + k - 1], many * kinds
        if k not in orders:
            continue
        if rows * many >= 1 << 61:
            known, gram = np.unique(gram, return_inverse=True)
            many = max(len(known), 1)
        key = np.sort(((row[place] * many + gram) << 1) | (place >= first))
        start = np.flatnonzero(np.diff(key, prepend=-1))
        n, key = np.diff(start, append=len(key)), key[start]
        both = np.flatnonzero(key[:-1] ^ 1 == key[1:])
        least = np.minimum(n[both], n[both + 1])
        match = np.bincount((key[both] >> 1) // many, least, rows).astype(np.int64)
        out += [match, *[np.maximum(s - k + 1, 0) for s in sizes]]
    return np.stack(out)


def overlap_refs(
    df: DataFrame,
    ids: Sequence[str],
    pred: str,
    refs: str,
    orders: Sequence[int] = (1,),
    length: str = "closest",
) -> DataFrame:
    """As ``overlap`` against several references, an array of token arrays: a gram counts as
    often as in the reference that has most of it. ``ref_k`` is the gram count of the
    ``closest`` (of two the shorter) or ``shortest`` reference; without references 0."""
    names = [f"{n}_{k}" for k in orders for n in ("match", "pred", "ref")]

    @F.arrow_udf(", ".join(f"{n} long" for n in names))
    def count(preds: pa.Array, sides: pa.Array) -> pa.Array:
        out = []
        for p, known in zip(preds.to_pylist(), sides.to_pylist()):
            p, known = p or [], [r or [] for r in known or []]
            near = (lambda n, p=p: (abs(n - len(p)), n)) if length == "closest" else (lambda n: n)
            size = min(map(len, known), key=near, default=0)
            row = []
            for k in orders:
                most = Counter()
                for r in known:
                    most |= gram_counter(r, k)
                own = gram_counter(p, k)
                row += [(own & most).total(), own.total(), max(size - k + 1, 0)]
            out.append(row)
        cols = list(zip(*out)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return df.select(*ids, count(F.col(pred), F.col(refs)).alias("_o")).select(*ids, "_o.*")


def gram_counter(tokens: list[str], k: int) -> Counter:
    return Counter(zip(*[tokens[i:] for i in range(k)]))


def f_from_counts(match: Column, pred: Column, ref: Column) -> Column:
    """F1 from overlap counts; two empty sides agree."""
    both = pred + ref
    return (
        F.when(both == 0, 1.0).when(match == 0, 0.0).otherwise(2.0 * match / both)
    )


def token_scores(
    df: DataFrame,
    ids: Sequence[str],
    pred: str,
    ref: str,
    normalizer: Callable = normalize_qa,
    empty_agrees: bool = True,
) -> DataFrame:
    """``em`` and ``f1`` over normalized words per sample; two texts without words have
    F1 1, or 0 unless ``empty_agrees``."""
    tidy = df.select(*ids, normalizer(F.col(pred)).alias("_p"), normalizer(F.col(ref)).alias("_r"))
    rows = tidy.select(
        *ids, (F.col("_p") == F.col("_r")).cast("int").alias("em"),
        words(F.col("_p")).alias("_pw"), words(F.col("_r")).alias("_rw"),
    )
    counts = overlap(rows, [*ids, "em"], "_pw", "_rw")
    f1 = f_from_counts(F.col("match_1"), F.col("pred_1"), F.col("ref_1"))
    if not empty_agrees:
        f1 = F.when(F.col("match_1") == 0, 0.0).otherwise(f1)
    return counts.select(*ids, "em", f1.alias("f1"))


def max_over_refs(
    df: DataFrame, ids: Sequence[str], pred: str, refs: str, normalizer: Callable = normalize_qa
) -> DataFrame:
    """Best ``em`` and ``f1`` over an array of references."""
    long = df.select(*ids, pred, F.posexplode(refs).alias("_ref_no", "_ref"))
    per_ref = token_scores(long, [*ids, "_ref_no"], pred, "_ref", normalizer)
    return per_ref.groupBy(*ids).agg(F.max("em").alias("em"), F.max("f1").alias("f1"))


def leave_one_out(
    df: DataFrame, ids: Sequence[str], pred: str, golds: str, normalizer: Callable = normalize_qa
) -> DataFrame:
    """Mean over golds of the best score against the other golds; a single gold counts
    itself. The best of the others is the second best exactly where the best is left
    out, so every gold is scored once."""
    long = df.select(*ids, pred, F.posexplode(golds).alias("_g", "_gold"))
    per = token_scores(long, [*ids, "_g"], pred, "_gold", normalizer)

    def mean_of_best_others(col: str) -> Column:
        n, top = F.count(F.lit(1)), F.max(col)
        second = F.get(F.sort_array(F.collect_list(col), asc=False), F.lit(1))
        return ((top * (n - 1) + F.coalesce(second, top)) / n).alias(col)

    return per.groupBy(*ids).agg(mean_of_best_others("em"), mean_of_best_others("f1"))


def group_best(
    df: DataFrame, group: str, idx: str, pred: str, ref: str, normalizer: Callable = normalize_qa
) -> DataFrame:
    """Per group of (prediction, reference) rows: ``em`` is the share of predictions
    equal to any reference, ``f1`` the best of the first prediction."""
    tidy = df.select(
        group, idx, normalizer(F.col(pred)).alias("_p"), normalizer(F.col(ref)).alias("_r")
    )
    known = tidy.select(group, F.col("_r").alias("_p")).distinct().withColumn("_hit", F.lit(1))
    em = (
        tidy.join(known, [group, "_p"], "left")
        .groupBy(group)
        .agg(F.count("_hit").alias("_hits"), F.count(F.lit(1)).alias("_n"))
    )
    first = tidy.groupBy(group).agg(F.min_by("_p", idx).alias("_first"))
    pairs = tidy.join(first, group).select(group, idx, "_first", "_r")
    raw = lambda c: c  # noqa: E731  (already normalized)
    f1 = token_scores(pairs, [group, idx], "_first", "_r", raw, empty_agrees=False)
    best = f1.groupBy(group).agg(F.max("f1").alias("f1"))
    return em.join(best, group).select(
        group, (F.col("_hits") / F.col("_n")).alias("em"), "_n", "f1"
    ).withColumnRenamed("_n", "rows")


# --- BLEU, chrF, ROUGE, TER ------------------------------------------------------------


def translation_tokens(col: Column, lower: bool = False) -> Column:
    return words(apply_rules(F.lower(col) if lower else col, V.TRANSLATION_TOKENS))


def code_tokens(col: Column) -> Column:
    """Words and single signs of a lower-case text, then the translation tokenizer."""
    pieces = F.regexp_extract_all(F.lower(trim_space(col)), F.lit(r"(?U)\w+|[^\s\w]"), F.lit(0))
    return translation_tokens(F.array_join(pieces, " "), lower=True)


ORDERS = tuple(range(1, V.BLEU_ORDER + 1))


def bleu_sums(
    df: DataFrame,
    ids: Sequence[str],
    pred: str,
    ref: str,
    tokens: Callable = translation_tokens,
    length: str = "closest",
) -> DataFrame:
    """Gram counts per sample; ``ref`` is a text or an array of texts (several references)."""
    if isinstance(df.schema[ref].dataType, T.ArrayType):
        sides = F.transform(F.col(ref), lambda c: tokens(c))
        split = df.select(*ids, tokens(F.col(pred)).alias("_p"), sides.alias("_r"))
        return overlap_refs(split, ids, "_p", "_r", ORDERS, length)
    split = df.select(*ids, tokens(F.col(pred)).alias("_p"), tokens(F.col(ref)).alias("_r"))
    return overlap(split, ids, "_p", "_r", ORDERS)


def smoothed_bleu4(df: DataFrame, ids: Sequence[str], pred: str, ref: str) -> DataFrame:
    """Smoothed BLEU-4 per sample in percent: one is added to counts above unigrams. Of
    several references the shortest gives the length."""
    sums = bleu_sums(df, ids, pred, ref, code_tokens, "shortest")
    tiny = 2.2250738585072014e-308  # smallest normal double keeps log(0) finite
    logs = F.lit(0.0)
    for k in ORDERS:
        add = 1 if k > 1 else 0
        logs = logs + F.log(F.col(f"match_{k}") + add + F.lit(tiny)) - F.log(
            F.col(f"pred_{k}") + add + F.lit(tiny)
        )
    penalty = F.least(F.lit(0.0), 1 - (F.col("ref_1") + 1) / (F.col("pred_1") + 1))
    score = 100 * F.exp(logs / len(ORDERS) + penalty)
    return sums.select(*ids, score.alias("bleu"))


def bleu_score(count: Callable[[str, int], Column]) -> Column:
    """BLEU in percent from ``count`` of (match, pred or ref, order); zero matches are halved
    repeatedly."""
    match, pred, ref1 = (lambda k: count("match", k)), (lambda k: count("pred", k)), count("ref", 1)
    logs, halves = F.lit(0.0), F.lit(1.0)
    for k in ORDERS:
        none = (match(k) == 0) & (pred(k) > 0)
        halves = F.when(none, halves * 2).otherwise(halves)
        value = F.when(none, 1.0 / (halves * pred(k))).otherwise(match(k) / pred(k))
        logs = logs + F.log(F.when(pred(k) > 0, value))
    brevity = F.when(pred(1) < ref1, F.exp(1 - ref1 / pred(1))).otherwise(1.0)
    score = 100 * brevity * F.exp(logs / len(ORDERS))
    # any order without grams, or no match at all, gives zero
    return F.when(match(1) == 0, 0.0).otherwise(F.coalesce(score, F.lit(0.0)))


def sample_bleu(df: DataFrame, ids: Sequence[str], pred: str, ref: str) -> DataFrame:
    sums = bleu_sums(df, ids, pred, ref)
    score = bleu_score(lambda name, k: F.col(f"{name}_{k}").cast("double"))
    return sums.select(*ids, score.alias("bleu"))


def corpus_bleu(
    df: DataFrame, ids: Sequence[str], pred: str, ref: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Corpus BLEU: counts are summed over samples before the score is taken."""
    sums = bleu_sums(df, ids, pred, ref)
    names = [f"{n}_{k}" for k in ORDERS for n in ("match", "pred", "ref")]
    total = sums.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(c) for c in names])
    score = bleu_score(lambda name, k: F.col(f"{name}_{k}"))
    return total.select(*keys, score.alias("bleu"))


def characters(col: Column) -> Column:
    """The text without white space; its characters are the tokens."""
    return F.regexp_replace(col, V.WHITESPACE, "")


def chrf(
    df: DataFrame, ids: Sequence[str], pred: str, ref: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Character n-gram F score in percent over the whole corpus."""
    orders = tuple(range(1, V.CHRF_ORDER + 1))
    split = df.select(*ids, characters(F.col(pred)).alias("_p"), characters(F.col(ref)).alias("_r"))
    sums = overlap(split, ids, "_p", "_r", orders)
    names = [f"{n}_{k}" for k in orders for n in ("match", "pred", "ref")]
    total = sums.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(c) for c in names])
    score = chrf_score(lambda name, k: F.col(f"{name}_{k}"))
    return total.select(*keys, score.alias("chrf"))


def chrf_score(count: Callable[[str, int], Column]) -> Column:
    """chrF in percent from ``count`` of (match, pred or ref, order)."""
    used, precision, recall = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for k in range(1, V.CHRF_ORDER + 1):
        m, p, r = (count(n, k) for n in ("match", "pred", "ref"))
        both = (p > 0) & (r > 0)
        used = used + F.when(both, 1.0).otherwise(0.0)
        precision = precision + F.when(both, m / p).otherwise(0.0)
        recall = recall + F.when(both, m / r).otherwise(0.0)
    p, r = F.try_divide(precision, used), F.try_divide(recall, used)
    b2 = float(V.CHRF_BETA**2)
    score = F.try_divide((1 + b2) * p * r, b2 * p + r)
    return 100 * F.coalesce(score, F.lit(0.0))


def rouge_n(
    df: DataFrame, ids: Sequence[str], pred: str, ref: str, n: int = 1, tokens: Callable | None = None
) -> DataFrame:
    """ROUGE-n F measure per sample over lower-case letter and digit words."""
    split = tokens or (lambda c: words(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")))
    rows = df.select(*ids, split(F.col(pred)).alias("_p"), split(F.col(ref)).alias("_r"))
    sums = overlap(rows, ids, "_p", "_r", (n,))
    score = F.try_divide(2.0 * F.col(f"match_{n}"), F.col(f"pred_{n}") + F.col(f"ref_{n}"))
    return sums.select(*ids, F.coalesce(score, F.lit(0.0)).alias(f"rouge{n}"))


def clean_summary(col: Column) -> Column:
    bare = F.translate(col, V.PUNCTUATION, "")
    return F.lower(F.trim(F.regexp_replace(bare, V.WHITESPACE, " ")))


def rouge1(df: DataFrame, ids: Sequence[str], pred: str, ref: str) -> DataFrame:
    """Mean ROUGE-1 and mean length in words, after cleaning both texts."""
    tidy = df.select(
        *ids, clean_summary(F.col(pred)).alias("_cp"), clean_summary(F.col(ref)).alias("_cr")
    ).withColumn("_len", F.size(words(F.col("_cp"))))
    return rouge_n(tidy, [*ids, "_len"], "_cp", "_cr", 1).agg(
        F.avg("rouge1").alias("rouge1"), F.avg("_len").alias("average_len")
    )


def _codes(a: Sequence, b: Sequence) -> tuple[list[int], list[int]]:
    known: dict = {}
    x, y = ([known.setdefault(word, len(known)) for word in side] for side in (a, b))
    return x, y


def _places(a: Sequence) -> dict:
    """Bits at the places of every value of ``a``."""
    found: dict = {}
    for i, word in enumerate(a):
        found.setdefault(word, []).append(i)
    size = len(a) // 8 + 1
    out = {}
    for word, at in found.items():
        bits = bytearray(size)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        out[word] = int.from_bytes(bits, "little")
    return out


def _next_column(size: int) -> Callable[[tuple[int, int, int], int], tuple[tuple[int, int, int], int, int]]:
    """Step of the edit table of a list of ``size`` values down, as bits over it: from a column
    (cells above, cells below their upper neighbour, last cell) and the places of the next
    value across to the next column, and the cells that equal their upper left neighbour and
    that are one above their left neighbour."""
    every, last = (1 << size) - 1, 1 << size >> 1

    def step(column: tuple[int, int, int], same: int) -> tuple[tuple[int, int, int], int, int]:
        up, down, score = column
        level = (((same & up) + up) ^ up) | same | down
        more = down | (every & ~(level | up))
        less = up & level
        score += bool(more & last) - bool(less & last)
        right = (more << 1) | 1
        return (every & ((less << 1) | ~(level | right)), right & level & every, score), level, more

    return step


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Edit distance of two lists, a column of the table in a few operations on bits. What both
    begin or end with costs nothing."""
    start, stop, short = 0, 0, min(len(a), len(b))
    while start < short and a[start] == b[start]:
        start += 1
    while stop < short - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    step, places, column = _next_column(len(a)), _places(a), ((1 << len(a)) - 1, 0, len(a))
    for word in b:
        column, _, _ = step(column, places.get(word, 0))
    return column[2]


def common_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence of two lists, on bits as well."""
    every = (1 << len(a)) - 1
    places, open_ = _places(a), every
    for word in b:
        met = open_ & places.get(word, 0)
        open_ = ((open_ + met) | (open_ - met)) & every
    return len(a) - open_.bit_count()


@F.pandas_udf(T.IntegerType())
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x, y) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def common_words(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_length(x, y) for x, y in zip(a, b)], dtype="int32")


def wer(df: DataFrame, pred: str, ref: str, keys: Sequence[str] = ()) -> DataFrame:
    """Word error rate: word edits over reference words, per key."""
    p, r = words(F.col(pred)), words(F.col(ref))
    rows = df.select(*keys, word_edits(p, r).alias("_e"), F.size(r).alias("_n"))
    return rows.groupBy(*keys).agg(F.try_divide(F.sum("_e"), F.sum("_n")).alias("wer"))


#: Longest moved group of words and farthest move that TER looks at: part of its definition.
SHIFT_WORDS, SHIFT_REACH = 10, 50


def edit_path(x: Sequence, y: Sequence) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For two lists: which words of ``x`` and of ``y`` are matched on a cheapest edit path, and
    where every word of ``y`` falls in ``x``. The table is kept as two bits a cell."""
    steps, step, places = [], _next_column(len(x)), _places(x)
    column = ((1 << len(x)) - 1, 0, len(x))
    for word in y:
        column, *bits = step(column, places.get(word, 0))
        steps.append(bits)
    fit_x, fit_y, place = np.zeros(len(x), bool), np.zeros(len(y), bool), np.zeros(len(y), int)
    i, j = len(x), len(y)
    while i or j:
        level, more = (bits >> (i - 1) & 1 for bits in steps[j - 1]) if i and j else (0, 1)
        if i and j and (x[i - 1] == y[j - 1] or not level):
            i, j = i - 1, j - 1
            fit_x[i] = fit_y[j] = x[i] == y[j]
            place[j] = i
        elif j and more:
            j -= 1
            place[j] = i
        else:
            i -= 1
    return fit_x, fit_y, place


def moves(x: list[int], y: list[int]) -> list[tuple[int, int, int]]:
    """(words, from, to) of the moves of one group of words of ``x`` to where ``y`` has the same
    group: longer groups first, then earlier ones. Groups that fit already stay."""
    fit_x, fit_y, place = (side.tolist() for side in edit_path(x, y))
    where: dict[int, list[int]] = {}
    for j, word in enumerate(y):
        where.setdefault(word, []).append(j)
    found = []
    for i, word in enumerate(x):
        near = where.get(word, [])
        near = near[bisect_left(near, i - SHIFT_REACH) : bisect_right(near, i + SHIFT_REACH)]
        for j in near:
            out_x = out_y = False
            for n in range(1, SHIFT_WORDS + 1):
                if i + n > len(x) or j + n > len(y) or x[i + n - 1] != y[j + n - 1]:
                    break
                out_x, out_y = out_x or not fit_x[i + n - 1], out_y or not fit_y[j + n - 1]
                if out_x and out_y and not i <= place[j] < i + n:
                    found.append((-n, i, j, place[j]))
    tried, out = set(), []
    for n, i, _, to in sorted(found):
        if (n, i, to) not in tried:
            tried.add((n, i, to))
            out.append((-n, i, to))
    return out


def best_move(x: list[int], y: list[int], cost: int) -> tuple[int, list[int]]:
    """Lowest distance after one move, and the words after it; of equal gains the longer group,
    then the earlier. A move of n words gains 2 n at most, so the search ends at the first
    move that no later one can beat. A move is tried from the first word it touches on, until
    a column of the table beyond the last one is as it was without the move."""
    step, places = _next_column(len(y)), _places(y)
    columns = [((1 << len(y)) - 1, 0, len(y))]
    for word in x:
        columns.append(step(columns[-1], places.get(word, 0))[0])
    gain, after = 0, x
    for n, i, to in moves(x, y):
        if gain >= 2 * n:
            break
        first, end = min(i, to), max(i + n, to)
        part = x[to:i] if to < i else x[i + n : to]
        part = x[i : i + n] + part if to < i else part + x[i : i + n]
        column = columns[first]
        for word in part:
            column = step(column, places.get(word, 0))[0]
        while end < len(x) and column[:2] != columns[end][:2]:
            column = step(column, places.get(x[end], 0))[0]
            end += 1
        less = columns[end][2] - column[2]
        if less > gain:
            gain, after = less, x[:first] + part + x[first + len(part) :]
    return cost - gain, after


def shifted_edits(pred: list[str], ref: list[str]) -> int:
    """Edits with moves of word groups as one edit each, the best move first."""
    x, y = _codes(pred, ref)
    cost, made = edit_distance(x, y), 0
    while cost > 1:  # a move saves nothing below two edits
        less, moved = best_move(x, y, cost)
        if less == cost:
            break
        cost, x, made = less, moved, made + 1
    return cost + made


MOVE_EDITS = T.StructType().add("edits", T.IntegerType()).add("size", T.DoubleType())


@F.arrow_udf(MOVE_EDITS)
def move_edits(preds: pa.Array, refs: pa.Array) -> pa.Array:
    """Fewest edits to any reference and the mean length of the references."""
    mine, flat = code_lists([preds, refs.flatten()])
    edits, sizes = [], []
    for p, known in zip(mine, grouped(flat, refs)):
        edits.append(min((shifted_edits(p, r) for r in known), default=0))
        sizes.append(sum(map(len, known)) / max(len(known), 1))
    cols = [pa.array(edits, pa.int32()), pa.array(sizes, pa.float64())]
    return pa.StructArray.from_arrays(cols, ["edits", "size"])


def ter(df: DataFrame, pred: str, ref: str, keys: Sequence[str] = ()) -> DataFrame:
    """Translation edit rate in percent, per key: insertions, deletions, replacements and
    moves of word groups over reference words. ``ref`` is a text or an array of texts; the
    nearest reference counts, over the mean length. A null text has no words."""
    split = lambda c: words(F.coalesce(c, F.lit("")))
    many = isinstance(df.schema[ref].dataType, T.ArrayType)
    sides = F.transform(F.col(ref), lambda c: split(c)) if many else F.array(split(F.col(ref)))
    sides = F.coalesce(sides, F.array().cast("array<array<string>>"))
    rows = df.select(*keys, move_edits(split(F.col(pred)), sides).alias("_e"))
    rate = F.try_divide(F.sum("_e.edits"), F.sum("_e.size"))
    return rows.groupBy(*keys).agg((100 * rate).alias("ter"))


def rouge_l(df: DataFrame, ids: Sequence[str], pred: str, ref: str) -> DataFrame:
    """ROUGE-L F measure per sample, each text taken as one sentence."""
    split = lambda c: words(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    rows = df.select(*ids, split(F.col(pred)).alias("_p"), split(F.col(ref)).alias("_r"))
    score = F.try_divide(
        2.0 * common_words("_p", "_r"), F.size("_p") + F.size("_r")
    )
    return rows.select(*ids, F.coalesce(score, F.lit(0.0)).alias("rougeL"))


def common_places(x: Sequence, y: Sequence) -> set[int]:
    """Places in ``x`` of a longest common subsequence with ``y``. A column of the table is kept
    as bits: where the length grows from one word of ``x`` to the next."""
    every = (1 << len(x)) - 1
    places, open_, grown = _places(x), every, []
    if places.keys().isdisjoint(y):
        return set()
    for word in y:
        met = open_ & places.get(word, 0)
        if met:
            open_ = ((open_ + met) | (open_ - met)) & every
        grown.append(~open_)
    found, i, j = set(), len(x) - 1, len(y) - 1
    while i >= 0 and j >= 0:
        if x[i] == y[j]:
            found.add(i)
            i, j = i - 1, j - 1
        elif grown[j] >> i & 1:
            j -= 1
        else:
            i -= 1
    return found


def summary_hits(pred: list[list[str]], ref: list[list[str]]) -> int:
    """Words of the reference sentences on a common subsequence with any predicted sentence,
    each at most as often as the prediction has it."""
    have = Counter(w for s in pred for w in s)
    hits = 0
    for sentence in ref:
        for i in sorted(set().union(*[common_places(sentence, p) for p in pred])):
            if have[sentence[i]] > 0:
                have[sentence[i]] -= 1
                hits += 1
    return hits


@F.arrow_udf(T.IntegerType())
def common_summary(preds: pa.Array, refs: pa.Array) -> pa.Array:
    flat = code_lists([preds.flatten(), refs.flatten()])
    rows = zip(*[grouped(sentences, side) for sentences, side in zip(flat, (preds, refs))])
    return pa.array([summary_hits(p, r) for p, r in rows], pa.int32())


def rouge_l_sum(df: DataFrame, ids: Sequence[str], pred: str, ref: str) -> DataFrame:
    """Summary-level ROUGE-L F measure per sample: sentences end at " . " and at line ends.
    A null text has no sentences."""
    clean = lambda c: words(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    lines = lambda c: F.split(F.replace(F.coalesce(c, F.lit("")), F.lit(" . "), F.lit(".\n")), "\n")
    split = lambda c: F.filter(F.transform(lines(F.col(c)), clean), lambda s: F.size(s) > 0)
    rows = df.select(*ids, split(pred).alias("_p"), split(ref).alias("_r"))
    both = F.size(F.flatten("_p")) + F.size(F.flatten("_r"))
    score = F.try_divide(2.0 * common_summary("_p", "_r"), both)
    return rows.select(*ids, F.coalesce(score, F.lit(0.0)).alias("rougeL"))


def true_false_refs(
    df: DataFrame, ids: Sequence[str], pred: str, true_refs: str, false_refs: str, metric: str
) -> DataFrame:
    """Generation against true and false references: best true score, difference to
    the best false score, and whether the true side wins. Metric: bleu, rouge1,
    rouge2 or rougeL (summary-level), in percent."""
    dot = lambda r: F.when(r.endswith("."), r).otherwise(F.concat(r, F.lit(".")))
    tidy = lambda arr: F.transform(F.filter(F.transform(arr, trim_space), lambda r: r != ""), dot)
    plain = "I have no comment."
    true = tidy(F.col(true_refs))
    true = F.when(F.array_contains(true, plain), true).otherwise(F.array_append(true, F.lit(plain)))
    mark = lambda arr, flag: F.transform(arr, lambda r: F.struct(r.alias("ref"), F.lit(flag).alias("is_true")))
    refs = F.concat(mark(true, True), mark(tidy(F.col(false_refs)), False))
    named = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ids]))
    long = named.select(*ids, pred, F.explode(refs).alias("_r")).select(
        *ids, pred, F.col("_r.ref").alias("_ref"), F.col("_r.is_true").alias("_true")
    )
    keys = [*ids, "_true"]
    if metric == "bleu":
        scored = sample_bleu(long, keys, pred, "_ref").withColumnRenamed("bleu", "_s")
    elif metric == "rougeL":
        scored = rouge_l_sum(long, keys, pred, "_ref").withColumn("_s", 100 * F.col("rougeL"))
    else:
        n = int(metric.removeprefix("rouge"))
        scored = rouge_n(long, keys, pred, "_ref", n).withColumn("_s", 100 * F.col(f"rouge{n}"))
    best = scored.groupBy(*ids).agg(
        F.max(F.when(F.col("_true"), F.col("_s"))).alias("_t"),
        F.max(F.when(~F.col("_true"), F.col("_s"))).alias("_f"),
    )
    return best.select(
        *ids,
        F.col("_t").alias(f"{metric}_max"),
        (F.col("_t") - F.col("_f")).alias(f"{metric}_diff"),
        F.coalesce((F.col("_t") > F.col("_f")).cast("int"), F.lit(0)).alias(f"{metric}_acc"),
    )


# --- span bags --------------------------------------------------------------------


def _number(word: str) -> bool:
    if word.isalpha() and word.lower() not in ("nan", "inf", "infinity"):
        return False
    try:
        float(word)
    except ValueError:
        return False
    return True


_BARE = str.maketrans("", "", "".join(V.PUNCTUATION))


def _span_words(span: str) -> list[str]:
    out = []
    for token in re.split(" |-", span.lower()):
        number = _number(token)
        if not number:
            token = token.translate(_BARE)
            number = _number(token)
        if number:
            token = str(float(token))
        out.extend(re.sub(r"\b(a|an|the)\b", " ", token).split())
    return out


def best_assignment(gain: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """Row-column pairs of a one-to-one assignment with the largest total gain
    (shortest augmenting paths, exact for any size)."""
    if len(gain) * len(gain[0]) == 1:
        return [(0, 0)]
    flip = len(gain) > len(gain[0])
    cost = [[-x for x in row] for row in (zip(*gain) if flip else gain)]
    n, m = len(cost), len(cost[0])
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        low, back, left, seen = [math.inf] * (m + 1), [0] * (m + 1), list(range(1, m + 1)), []
        while owner[j]:
            seen.append(j)
            row, less, step, nxt = cost[owner[j] - 1], u[owner[j]], math.inf, 0
            for c in left:
                slack = row[c - 1] - less - v[c]
                if slack < low[c]:
                    low[c], back[c] = slack, j
                if low[c] < step:
                    step, nxt = low[c], c
            for c in seen:
                u[owner[c]] += step
                v[c] -= step
            left.remove(nxt)
            for c in left:
                low[c] -= step
            j = nxt
        while j:
            owner[j], j = owner[back[j]], back[j]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(c, r) for r, c in pairs] if flip else pairs


def bag_f1(one: set[str], two: set[str]) -> float:
    """Harmonic mean of the shared part of either bag; two empty bags agree."""
    if not one & two:
        return float(not one and not two)
    a, b = (len(one & two) / len(bag) for bag in (one, two))
    return 2 * a * b / (a + b)


def span_scores(pred: Sequence[str], gold: Sequence[str]) -> tuple[float, float]:
    """Exact match and F1 of two lists of spans with the best alignment."""
    p, g = [_span_words(s) for s in pred], [_span_words(s) for s in gold]
    joined = lambda bags: [" ".join(b) for b in bags]
    exact = set(joined(p)) == set(joined(g)) and len(p) == len(g)
    bags, gain = [set(pw) for pw in p], []
    for gw in map(set, g):
        numbers = {w for w in gw if _number(w)}
        gain.append([0.0 if numbers and not numbers & pw else bag_f1(pw, gw) for pw in bags])
    total = sum(gain[i][j] for i, j in best_assignment(gain)) if p and g else 0.0
    return float(exact), round(total / max(len(p), len(g), 1), 2)


SPAN_SCORE = T.StructType().add("em", T.DoubleType()).add("f1", T.DoubleType())


@F.pandas_udf(SPAN_SCORE)
def span_f1(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Best exact match and F1 of a span list over several gold span lists; golds with
    an empty first span are passed over."""
    for pred, golds in batches:
        rows = []
        for spans, refs in zip(pred, golds):
            scores = [span_scores(spans, r) for r in refs if len(r) and r[0].strip()]
            rows.append(
                (max((s[0] for s in scores), default=0.0), max((s[1] for s in scores), default=0.0))
            )
        yield pd.DataFrame(rows, columns=["em", "f1"])
