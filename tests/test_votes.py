"""Votes by leader classes against the plain loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assayline.operators import vote

FORMS = [lambda a: F.substring(a, 1, 1), lambda a: F.substring(a, 2, 1)]
SCHEMA = "q string, i long, a string, w double"


def equal(x, y):
    return x is not None and y is not None and (x[0] == y[0] or x[1] == y[1])


def plain_vote(said):
    """Winner and vote of one question: ``said`` is (idx, answer, weight) in order."""
    openers, totals, best, shown = [], [], 0.0, None
    for _, answer, weight in sorted(said):
        met = [i for i, first in enumerate(openers) if equal(answer, first)]
        for i in met:
            totals[i] += weight
            if totals[i] > best:
                best, shown = totals[i], answer
        if not met:
            openers.append(answer)
            totals.append(weight)
            if best == 0:
                best, shown = weight, answer
    return shown, best


@pytest.mark.parametrize("seed,letters,weights", [(1, "abc", (1,)), (2, "abcdef", (0, 1, 2)), (3, "abcd", (0, 0, 3))])
def test_leader_classes_vote_like_the_loop(spark, seed, letters, weights):
    rng = random.Random(seed)
    said = {}
    for q in [f"q{k}" for k in range(25)] + [None]:
        for i in rng.sample(range(1000), rng.randint(1, 14)):
            text = None if rng.random() < 0.1 else rng.choice(letters) + rng.choice(letters)
            said.setdefault(q, []).append((i, text, float(rng.choice(weights))))
    rows = [(q, *row) for q, group in said.items() for row in group]
    df = spark.createDataFrame(rows, SCHEMA)
    out = vote.weighted_vote(df, ["q"], "i", "a", F.col("w"), forms=FORMS).collect()
    got = {r["q"]: (r["a"], r["vote"]) for r in out}
    assert got == {q: plain_vote(group) for q, group in said.items()}


def test_middle_answer_joins_both_openers(spark):
    rows = [("q", 1, "ax", 2.0), ("q", 2, "by", 1.0), ("q", 3, "ay", 1.5)]
    df = spark.createDataFrame(rows, SCHEMA)
    classes = vote.leader_classes(df, ["q"], "i", "a", FORMS)
    assert sorted((r["a"], r["_class"]) for r in classes.collect()) == [
        ("ax", "ax"), ("ay", "ax"), ("ay", "by"), ("by", "by")
    ]
    out = vote.weighted_vote(df, ["q"], "i", "a", F.col("w"), forms=FORMS).first()
    assert (out["a"], out["vote"]) == ("ay", 3.5)


def test_no_answers(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert vote.weighted_vote(df, ["q"], "i", "a", forms=FORMS).isEmpty()
