"""Aggregates, answers and scores with hand-computed values."""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
import math
import random
import re
import statistics
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayline.functions import answers as X
from assayline.functions import checks as C
from assayline.functions import scores as S
from assayline.functions.math_text import normalize_math
from assayline.operators import aggregate as A
from assayline.operators import statistics as ST
from assayline.operators import text_scores as TS
from conftest import SF


def one(spark, expr, **values):
    """Value of a column expression over literal inputs."""
    schema = ", ".join(f"{k} string" for k in values) or "x int"
    row = tuple(values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_subtask_mean(spark):
    df = spark.createDataFrame([(0.3, 20), (0.2, 40), (0.4, 100)], "v double, n int")
    got = df.agg(A.subtask_mean("v", "n", False).alias("p"), A.subtask_mean("v", "n").alias("w")).first()
    assert got["p"] == pytest.approx(0.3) and got["w"] == pytest.approx(0.3375)


def test_pooled_error_close_to_whole_sample(spark):
    rng = random.Random(0)
    lists = [[int(rng.random() < p) for _ in range(n)] for p, n in ((0.4, 100), (0.5, 60), (0.25, 80))]
    se = lambda x: statistics.stdev(x) / math.sqrt(len(x))
    df = spark.createDataFrame([(se(x), len(x)) for x in lists], "stderr double, n int")
    pooled = df.agg(A.pooled_stderr().alias("s")).first()["s"]
    assert pooled == pytest.approx(se([v for x in lists for v in x]), abs=2e-3)


def test_bootstrap_close_to_analytic(spark):
    rng = random.Random(1)
    values = [rng.random() for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    items = {"v": (ST.mean, F.col("v"))}
    got = ST.bootstrap(df, [], items, ["id"], iters=1000).first()["v_stderr"]
    assert got == pytest.approx(statistics.stdev(values) / math.sqrt(1000), rel=0.06)


def test_bootstrap_replays(spark):
    """Median, F1 and the limit on replicates against weights drawn here."""
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randrange(6), rng.randrange(3), rng.randrange(3)) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, k string, v int, g int, p int")
    draw = lambda i, b, r: sum(
        int(hashlib.md5(f"{i}|7|{b}".encode()).hexdigest()[4 * r : 4 * r + 4], 16) >= s
        for s in ST.poisson_limits()
    )
    few = dataclasses.replace(ST.f1("macro"), replicates=10)
    items = {"f": (few, F.struct(F.col("g").alias("gold"), F.col("p").alias("pred")))}
    got = {r["k"]: r["f_stderr"] for r in ST.bootstrap(df, ["k"], items, ["id"], 20, 7).collect()}
    mid = {r["k"]: r["stderr"] for r in ST.bootstrap_median(df, ["k"], "v", ["id"], 20, 7).collect()}
    for key in "ab":
        scores, middles = [], []
        for n in range(20):
            held = [r for r in rows if r[1] == key for _ in range(draw(r[0], n // 8, n % 8))]
            middles.append(statistics.median(r[2] for r in held))
            labels = {x for r in held for x in r[3:]}
            f = [
                2 * sum(r[3] == r[4] == x for r in held) / sum((r[3] == x) + (r[4] == x) for r in held)
                for x in labels
            ]
            scores.append(sum(f) / len(f))
        assert got[key] == pytest.approx(statistics.stdev(scores[:10]))
        assert mid[key] == pytest.approx(statistics.stdev(middles))


def test_poisson_weights(spark):
    rows = spark.range(3000).select("id", F.lit(0).alias("b"))
    w = [x for r in rows.select(ST.replicate_weights(["id"], 1, "b").alias("w")).collect() for x in r["w"]]
    assert statistics.mean(w) == pytest.approx(1, abs=0.03)
    assert statistics.variance(w) == pytest.approx(1, abs=0.05)


def test_statistics_of_empty_and_null_groups(spark):
    df = spark.createDataFrame([(None, None, 1), (None, 2.0, 1), ("a", None, None)], "k string, v double, g int")
    labels = F.struct(F.col("g").alias("gold"), F.col("g").alias("pred"))
    items = {"m": (ST.mean, F.col("v")), "f": (ST.f1(), labels), "c": (ST.mcc, labels)}
    got = {r["k"]: (r["m"], r["f"], r["c"]) for r in ST.aggregate(df, ["k"], items).collect()}
    assert got == {None: (2.0, 1.0, 0.0), "a": (None, 0.0, 0.0)}
    assert ST.aggregate(df.limit(0), ["k"], items).count() == 0


@pytest.mark.parametrize("average", ["macro", "micro", "weighted"])
def test_label_statistics_equal_the_table_form(spark, average):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), rng.randrange(4), rng.randrange(4)) for _ in range(120)]
    df = spark.createDataFrame(rows, "k string, g int, p int")
    items = {
        "f": (ST.f1(average), F.struct(F.col("g").alias("gold"), F.col("p").alias("pred"))),
        "c": (ST.mcc, F.struct(F.col("p").alias("gold"), F.col("g").alias("pred"))),
    }
    got = {r["k"]: (r["f"], r["c"]) for r in ST.aggregate(df, ["k"], items).collect()}
    f = {r["k"]: r["f1"] for r in A.f1(df, "g", "p", average, keys=["k"]).collect()}
    c = {r["k"]: r["mcc"] for r in A.mcc(df, "p", "g", keys=["k"]).collect()}
    assert got == {k: (pytest.approx(f[k]), pytest.approx(c[k])) for k in "xy"}


def test_aggregate_metrics_by_name(spark):
    rows = [("t", "acc", 1.0), ("t", "acc", 0.0), ("t", "mid", 1.0), ("t", "mid", 5.0), ("t", "mid", 9.0)]
    rows += [("t", "ppl", -1.0), ("t", "off", 3.0)]
    df = spark.createDataFrame(rows, "task string, metric string, value double")
    how = {"mid": "median", "ppl": "perplexity", "off": "bypass"}
    got = {r["metric"]: (r["value"], r["stderr"]) for r in A.aggregate_metrics(df, ["task", "metric"], how).collect()}
    assert got["acc"] == (0.5, pytest.approx(0.5)) and got["mid"] == (5.0, None)
    assert got["ppl"] == (pytest.approx(math.e), None) and got["off"] == (-1.0, None)


def test_mean_stderr_needs_two_rows(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    assert df.agg(A.mean_stderr(F.col("v")).alias("s")).first()["s"] is None


def test_accuracy_counts_ungraded(spark):
    df = spark.createDataFrame([("t", "Yes"), ("t", None), ("t", "No"), ("u", "Yes")], "task string, g string")
    rows = {r["task"]: (r["total"], r["graded"], r["correct"], r["accuracy"]) for r in A.accuracy_by_task(df, "task", "g").collect()}
    assert rows == {"t": (3, 2, 1, 0.3333), "u": (1, 1, 1, 1.0), None: (4, 3, 2, 0.5)}


def test_f1_and_mcc_values(spark):
    gold = [1, 1, 1, 0, 0, 0, 0, 1]
    pred = [1, 0, 1, 0, 0, 1, 0, 1]
    df = spark.createDataFrame(list(zip(gold, pred)), "g int, p int")
    assert A.f1(df, "g", "p").first()["f1"] == pytest.approx(0.75)
    assert A.mcc(df, "g", "p").first()["mcc"] == pytest.approx(0.5)
    assert A.f1(df, "g", "p", "micro").first()["f1"] == pytest.approx(0.75)
    assert A.mcc(df.where("g = 1"), "g", "p").first()["mcc"] == 0.0


def test_direction_null_on_disagreement(spark):
    df = spark.createDataFrame([("g", True), ("g", False), ("h", True)], "g string, up boolean")
    assert {r["g"]: r["higher_is_better"] for r in A.direction(df, ["g"], "up").collect()} == {"g": None, "h": True}


def test_rollup_error_missing_is_contagious(spark):
    metrics = spark.createDataFrame(
        [("a", "acc", "none", 0.5, 0.1, 10), ("b", "acc", "none", 0.7, None, 30)],
        "task string, metric string, filter string, value double, stderr double, samples int",
    )
    edges = spark.createDataFrame([("g", "a"), ("g", "b"), ("top", "g")], "group string, child string")
    config = spark.createDataFrame([("g", "acc", "none", True), ("top", "acc", "none", False)], "group string, metric string, filter string, weight_by_size boolean")
    rows = {r["group"]: r for r in A.group_rollup(metrics, edges, config).collect()}
    assert rows["g"]["value"] == pytest.approx(0.65) and rows["top"]["value"] == pytest.approx(0.6)
    assert rows["g"]["stderr"] is None and rows["g"]["samples"] == 40


BOXES = [
    (r"a \boxed{1} b \boxed{\frac{1}{2}} c", r"\frac{1}{2}"),
    (r"\fbox{x}", "x"),
    (r"\boxed 5 $ and", "5 "),
    (r"\boxed{open", None),
    ("none", None),
]


@pytest.mark.parametrize("text,want", BOXES)
def test_last_boxed(spark, text, want):
    assert one(spark, X.last_boxed(F.col("t")), t=text) == want


CHAIN = [
    ("The final answer is $12$. I hope it is correct.", "12"),
    (r"\boxed{3} then \boxed{1/2}", r"\frac{1}{2}"),
    ("so the answer is: 7.", "7"),
    ("x\n```output\n41\n```\n", "41"),
    ("got 1,234 of them", "1234"),
    ("nothing", ""),
]


@pytest.mark.parametrize("text,want", CHAIN)
def test_extract_answer_chain(spark, text, want):
    assert one(spark, X.extract_answer(F.col("t")), t=text) == want


MATH = [
    ("competition", r"\dfrac{1}{2}", r"\frac{1}{2}"),
    ("competition", "0.5", r"\frac{1}{2}"),
    ("competition", r"x = 5\text{ cm}", "5"),
    ("competition", "3/4", r"\frac{3}{4}"),
    ("competition", r"\sqrt3 + \frac12", r"\sqrt{3}+\frac{1}{2}"),
    ("competition", r"50\%", "50"),
    ("quantitative", "x = 1,000 dollars", "1000"),
    ("quantitative", r"\text{yes}", "yes"),
    ("grader", "5 degrees", "5"),
    ("grader", "3.0", "3"),
    ("grader", "1 1/2", "1+1/2"),
    ("grader", "1,234", "1234"),
    ("extraction", "2.00", "2"),
    ("extraction", r"5 \text{cm}", "5"),
    ("extraction", "infinity", r"\infty"),
    ("extraction", ".5", "0.5"),
]


@pytest.mark.parametrize("rules,text,want", MATH)
def test_normalize_math(spark, rules, text, want):
    assert one(spark, normalize_math(F.col("t"), rules), t=text) == want


MATCHES = [
    ("1/2", "0.5", True), (r"thus \boxed{3}.", "3.0", True), ("1,000", "1000", True),
    ("x", "", False), ("3", "4", False), ("1/0", "5", False), ("ABC.", "abc", True),
]


@pytest.mark.parametrize("a,b,want", MATCHES)
def test_answers_match(spark, a, b, want):
    assert one(spark, X.answers_match(F.col("a"), F.col("b")), a=a, b=b) is want


TUPLES = [
    ("(1, 2)", "(1,2)", True), ("[1,2)", "(1,2)", False), ("1,000", "1000", True),
    (r"\text{Blue}", "blue", True), ("2", "3", False), ("(1/2,3/4)", "( 1/2 , 3/4 )", True),
]


@pytest.mark.parametrize("a,b,want", TUPLES)
def test_grade_tuple(spark, a, b, want):
    assert one(spark, X.grade_tuple(F.col("a"), F.col("b")), a=a, b=b) is want


NUMBERS = [
    ("twenty-one cats", "21"), ("two hundred and three", "203"), ("one million, two hundred thousand", "1200000"),
    ("thirteen", "13"), ("a hundred", "100"), ("no number", None),
]


@pytest.mark.parametrize("text,want", NUMBERS)
def test_number_words(spark, text, want):
    assert one(spark, X.number_words(F.col("t")), t=text) == want


def test_choice_ties_and_out_of_range(spark):
    df = spark.createDataFrame(
        [(1, [0.5, 0.5, 0.1], 0), (2, [0.1, 0.2, 0.3], 7), (3, [float("nan"), 0.1, 0.0], 1)],
        "id int, l array<double>, gold int",
    )
    scores = S.choice_scores(F.col("l"), F.array(*[F.lit(c) for c in "abc"]), F.col("gold"))
    rows = {r["id"]: (r["acc"], r["gold_error"]) for r in df.select("id", scores["acc"].alias("acc"), scores["gold_error"].alias("gold_error")).collect()}
    assert rows == {1: (1.0, False), 2: (0.0, True), 3: (1.0, False)}


def test_edit_distance_and_common_length():
    def slow(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        c = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                same = a[i - 1] == b[j - 1]
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (not same))
                c[i][j] = c[i - 1][j - 1] + 1 if same else max(c[i - 1][j], c[i][j - 1])
        return d[-1][-1], c[-1][-1]

    rng = random.Random(2)
    for _ in range(60):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        b = [rng.choice("abc") for _ in range(rng.randint(0, 9))]
        assert (TS.edit_distance(a, b), TS.common_length(a, b)) == slow(a, b)


def test_best_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for _ in range(40):
        gain = rng.random((rng.integers(1, 6), rng.integers(1, 6))).round(2)
        total = sum(gain[i, j] for i, j in TS.best_assignment(gain))
        wide = gain if gain.shape[0] <= gain.shape[1] else gain.T
        best = max(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))
        assert total == pytest.approx(best)


def test_span_scores_need_agreeing_numbers():
    assert TS.span_scores(["the 3 cats"], ["3.0 cats"]) == (1.0, 1.0)
    assert TS.span_scores(["4 cats"], ["3 cats"]) == (0.0, 0.0)
    assert TS.span_scores(["red", "blue"], ["blue", "red", "green"])[1] == 0.67


def test_bleu_and_chrf_of_equal_texts(spark):
    df = spark.createDataFrame([(1, "a cat sat on the mat .", "a cat sat on the mat ."), (2, "x y", "completely different words")], "id int, p string, r string")
    bleu = {r["id"]: r["bleu"] for r in TS.sample_bleu(df, ["id"], "p", "r").collect()}
    assert bleu[1] == pytest.approx(100.0) and bleu[2] == 0.0
    assert TS.chrf(df.where("id = 1"), ["id"], "p", "r").first()["chrf"] == pytest.approx(100.0)


RULES = [
    ("number_sentences", {"relation": "at least", "n": 3}, "One. Mr. Two is 3.5 tall! Three?", True),
    ("number_sentences", {"relation": "less than", "n": 3}, "One. Mr. Two is 3.5 tall! Three?", False),
    ("number_bullets", {"n": 2}, "* one\n- two\n**no**", True),
    ("number_highlights", {"n": 2}, "*a* and *b* but not **", True),
    ("number_sections", {"splitter": "Part", "n": 2}, "Part 1\nx\nPart 2\ny", True),
    ("number_paragraphs", {"n": 2}, "a\n***\nb", True),
    ("number_paragraphs", {"n": 2}, "a\n***\n\n***\nb", False),
    ("postscript", {"marker": "P.S."}, "Text\nP. S. more", True),
    ("postscript", {"marker": "P.P.S"}, "Text only", False),
    ("forbidden_words", {"words": ["cat"]}, "The Cat sat", False),
    ("forbidden_words", {"words": ["cat"]}, "category", True),
    ("json", {}, "```json\n{\"a\": [1, 2]}\n```", True),
    ("json", {}, "{a", False),
    ("paragraph_first_word", {"paragraphs": 2, "nth": 2, "word": "then"}, "First.\n\n'Then', x", True),
    ("key_sentences", {"wanted": ["It is."], "n": 1}, "It is. So.", True),
    ("end_phrase", {"phrase": "The end"}, "bla the END\n", True),
    ("title", {}, "<<A title>>\ntext", True),
    ("title", {}, "<<>>", False),
    ("upper_case", {}, "ALL 1", True),
    ("lower_case", {}, "all A", False),
    ("capital_words", {"relation": "at least", "n": 2}, "NASA and ESA", True),
    ("quoted", {}, ' "x" ', True),
    ("two_responses", {}, "a\n******\nb", True),
    ("two_responses", {}, "a\n******\na", False),
    ("repeat_prompt", {"prompt": "Say HI"}, " say hi now", True),
    ("constrained_response", {}, "My answer is yes.", True),
    ("constrained_start", {"starter": "My view"}, "x\n My view is", True),
    ("rephrased_marks", {"original": "keep *this* text"}, "keep *that one* text", True),
    ("rephrased_paragraph", {"original": "a b b c", "low": 2, "high": 2}, "b and b", True),
]


@pytest.mark.parametrize("name,args,text,want", RULES)
def test_check_rules(spark, name, args, text, want):
    assert one(spark, C.CHECKS[name](F.col("t"), **args), t=text) is want


def test_follow_loose_accepts_wrapped_answers(spark):
    text = "Sure, here it is:\nplain text without that sign\nBye, now"
    flags = lambda loose: one(spark, C.follow(F.col("t"), [("no_commas", {})], loose), t=text)
    assert flags(False) == [False] and flags(True) == [True]
    assert one(spark, C.follow(F.col("t"), [("no_commas", {})]), t="  ") == [False]


def test_verdicts(spark):
    for text, strict, lenient in [
        ("ok\nYes", "Yes", "Yes"), ("No\nbecause", None, "No"), ("I think yes", None, "Yes"),
        ("maybe", None, None), ("Yes\nNo.", None, "No"),
    ]:
        assert one(spark, X.parse_verdict(F.col("t")), t=text) == strict
        assert one(spark, X.parse_verdict(F.col("t"), False), t=text) == lenient


def test_compare_runs_p_value(spark):
    a = spark.createDataFrame([("t", 0.60, 0.02)], "task string, value double, stderr double")
    b = spark.createDataFrame([("t", 0.55, 0.02)], "task string, value double, stderr double")
    from assayline.operators.joins import compare_runs

    row = compare_runs(a, b).first()
    z = 0.05 / math.sqrt(0.0008)
    assert row["z"] == pytest.approx(z)
    assert row["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


def test_moves_in_edit_rate():
    said = "c d a b e".split()
    assert TS.shifted_edits(said, "a b c d e".split()) == 1
    assert TS.shifted_edits("a x b".split(), "a b".split()) == 1
    assert TS.shifted_edits([], "a b".split()) == 2
    assert TS.shifted_edits("a b".split(), "a b".split()) == 0
    assert TS.shifted_edits("e a b c d".split(), "a b c d f e".split()) == 2  # a move and an insert


def test_edit_path_is_cheapest():
    rng = random.Random(5)
    for _ in range(200):
        x, y = (np.array([rng.randrange(4) for _ in range(rng.randrange(9))], int) for _ in "xy")
        fit_x, fit_y, place = TS.edit_path(x, y)
        assert fit_x.sum() == fit_y.sum()
        at = place[fit_y]
        assert (np.diff(at) > 0).all() and (x[at] == y[fit_y]).all() if len(at) else True
        assert TS.shifted_edits(list(x), list(y)) <= TS.edit_distance(list(x), list(y))


def test_summary_hits():
    # union of two predicted sentences with one reference sentence: 4 of 5 words
    ref = [["w1", "w2", "w3", "w4", "w5"]]
    pred = [["w1", "w2", "w6", "w7", "w8"], ["w1", "w3", "w8", "w9", "w5"]]
    assert TS.summary_hits(pred, ref) == 4
    assert TS.summary_hits([], ref) == 0 and TS.summary_hits(pred, []) == 0
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([f"w{rng.randrange(5)}" for _ in range(rng.randrange(1, 20))] for _ in "ab")
        assert TS.summary_hits([a], [b]) == TS.common_length(a, b)


def test_several_references(spark):
    rows = [(1, "the the cat", ["the cat", "the the dog sat"]), (2, "a b", []), (3, None, None)]
    df = spark.createDataFrame(rows, "id long, p string, r array<string>")
    sums = {r["id"]: r for r in TS.bleu_sums(df, ["id"], "p", "r").collect()}
    assert (sums[1]["match_1"], sums[1]["pred_1"], sums[1]["ref_1"]) == (3, 3, 2)
    assert (sums[1]["match_2"], sums[2]["match_1"], sums[3]["pred_1"]) == (2, 0, 0)
    rate = {r["id"]: r["ter"] for r in TS.ter(df, "p", "r", ["id"]).collect()}
    assert rate == {1: pytest.approx(100 / 3), 2: None, 3: None}


def plain_table(x, y):
    table = [list(range(len(y) + 1))]
    for i, a in enumerate(x, 1):
        row = [i]
        for j, b in enumerate(y, 1):
            row.append(min(table[-1][j] + 1, row[-1] + 1, table[-1][j - 1] + (a != b)))
        table.append(row)
    return table


def plain_shifted(x, y):
    """Edits and moves by whole tables: every move tried, the best by gain, words, place."""
    cost, moves = plain_table(x, y)[-1][-1], 0
    while cost > 1:
        fit_x, fit_y, place = TS.edit_path(x, y)
        best, after = (0,), x
        for i in range(len(x)):
            for j in range(max(0, i - TS.SHIFT_REACH), min(len(y), i + TS.SHIFT_REACH + 1)):
                for n in range(1, TS.SHIFT_WORDS + 1):
                    if x[i : i + n] != y[j : j + n] or i + n > len(x) or j + n > len(y):
                        break
                    to = int(place[j])
                    if fit_x[i : i + n].all() or fit_y[j : j + n].all() or i <= to < i + n:
                        continue
                    rest = x[:i] + x[i + n :]
                    at = to if to < i else to - n
                    moved = rest[:at] + x[i : i + n] + rest[at:]
                    rank = (cost - plain_table(moved, y)[-1][-1], n, -i, -j)
                    if rank[0] > 0 and rank > best:
                        best, after = rank, moved
        if best[0] == 0:
            break
        cost, x, moves = cost - best[0], after, moves + 1
    return cost + moves


def test_edit_bits_against_tables():
    rng = random.Random(11)
    for _ in range(400):
        k = rng.randint(1, 7)
        x, y = ([rng.randrange(k) for _ in range(rng.randrange(15))] for _ in "xy")
        table = plain_table(x, y)
        assert TS.edit_distance(x, y) == table[-1][-1]
        assert TS.shifted_edits(x, y) == plain_shifted(x, y), (x, y)
    words = [str(i) for i in range(90)]
    mixed = words[40:60] + words[:40] + words[65:] + words[60:65]
    assert TS.shifted_edits(mixed, words) == plain_shifted(mixed, words)


def test_long_texts_are_compared_in_time():
    rng = random.Random(12)
    words = [str(rng.randrange(3000)) for _ in range(20_000)]
    fewer = [w for w in words if rng.random() > 0.1]
    start = time.time()
    assert TS.edit_distance(fewer, words) == len(words) - len(fewer)
    assert TS.common_length(fewer, words) == len(fewer)
    shuffled = [str(i) for i in range(300)]
    rng.shuffle(shuffled)
    assert 250 < TS.shifted_edits(shuffled, [str(i) for i in range(300)]) < 300
    assert time.time() - start < 20


def plain_summary_hits(pred, ref):
    """Whole table and walk back, one pair of sentences after the other."""
    left, hits = Counter(w for s in pred for w in s), 0
    for x in ref:
        places = set()
        for y in pred:
            n = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i, j in itertools.product(range(len(x)), range(len(y))):
                n[i + 1][j + 1] = n[i][j] + 1 if x[i] == y[j] else max(n[i][j + 1], n[i + 1][j])
            i, j = len(x), len(y)
            while i and j:
                if x[i - 1] == y[j - 1]:
                    places.add(i - 1)
                    i, j = i - 1, j - 1
                elif n[i][j - 1] > n[i - 1][j]:
                    j -= 1
                else:
                    i -= 1
        for i in sorted(places):
            if left[x[i]]:
                left[x[i]] -= 1
                hits += 1
    return hits


def test_summary_rouge_l_of_all_turns(spark):
    """Every turn, its lines in reverse order as prediction, against the plain version."""
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", F.col("text").alias("r"), F.array_join(F.reverse(F.split("text", "\n")), "\n").alias("p")
    )
    got = {(r["conv_id"], r["turn"]): r["rougeL"] for r in TS.rouge_l_sum(rows, ["conv_id", "turn"], "p", "r").collect()}
    split = lambda t: [w for w in (re.sub("[^a-z0-9]+", " ", s.lower()).split() for s in t.replace(" . ", ".\n").split("\n")) if w]
    for row in rows.collect():
        p, r = split(row["p"]), split(row["r"])
        size = sum(map(len, p)) + sum(map(len, r))
        want = 2 * plain_summary_hits(p, r) / size if size else 0.0
        assert abs(got.pop((row["conv_id"], row["turn"])) - want) < 1e-12
    assert not got


def test_counts_of_a_batch_equal_counts_of_its_rows(monkeypatch):
    rng = random.Random(4)
    for limit in (1, 30, 1 << 19):
        monkeypatch.setattr(TS, "SLICE_TOKENS", limit)
        rows = [[None, *[[f"w{rng.randrange(5)}" for _ in range(rng.randrange(30))] for _ in range(9)]] for _ in "ab"]
        sides = [pa.array(side, pa.list_(pa.string())) for side in rows]
        found = TS.shared_counts(*TS.coded(sides), (1, 2, 4)).T.tolist()
        plain = []
        for sides in zip(*rows):
            each = [[TS.gram_counter(side or [], k) for side in sides] for k in (1, 2, 4)]
            plain.append([n for p, r in each for n in ((p & r).total(), p.total(), r.total())])
        assert found == plain
    texts = [["aé漢😀aé", "", None], ["é漢aé", "a", "b"]]
    found = TS.shared_counts(*TS.coded([pa.array(t, pa.string()) for t in texts]), (1, 2)).T.tolist()
    assert found == [[4, 6, 4, 2, 5, 3], [0, 0, 1, 0, 0, 0], [0, 0, 1, 0, 0, 0]]


def test_common_places_of_long_sentences():
    x = [f"w{i % 997}" for i in range(4000)]
    places = TS.common_places(x, x[1:])
    assert len(places) == 3999 and TS.common_places(x, ["none"] * 4000) == set()


def test_span_scores_run_on_all_cores(spark):
    from __spark_entry__ import queries

    df = queries()["g8_span_f1"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
