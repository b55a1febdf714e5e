"""Hot keys: chunked helpers against brute force, with one key holding most rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assayline.operators import scale
from assayline.operators import selection as S
from assayline.operators import vote as V
from assayline.operators.scale import first_k, hash_ranked, numbered, ranked, running


def skewed(n=600, seed=1):
    """Rows (key, idx, value): key a holds more than half of them."""
    rng = random.Random(seed)
    order = list(range(0, 3 * n, 3))
    rng.shuffle(order)
    return [
        (rng.choice("aaaaabcd"), i, rng.choice([0.0, 0.25, 0.5, 1.0]), rng.choice("xyz")) for i in order
    ]


@pytest.fixture(scope="module")
def rows():
    return skewed()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, idx long, w double, ans string")


@pytest.mark.parametrize("chunk", [1, 7, 100, 1 << 20])
def test_running_sums_do_not_depend_on_chunks(df, rows, chunk):
    from assayline.operators.scale import chunk_of

    got = running(df, ["k"], "idx", {"s": F.col("w")}, [chunk_of("idx", chunk)], [F.col("idx")])
    want, sums = {}, defaultdict(float)
    for k, i, w, _ in sorted(rows, key=lambda r: r[1]):
        sums[k] += w
        want[i] = sums[k]
    assert {r["idx"]: r["s"] for r in got.collect()} == want


def test_numbered(df, rows):
    seen, want = Counter(), {}
    for k, i, *_ in sorted(rows, key=lambda r: r[1]):
        seen[k] += 1
        want[i] = seen[k]
    assert {r["idx"]: r["pos"] for r in numbered(df, ["k"], "idx").collect()} == want


def test_ranked_by_value_then_index(df, rows):
    got = ranked(df, ["k"], [F.col("w").desc(), F.col("idx")])
    want, seen = {}, Counter()
    for k, i, *_ in sorted(rows, key=lambda r: (-r[2], r[1])):
        seen[k] += 1
        want[i] = seen[k]
    assert {r["idx"]: r["pos"] for r in got.collect()} == want


@pytest.mark.parametrize("k", [1, 5, 2000])
def test_first_k(df, rows, k):
    got = first_k(df, ["k"], [F.col("w"), F.col("idx")], k)
    seen, want = Counter(), {}
    for key, i, *_ in sorted(rows, key=lambda r: (r[2], r[1])):
        seen[key] += 1
        if seen[key] <= k:
            want[i] = seen[key]
    assert {r["idx"]: r["pos"] for r in got.collect()} == want


@pytest.mark.parametrize("accuracy", [4, 50, 100_000])
def test_median_of_hot_groups_and_values(spark, accuracy):
    import statistics

    from assayline.operators.aggregate import median

    rng = random.Random(4)
    rows = [("a", float(rng.choice([1, 1, 1, rng.random()]))) for _ in range(301)]
    rows += [("b", rng.random()) for _ in range(100)] + [("c", 2.0), ("d", 1.0), ("d", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median"] for r in median(df, ["k"], "v", accuracy).collect()}
    for key in "abcd":
        assert got[key] == pytest.approx(statistics.median([v for k, v in rows if k == key]))


def test_hash_rank_is_a_permutation_and_repeats(df, rows):
    first = {r["idx"]: r["pos"] for r in hash_ranked(df, [], ["idx"], 5).collect()}
    again = {r["idx"]: r["pos"] for r in hash_ranked(df.repartition(3), [], ["idx"], 5, digits=1).collect()}
    assert first == again
    assert sorted(first.values()) == list(range(1, len(rows) + 1))


def reference_vote(cands, weighted=True):
    """Winner by the rule as stated: openings lead while the best is zero, repeats
    lead when their running weight exceeds the best."""
    best, leader, totals = 0, None, {}
    for answer, weight in cands:
        weight = weight if weighted else 1
        if answer in totals:
            totals[answer] += weight
            if totals[answer] > best:
                best, leader = totals[answer], answer
        else:
            totals[answer] = weight
            if best == 0:
                best, leader = weight, answer
    return leader


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("weighted", [True, False])
def test_weighted_vote_matches_rule(spark, seed, weighted):
    rows = skewed(300, seed)
    df = spark.createDataFrame(rows, "k string, idx long, w double, ans string")
    got = V.weighted_vote(df, ["k"], "idx", "ans", F.col("w") if weighted else None)
    groups = defaultdict(list)
    for k, i, w, a in sorted(rows, key=lambda r: r[1]):
        groups[k].append((a, w))
    want = {k: reference_vote(v, weighted) for k, v in groups.items()}
    assert {r["k"]: r["ans"] for r in got.collect()} == want


VOTES = [
    ([("a", 1), ("b", 1), ("b", 1), ("a", 1)], "b"),
    ([("a", 0.2), ("b", 0.9)], "a"),
    ([("a", 0.2), ("b", 0.9), ("b", 0.1)], "b"),
    ([("a", 0), ("b", 0.5)], "b"),
    ([("a", 0), ("b", 0)], "b"),
]


@pytest.mark.parametrize("cands,winner", VOTES)
def test_vote_cases(spark, cands, winner):
    rows = [(1, i, a, float(w)) for i, (a, w) in enumerate(cands)]
    df = spark.createDataFrame(rows, "q int, i long, a string, w double")
    assert V.weighted_vote(df, ["q"], "i", "a", F.col("w")).first()["a"] == winner
    assert reference_vote(cands) == winner


def test_majority_tie_goes_to_first_seen(spark):
    rows = [(1, 5, "b"), (1, 2, "a"), (1, 7, "a"), (1, 9, "b"), (1, 1, "c")]
    df = spark.createDataFrame(rows, "q int, i long, a string")
    assert V.majority_vote(df, ["q"], "i", "a").first()["a"] == "a"


def test_take_first_k_checks_size(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "q int, i long")
    with pytest.raises(ValueError):
        V.take_first_k(df, ["q"], "i", 2)
    assert V.take_first_k(df, ["q"], "i", 2, check=False).count() == 3


def test_dedup_keeps_first_of_many_copies_and_nulls(spark):
    rows = [("x" if i % 2 else f"t{i}", i % 3, i) for i in range(300)]
    rows += [(None, 0, 1000), (None, 0, 999)]
    df = spark.createDataFrame(rows, "t string, rank int, idx long").repartition(5)
    got = {(r["t"], r["rank"], r["idx"]) for r in S.dedup_first(df, "t", ["rank", "idx"]).collect()}
    first = {}
    for t, rank, idx in sorted(rows, key=lambda r: (r[1], r[2])):
        first.setdefault(t, (t, rank, idx))
    assert got == set(first.values())


def test_diversity_sample_size_and_content(spark):
    rows = [(i, f"d{i % 7}", (i * 37) % 101) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, domain string, len int")
    chosen = df.where("id < 40").select("id")
    weights = spark.createDataFrame([("d0", 0.5), ("d1", 0.5)], "domain string, weight double")
    out = S.diversity_sample(df, chosen, weights, "id", "domain", "len", total=120, switch=80)
    ids = {r["id"] for r in out.collect()}
    assert len(ids) == 120 and set(range(40)) <= ids and ids <= set(range(400))
    again = S.diversity_sample(
        df.repartition(3), chosen, weights, "id", "domain", "len", total=120, switch=80
    )
    assert {r["id"] for r in again.collect()} == ids
    everything = S.diversity_sample(df, chosen, weights, "id", "domain", "len", total=900)
    assert everything.count() == 400


def test_draw_order_prefers_long_rows():
    import pandas as pd

    pool = pd.DataFrame(
        {"id": range(60), "domain": "d", "chosen": False, "length_rank": range(60), "_n": 60}
    )
    firsts = Counter(S.draw_order(pool, seed, 60)["id"].iloc[0] for seed in range(2000))
    assert abs(firsts[0] / 2000 - 0.5) < 0.05 and abs(firsts[1] / 2000 - 0.25) < 0.05
    assert sorted(S.draw_order(pool, 3, 60)["id"]) == list(range(60))


def test_random_fewshot_draws_k_others(spark):
    pool = spark.createDataFrame([(i, f"q{i}", f"a{i}") for i in range(30)], "id long, q string, a string")
    pairs = S.fewshot_pairs(pool, pool, 5, "id", "id").collect()
    per = defaultdict(set)
    for r in pairs:
        per[r["id"]].add(r["example"]["id"])
    assert len(per) == 30
    assert all(len(v) == 5 and k not in v for k, v in per.items())
    counts = Counter(x for v in per.values() for x in v)
    assert max(counts.values()) < 20
    small = S.fewshot_pairs(pool, pool.where("id < 3"), 5, "id", "id")
    assert small.where("id = 1").count() == 2


def test_quota_sample_matches_sequential_rule(spark):
    import hashlib
    import math

    rng = random.Random(3)
    rows = [(i, rng.choice(["A", "A", "A", "B", "C"]), rng.choice(["p", "q", "r"])) for i in range(200)]
    rows = [(i, t, topic if t == "A" else None) for i, t, topic in rows]
    df = spark.createDataFrame(rows, "id long, task string, topic string")
    got = Counter(r["id"] for r in S.quota_sample(df, 50, "task", "topic", "A", ["id"]).collect())
    left = {t: math.ceil(50 / 3) for t in "ABC"}
    topics = {t: math.ceil(left["A"] / 3) for t in "pqr"}
    want = Counter()
    for i, task, topic in sorted(rows, key=lambda r: hashlib.sha256(f"{r[0]}|42".encode()).hexdigest()):
        if topic and topics[topic] > 0:
            want[i] += 1
            topics[topic] -= 1
            left["A"] -= 1
        if left[task] > 0:
            want[i] += 1
            left[task] -= 1
        if sum(want.values()) == 50:
            break
    assert got == want


def test_allocate_matches_loop(spark):
    from math import ceil, exp

    from assayline.operators.trees import allocate

    rng = random.Random(5)
    rows = [(q, i, round(rng.random(), 3)) for q in range(3) for i in range([4, 40, 9][q])]
    df = spark.createDataFrame(rows, "q int, id long, score double")
    for ratio in (None, 0.5):
        got = {
            (r["q"], r["id"]): r["expand"]
            for r in allocate(df, ["q"], "id", "score", 10, 0.3, ratio).collect()
        }
        want = {}
        for q in range(3):
            nodes = sorted([r for r in rows if r[0] == q], key=lambda r: (-r[2], -r[1]))
            nodes = nodes[: ceil(len(nodes) * ratio)] if ratio else nodes
            width, total = 10, sum(exp(r[2] / 0.3) for r in nodes)
            for _, i, s in nodes:
                n = min(width, ceil(width * exp(s / 0.3) / total - 1e-9)) if width else 0
                want[(q, i)] = n
                width, total = width - n, total - exp(s / 0.3)
        assert got == want


def test_a_side_is_computed_once(spark, tmp_path):
    """What is more than a scan is stored before it is counted and joined."""
    path = str(tmp_path / "t")
    spark.range(100).write.parquet(path)
    stored = spark.read.parquet(path)
    assert scale.is_scan(stored.where("id > 3").selectExpr("id * 2 AS x"))
    grouped = stored.groupBy("id").count()
    assert not scale.is_scan(grouped) and not scale.is_scan(stored.join(grouped, "id"))
    side = scale.broadcast_if_small(grouped)
    assert path not in " ".join(side.inputFiles()) and side.count() == 100
    assert scale.small(stored, 100) and not scale.small(stored, 99) and not scale.small(stored, 100, 10)


@pytest.mark.parametrize("k", [1, 40, 900])
def test_nearest_holds_the_first_k(spark, k):
    hot = spark.range(60_000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("k"), (F.xxhash64("id") % 100_000).alias("v"), "id"
    )
    few = spark.range(50).select(F.lit("few").alias("k"), F.lit(7).cast("long").alias("v"), "id")
    ties = spark.range(5_000).select(F.lit("ties").alias("k"), (F.col("id") % 2).alias("v"), "id")
    df = hot.unionAll(few).unionAll(ties)
    near = scale.nearest(df, ["k"], F.col("v"), k)
    assert near.columns == df.columns
    rows = {r["k"]: r["count"] for r in near.groupBy("k").count().collect()}
    # about k rows of the hot and of the null key; no row of a small one is lost
    for key in ("hot", None):
        assert k <= rows[key] <= max(4 * k, 60)
    assert rows["few"] == 50 or k == 1
    assert rows["ties"] in (2_500, 5_000)
    plain = scale.first_k(df, ["k"], [F.col("v"), F.col("id")], k)
    cut = scale.first_k(near, ["k"], [F.col("v"), F.col("id")], k)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_first_k_beyond_the_limit_with_a_lead(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("k"), F.xxhash64("id").alias("v"), "id")
    order = [F.col("v"), F.col("id")]
    got = scale.first_k(df, ["k"], order, 1_200, lead=F.col("v"))
    want = scale.first_k(df, ["k"], order, 1_200)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    none = scale.first_k(df.limit(0), ["k"], order, 1_200, lead=F.col("v"))
    assert none.isEmpty()
    whole = scale.nearest(df, [], F.col("v"), 100)
    assert 100 <= whole.count() <= 400


def test_hash_ranked_with_a_limit(spark):
    df = spark.range(9_000).select((F.col("id") % 2).alias("k"), "id")
    want = scale.hash_ranked(df, ["k"], ["id"], 7).where("pos <= 30")
    got = scale.hash_ranked(df, ["k"], ["id"], 7, limit=30)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
