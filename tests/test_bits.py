"""Bit table, the joins that use it, and the fold by rounds against plain versions."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from assayline.operators import bits, leaders
from assayline.operators import ngrams as N


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def tiny(monkeypatch):
    """Several slices and passes, and no broadcast of whole sets."""
    monkeypatch.setattr(bits, "SLICE_BITS", 2)
    monkeypatch.setattr(bits, "SLICE_WORDS", 4)
    monkeypatch.setattr(bits, "PASS_SLICES", 3)


@pytest.mark.parametrize("rows", [0, 1, 500])
def test_bit_table_loses_no_key(spark, tiny, rows):
    keys = spark.range(rows).select(F.xxhash64("id").alias("h"))
    table = bits.bit_table(keys, "h", rows)
    assert table.slices.count() == table.count
    probe = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    probe = probe.unionAll(probe.limit(1).select("id", F.lit(None).cast("long")))
    out = table.survivors(probe, F.col("h"))
    got = [r["id"] for r in out.collect()]
    assert len(got) == len(set(got)) and set(range(rows)) <= set(got)
    # the tiny table is limited to twelve slices; the empty one lets nothing through
    assert len(got) < 3000 and (rows or not got)
    assert not re.search(r"(?<!Broadcast)Exchange", plan_of(out))


def test_bit_table_is_exact_enough_at_its_size(spark):
    keys = spark.range(50_000).select(F.xxhash64("id").alias("h"))
    table = bits.bit_table(keys, "h", 50_000)
    other = spark.range(1_000_000, 1_200_000).select(F.xxhash64("id").alias("h"))
    assert table.survivors(other, F.col("h")).count() < 2_000


def texts(seed, rows, size=9):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, size))) for _ in range(rows)]


def grams_of(text, n):
    words = (text or "").split()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_large_sets_find_the_same(spark, tiny):
    train = list(enumerate(texts(1, 200))) + [(900, None), (901, "")]
    test = texts(2, 40)
    protected = set().union(*[grams_of(t, 3) for t in test])
    want = {i for i, t in train if grams_of(t, 3) & protected}
    rows = spark.createDataFrame(train, "id long, text string")
    bench = spark.createDataFrame([(t,) for t in test], "text string")
    for limit in (0, 1_000_000):
        out = N.contaminated(rows, bench, ["id"], "text", "text", n=3, max_rows=limit)
        assert sorted(r["id"] for r in out.collect()) == sorted(want)
    index = N.ngram_rows(rows, ["id"], "text", 3)
    wanted = N.ngram_rows(bench, [], "text", 3)
    have = set().union(*[grams_of(t, 3) for _, t in train])
    for limit in (0, 1_000_000):
        out = N.matching_grams(index, wanted, max_rows=limit)
        assert sorted(r["ngram"] for r in out.collect()) == sorted(have & protected)


def test_index_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c a b"), (2, "a b"), (2, "a b c"), (None, "x y"), (None, "x y z"), (3, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted((r["ngram"], r["id"] or 0) for r in N.ngram_index(df, "id", "text", 2).collect())
    want = sorted({(g, i or 0) for i, t in rows for g in grams_of(t, 2)})
    assert got == want
    alone = N.ngram_index(df.where("id = 1"), "id", "text", 2)
    assert "Exchange" not in plan_of(alone)


def plain_fold(sources, test, n):
    known = set().union(*[grams_of(t, n) for t in test]) if test else set()
    kept = []
    for rank, source in enumerate(sources):
        clean = [(i, t) for i, t in source if not grams_of(t, n) & known]
        for i, t in clean:
            kept.append((rank, i))
        for _, t in clean:
            known |= grams_of(t, n)
    return sorted(kept)


@pytest.mark.parametrize("count,rows,limit", [(3, 40, None), (12, 8, None), (4, 30, 0)])
def test_fold_by_rounds(spark, monkeypatch, count, rows, limit):
    if limit is not None:
        # every side beyond its bound: bit tables and shuffles everywhere
        monkeypatch.setattr(N, "small", lambda *a, **k: False)
        for module in (N, leaders):
            monkeypatch.setattr(module, "broadcast_if_small", lambda df, *a: df)
    sources = [list(enumerate(texts(10 * count + s, rows, size=7))) for s in range(count)]
    sources[1] = sources[1] + [(rows + i, t) for i, t in sources[0][:3]]
    test = texts(99, 3)
    frames = [spark.createDataFrame(s, "id long, text string") for s in sources]
    bench = spark.createDataFrame([(t,) for t in test], "text string")
    kept = N.decontaminate_sources(frames, bench, ["id"], "text", "text", n=3)
    assert sorted((r["source_rank"], r["id"]) for r in kept.collect()) == plain_fold(sources, test, 3)


def test_fold_counts_rounds_by_chains_not_sources(spark, monkeypatch):
    """Thirty sources, of which every third meets the one before: two rounds settle them."""
    rounds = []
    store = leaders.materialize
    monkeypatch.setattr(leaders, "materialize", lambda df, name, *a: (rounds.append(name), store(df, name, *a))[1])
    frames = []
    for s in range(30):
        said = f"w{s // 3} x{s // 3} y{s // 3} z{s}"
        frames.append(spark.createDataFrame([(s, said), (None, f"n{s} m{s} o{s}")], "id long, text string"))
    bench = spark.createDataFrame([("n4 m4 o4",)], "text string")
    kept = N.decontaminate_sources(frames, bench, ["id"], "text", "text", n=3)
    got = sorted((r["source_rank"], r["id"]) for r in kept.where("id IS NOT NULL").collect())
    assert got == [(s, s) for s in range(0, 30, 3)]
    assert kept.where("id IS NULL").count() == 29
    assert rounds.count("judged") <= 2


def test_fold_of_nothing(spark):
    none = spark.createDataFrame([], "id long, text string")
    bench = spark.createDataFrame([], "text string")
    assert N.decontaminate_sources([none, none], bench, ["id"], "text", "text").count() == 0
