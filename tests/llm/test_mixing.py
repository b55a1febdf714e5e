"""Targets against a loop that reshares, positions against the schedule."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import mixing
from assayline.llm.common import materialize
from assayline.llm.queries import QUERIES
from conftest import SF


def reshared(sizes, weights=(1, 2, 3), top=3):
    """Share by weight; cut what is above the top and share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= top * sizes[s]:
                left += target[s] - top * sizes[s]
                target[s] = float(top * sizes[s])
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["b", "a", None, "é", "B", "zz"][: 3 + seed]
    rows = [
        (i, " w\t" * int(rng.integers(0, 40)), names[int(rng.integers(0, 1 + rng.integers(0, len(names))))], 0)
        for i in range(300)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    mixed = mixing.curriculum(docs)
    got = mixed.collect()
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = reshared(sizes)
    assert len(got) == 300
    taken: dict = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.size == len(rows[r.doc_id][1].split())
        assert len(r.positions) == (-(-r.taken // r.size) if r.size else 0)
        assert all(0 <= p <= 1 for p in r.positions) and r.positions == sorted(r.positions)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1
    again = sorted(map(tuple, mixing.curriculum(docs.repartition(7)).select("doc_id", "taken").collect()))
    assert again == sorted((r.doc_id, r.taken) for r in got)
    ordered = [r.position for r in mixing.training_order(mixed).collect()]
    assert ordered == sorted(ordered) and len(ordered) == sum(len(r.positions) for r in got)
    words = mixing.training_order(mixed).agg(F.sum("taken_here")).first()[0]
    assert (words or 0) == sum(r.taken for r in got)


def test_the_query_comes_in_training_order(spark):
    """The query's rows follow the first positions, and are of the placed passes."""
    mixed = mixing.curriculum(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    first = {r.doc_id: r.positions[0] if r.positions else 2.0 for r in mixed}
    got = QUERIES["op10_mixing"](spark, SF)
    rows = got.collect()
    assert [r.doc_id for r in rows] == sorted(first, key=lambda i: (first[i], i))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "positions" in plan and "aggregate(places" in plan
    passes = {r.doc_id: 0 for r in rows}
    for r in mixing.training_order(mixing.curriculum(spark.read.parquet(f"{SF}/documents.parquet"))).collect():
        passes[r.doc_id] += r.taken_here
    assert passes == {r.doc_id: r.taken for r in rows}


def test_positions_follow_the_schedule(spark):
    shape = (2.0, 1.0, 0.0)
    shares = np.linspace(0, 1, 21)
    rows = spark.createDataFrame([(float(x),) for x in shares], "x double")
    got = np.array([r.t for r in rows.select(mixing._time_of(F.col("x"), shape).alias("t")).collect()])
    grid = np.linspace(0, 1, 20_001)
    met = np.concatenate(([0], np.cumsum(np.interp(grid[:-1] + 0.5 / 20_000, (0, 0.5, 1), shape)))) / 20_000
    # a rate of zero at the end leaves the last time open
    assert np.abs(np.interp(got, grid, met / met[-1]) - shares).max() < 1e-3


def test_parts_do_not_matter(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 3 == 0]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one = sorted(map(str, mixing.curriculum(docs).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for parts in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert sorted(map(str, mixing.curriculum(docs).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_that_share_an_id_are_spread(spark):
    """400 rows with a null id, 300 of them alike: spans meet end to end and the mix is whole."""
    rows = [(None, "a b c", "x")] * 300 + [(None, "w " * (i % 7), "x") for i in range(100)]
    rows += [(i, "d e", "y") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = materialize(
        docs.select(
            F.col("doc_id").alias("id"), "source", mixing.word_count(F.col("text")).alias("size"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order"), F.xxhash64("text").alias("tie"),
        ),
        "sizes",
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = mixing._offsets(sizes).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = {"x": [], "y": []}
    for r in placed:
        spans[r["source"]].append((r["before"], r["before"] + r["size"]))
    for source, found in spans.items():
        found = sorted(f for f in found if f[0] < f[1])
        assert found[0][0] == 0 and all(a[1] == b[0] for a, b in zip(found, found[1:]))
        assert found[-1][1] == sum(len(t.split()) for _, t, s in rows if s == source)
    got = mixing.curriculum(docs).collect()
    assert len(got) == 500
    for source in "xy":
        mine = [r for r in got if r.source == source]
        assert 0 <= mine[0].target - sum(r.taken for r in mine) < 1


def test_cases(spark):
    rows = [(1, None, "a"), (None, "x y", "a"), (2, "x", None), (2, "x", None), (3, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.curriculum(docs).collect()
    assert len(got) == 5 and {r.taken for r in got if r.size == 0} == {0}
    assert {r.source_size for r in got if r.source is None} == {2}
    assert mixing.curriculum(docs.limit(0)).count() == 0
    empty = mixing.curriculum(docs.where("text IS NULL")).first()
    assert (empty.target, empty.taken, empty.positions) == (0.0, 0, [])
