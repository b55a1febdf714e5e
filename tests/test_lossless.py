"""Null keys, null orders, sparse ids and any k give whole and equal results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayline.operators import aggregate as A
from assayline.operators import joins, scale, sets
from assayline.operators import selection as S
from assayline.operators import statistics as ST
from assayline.sources import readers
from assayline.streaming import intake

ROWS = [("a", 5), (None, 3), ("a", 1), (None, 9), ("b", 7), (None, 4)]


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.createDataFrame(ROWS, "k string, i long")


def places(rows):
    return {(r["k"], r["i"]): r["pos"] for r in rows.collect()}


WANT = {("a", 1): 1, ("a", 5): 2, (None, 3): 1, (None, 4): 2, (None, 9): 3, ("b", 7): 1}


def test_numbered_keeps_null_keys(keyed):
    assert places(scale.numbered(keyed, ["k"], "i")) == WANT


def test_sparse_ids_are_range_partitioned(keyed, monkeypatch):
    monkeypatch.setattr(scale, "CHUNK_ROWS", 2)
    wide = keyed.withColumn("i", F.col("i") * 1_000_000)
    got = places(scale.numbered(wide, ["k"], "i"))
    assert got == {(k, i * 1_000_000): p for (k, i), p in WANT.items()}


def test_null_order_values_come_first(spark):
    rows = spark.createDataFrame([("a", None), ("a", 2), ("b", None)], "k string, i long")
    assert places(scale.numbered(rows, ["k"], "i")) == {("a", None): 1, ("a", 2): 2, ("b", None): 1}


@pytest.mark.parametrize("k", [1, 2, 999, 1000, 1001])
def test_first_k_is_one_rule(keyed, k):
    got = places(scale.first_k(keyed, ["k"], [F.col("i")], k))
    assert got == {key: p for key, p in WANT.items() if p <= k}


def test_hash_ranked_keeps_null_keys(keyed):
    for digits in (None, 1, 4):
        got = places(scale.hash_ranked(keyed, ["k"], ["i"], 1, digits=digits))
        assert len(got) == 6 and got == places(scale.hash_ranked(keyed, ["k"], ["i"], 1))


def test_head_rows_and_limit(keyed, monkeypatch):
    assert sets.head_rows(keyed, ["k"], "i", 2).count() == 5
    few = {r["i"] for r in S.limit_docs(keyed, 2, "i").collect()}
    drawn = {r["i"] for r in S.limit_docs(keyed, 0.5, "i", ["i"]).collect()}
    monkeypatch.setattr(S, "TOP_ROWS", 0)
    assert few == {r["i"] for r in S.limit_docs(keyed, 2, "i").collect()} == {1, 3}
    assert drawn == {r["i"] for r in S.limit_docs(keyed, 0.5, "i", ["i"]).collect()}


def test_median_of_null_group(keyed):
    got = {r["k"]: r["median"] for r in A.median(keyed, ["k"], "i").collect()}
    assert got == {"a": 3.0, "b": 7.0, None: 4.0}


@pytest.mark.parametrize("chunk", [1, 2, 3])
def test_task_hash_is_a_tree(spark, chunk):
    import hashlib

    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    hashes = [f"h{n}" for n in range(4)]
    level = hashes
    for _ in range(2):
        level = [sha(level[i : i + chunk]) for i in range(0, len(level), chunk)]
    rows = [("t", n + 1, h) for n, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "task string, pos long, h string")
    got = A.task_hash(df, ["task"], "pos", "h", chunk=chunk).first()["task_hash"]
    assert got == sha(level)


def test_bootstrap_does_not_see_the_partitioning(spark):
    df = spark.range(200).select("id", (F.col("id") % 17).cast("double").alias("v"))
    items = {"v": (ST.mean, F.col("v"))}
    runs = [
        ST.bootstrap(df.repartition(n), [], items, ["id"], iters=200).first()["v_stderr"]
        for n in (1, 3, 7)
    ]
    assert max(runs) - min(runs) < 1e-9


def test_leaf_tasks_merge_paths_and_stop_on_cycles(spark):
    edges = [("g", "x"), ("g", "y"), ("x", "z"), ("y", "z"), ("z", "t")]
    rows = joins.leaf_tasks(spark.createDataFrame(edges, "group string, child string")).collect()
    assert sorted(tuple(r) for r in rows) == [(g, "t") for g in "gxyz"]
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "group string, child string")
    with pytest.raises(ValueError):
        joins.leaf_tasks(ring)
    assert joins.leaf_tasks(ring.limit(0)).isEmpty()


def test_leaf_tasks_of_a_long_chain_in_few_rounds(spark, monkeypatch):
    stored = []
    store = joins.materialize
    monkeypatch.setattr(joins, "materialize", lambda df, name: (stored.append(name), store(df, name))[1])
    chain = [(f"g{i}", f"g{i + 1}") for i in range(999)] + [("g999", "end"), ("g10", "side")]
    got = joins.leaf_tasks(spark.createDataFrame(chain, "group string, child string"))
    assert got.where("task = 'end'").count() == 1000
    assert got.where("task = 'side'").count() == 11 and got.count() == 1011
    assert len(stored) <= 11


def test_new_checkpoint_adds_to_an_old_table(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "k long, v string"
    spark.createDataFrame([(1, "x"), (2, "b"), (2, "a")], schema).coalesce(1).write.parquet(src)
    for mark in ("one", "two", "one"):
        stream = spark.readStream.schema(schema).parquet(src)
        intake.intake(stream, out, ["k"], str(tmp_path / mark), order=["v"]).awaitTermination()
        spark.createDataFrame([(9, "z")], schema).coalesce(1).write.mode("append").parquet(src)
    got = sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "x"), (2, "a"), (9, "z")]


def test_intake_reads_the_parts_it_touches(spark, tmp_path):
    import shutil

    src, out, schema = str(tmp_path / "src"), str(tmp_path / "out"), "k string, v string"
    rows = [(f"k{i}", "old") for i in range(300)] + [(None, "old")]
    spark.createDataFrame(rows, schema).write.parquet(src)
    run = lambda mark: intake.intake(
        spark.readStream.schema(schema).parquet(src), out, ["k"], str(tmp_path / mark), order=["v"]
    ).awaitTermination()
    run("one")
    # keys come from the part of the new row alone
    one = spark.createDataFrame([("k7", "new")], schema)
    part = one.select(*[c.alias(n) for n, c in intake._hashed(["k"]).items()]).first()["part"]
    known = intake.known_keys(spark, out, [part], "none")
    files = {r[0] for r in known.select(F.input_file_name()).distinct().collect()}
    assert files and all(f"/part={part}/" in f for f in files)
    assert known.count() < 30
    assert intake.unseen(one, out, "none", ["k"]).isEmpty()
    # a table without its index, and one whose index broke off, are indexed again
    folder = next((tmp_path / "out" / intake.KEY_FOLDER).glob("batch=*"))
    shutil.rmtree(folder / "part=-1")
    shutil.rmtree(next(folder.glob("part=*")))
    spark.createDataFrame([("k1", "new"), (None, "new"), ("z", "new")], schema).write.mode("append").parquet(src)
    run("two")
    got = spark.read.parquet(out)
    assert got.count() == 302 and got.where("v = 'new'").collect()[0]["k"] == "z"


def test_corpus_is_the_same_packed_or_plain(spark, tmp_path):
    import zstandard

    lines = '{"text": "one", "meta": "m"}\n{"text": ["a", "b"], "meta": {"k": 1}}\n"bare"\n'
    for place, packed in (("plain", [0]), ("packed", [1]), ("both", [0, 1])):
        folder = tmp_path / place
        folder.mkdir()
        if 0 in packed:
            (folder / "p.jsonl").write_text(lines)
        if 1 in packed:
            (folder / "q.jsonl.zst").write_bytes(zstandard.compress(lines.encode()))
        got = sorted((r["text"], r["meta"]) for r in readers.read_corpus(spark, str(folder)).collect())
        want = sorted([("one", "m"), ("a\n\nb", '{"k":1}'), ("bare", "{}")] * len(packed))
        assert got == want


def test_vote_by_answer_class(spark):
    from assayline.functions.answers import answer_class
    from assayline.operators import vote

    said = ["1/2", "7", "\\frac{1}{2}", "7"]
    df = spark.createDataFrame([(1, i, a) for i, a in enumerate(said)], "q long, i long, a string")
    assert vote.weighted_vote(df, ["q"], "i", "a", same=answer_class).first()["a"] == "\\frac{1}{2}"
    assert vote.weighted_vote(df, ["q"], "i", "a").first()["a"] == "7"


def test_left_out_rows_protect_nothing(spark):
    from assayline.operators import ngrams

    a = spark.createDataFrame([(1, "p q r s"), (2, "t u v w")], "id long, text string")
    b = spark.createDataFrame([(3, "x p q r"), (4, "x t u v"), (5, "k l m n")], "id long, text string")
    test = spark.createDataFrame([("l m n",)], "text string")
    kept = ngrams.decontaminate_sources(
        [a, b], test, ["id"], "text", "text", n=3, select=lambda d: d.where("id <> 2")
    )
    assert sorted(r["id"] for r in kept.collect()) == [1, 4]


def test_null_domain_is_a_domain(spark):
    rows = [(i, None if i % 3 == 0 else f"d{i % 3}", (i * 37) % 101) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, domain string, len int")
    weighted = S.length_weights(df, "domain", "len", "id").groupBy("domain")
    sums = {r[0]: (r[1], round(r[2], 9)) for r in weighted.agg({"id": "count", "weight": "sum"}).select("domain", "count(id)", "sum(weight)").collect()}
    assert sums == {None: (20, 1.0), "d1": (20, 1.0), "d2": (20, 1.0)}
    mixed = S.domain_weights(df, df.where("id < 30"), "domain")
    assert {r["domain"]: r["n"] for r in mixed.collect()} == {None: 15, "d1": 15, "d2": 15}
    none = df.where("id < 0").select("id")
    every = S.diversity_sample(df, none, mixed, "id", "domain", "len", total=60, switch=10)
    assert every.count() == 60
