"""Readers, writers and incremental intake on files of their own."""

from __future__ import annotations

import json

import pytest
import zstandard

from assayline.operators import sets
from assayline.sources import readers, writers
from assayline.streaming import intake


def test_read_qa_forms(spark, tmp_path):
    rows = [{"q": "a", "a": 1}, {"q": "b"}, {"a": "x"}]
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")
    (tmp_path / "list.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "data.json").write_text(json.dumps({"data": rows}))
    (tmp_path / "rows.json").write_text(json.dumps({"rows": rows}))
    for name in ("l.jsonl", "list.json", "data.json", "rows.json"):
        got = readers.read_qa(spark, str(tmp_path / name), "q", "a").collect()
        assert [tuple(r) for r in got] == [("a", "1"), ("b", ""), ("", "x")], name


def test_read_subject_csv(spark, tmp_path):
    (tmp_path / "algebra_test.csv").write_text('"what, ""x""?",1,A\n')
    (tmp_path / "art_test.csv").write_text("who,2,B\n")
    got = readers.read_subject_csv(spark, str(tmp_path), ["q", "o", "a"]).orderBy("subject").collect()
    assert [tuple(r) for r in got] == [("algebra", 'what, "x"?', "1", "A"), ("art", "who", "2", "B")]


@pytest.mark.parametrize("packed", [True, False])
def test_read_corpus(spark, tmp_path, packed):
    lines = ["plain", {"text": "one", "meta": {"s": 1}}, {"text": ["p", "q"]}]
    body = "\n".join(json.dumps(x) for x in lines).encode()
    name = tmp_path / ("part.jsonl.zst" if packed else "part.jsonl")
    name.write_bytes(zstandard.compress(body) if packed else body)
    got = readers.read_corpus(spark, str(name)).collect()
    assert [r["text"] for r in got] == ["plain", "one", "p\n\nq"]
    assert json.loads(got[1]["meta"]) == {"s": 1} and got[0]["meta"] == "{}"
    assert {r["file"] for r in got} == {name.name}


def test_read_corpus_frames_and_long_lines(spark, tmp_path):
    """All frames of a file are read, a line may run over frames, and no line is too long."""
    texts = [f"text {i} é" for i in range(500)] + ["x" * 20_000_000, "last"]
    body = "\n".join(json.dumps({"text": t, "meta": {"b": 1, "a": None}}) for t in texts).encode()
    cut = len(body) // 3
    frames = [zstandard.compress(part) for part in (body[:cut], body[cut : 2 * cut], body[2 * cut :])]
    (tmp_path / "many.jsonl.zst").write_bytes(b"".join(frames))
    (tmp_path / "plain.jsonl").write_text('"alone"\n\n{"meta": "m"}\n')
    (tmp_path / "empty.jsonl.zst").write_bytes(zstandard.compress(b""))
    rows = readers.read_corpus(spark, str(tmp_path))
    got = sorted((r["text"] or "", r["meta"], r["file"]) for r in rows.collect())
    want = [(t, '{"a":null,"b":1}', "many.jsonl.zst") for t in texts]
    assert got == sorted([*want, ("alone", "{}", "plain.jsonl"), ("", "m", "plain.jsonl")])
    assert "Python" not in rows._jdf.queryExecution().toString()


def test_keyed_and_combined_json(spark, tmp_path):
    for key in ("abc", "def"):
        (tmp_path / f"{key}.json").write_text(json.dumps({"grade": key.upper()}, indent=2))
    got = readers.read_keyed_json(spark, str(tmp_path), "grade string").orderBy("key").collect()
    assert [tuple(r) for r in got] == [("ABC", "abc"), ("DEF", "def")]
    assert readers.combine_json(spark, str(tmp_path), "grade string").count() == 2


def test_merge_shards_skips_missing_and_orders(spark, tmp_path):
    for i, rows in enumerate([[("t", 3), ("s", 1)], [("t", 1)]]):
        (tmp_path / f"shard{i}.jsonl").write_text("\n".join(json.dumps({"task": t, "index": k}) for t, k in rows))
    paths = [str(tmp_path / f"shard{i}.jsonl") for i in range(3)]
    got = readers.merge_shards(spark, paths, "task string, index long").collect()
    assert [tuple(r) for r in got] == [("s", 1), ("t", 1), ("t", 3)]


def test_write_results(spark, tmp_path):
    df = spark.createDataFrame([("t", 1), ("t", 2)], "task string, i int")
    writers.write_results(df, df.groupBy("task").count(), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/samples")).count() == 2
    assert spark.read.json(str(tmp_path / "out/summary")).first()["count"] == 2


def test_match_names(spark):
    df = spark.createDataFrame([("arc_easy",), ("arc_hard",), ("boolq",), ("arc_easy",)], "t string")
    got = [r["t"] for r in sets.match_names(df, "t", ["arc_*", "bool?"]).collect()]
    assert got == ["arc_easy", "arc_hard", "boolq"]


def test_intake_takes_each_key_once_over_batches(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int").coalesce(1).write.parquet(src)
    run = lambda: intake.intake(
        spark.readStream.schema("k string, v int").parquet(src), out, ["k"], mark
    ).awaitTermination()
    run()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b"]
    spark.createDataFrame([("b", 4), ("c", 5)], "k string, v int").coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_stream_deduplicated_with_watermark(spark, tmp_path):
    src = str(tmp_path / "s")
    spark.sql(
        "SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:01:00'),"
        " ('b', timestamp'2024-01-01 00:02:00') t(k, ts)"
    ).write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp").parquet(src)
    query = (
        intake.deduplicated(stream, ["k"], "ts", "1 hour")
        .writeStream.format("memory").queryName("dedup").outputMode("append").start()
    )
    query.processAllAvailable()
    query.stop()
    assert sorted(r["k"] for r in spark.sql("SELECT k FROM dedup").collect()) == ["a", "b"]


def test_places_of_rows(spark, tmp_path):
    from assayline.sources import readers

    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    spark.range(0, 40, 1, 5).selectExpr("id AS v").write.parquet(one)
    spark.range(100, 103, 1, 1).selectExpr("id AS v").write.parquet(two)
    rows = readers.read_ordered(spark, [one, two])
    places = sorted((r["source_rank"], r["row_idx"], r["v"]) for r in rows.collect())
    assert places == [(0, i, i) for i in range(40)] + [(1, i, 100 + i) for i in range(3)]
    again = readers.read_ordered(spark, [one, two]).repartition(7)
    assert sorted((r["source_rank"], r["row_idx"], r["v"]) for r in again.collect()) == places
