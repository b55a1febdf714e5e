"""Automaton against a plain window search."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import decontaminate as D
from assayline.llm.queries import OP6_SQL


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(window, len(v))
        for s in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[s : s + n]:
                    hit.update(range(i, i + n))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


def random_texts(seed, n, longest, letters="abc"):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(list(letters), rng.integers(0, longest))) for _ in range(n)]


@pytest.mark.parametrize("group_bytes, at_once", [(1 << 20, 2), (40, 99), (40, 3)])
def test_random_texts(spark, group_bytes, at_once):
    items = list(enumerate(random_texts(1, 25, 16)))
    texts = random_texts(2, 60, 60) + [None, "", "é A-b 1,a"]
    texts += texts[:5] * 3
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, found string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.scan_documents(docs, bench, window=5, group_bytes=group_bytes, groups_at_once=at_once)
    got = rows.select("row.text", *[c.alias(k) for k, c in D.contamination(F.col("found")).items()], "found.items")
    for r in got.collect():
        n, hit, names = brute(r.text, items, 5)
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, hit, names)
        assert r.contaminated == (hit > 0) and r.n_items == len(names)


@pytest.mark.parametrize("group_bytes", [1 << 20, 20])
def test_items_without_id_count_as_the_check_sql_counts(spark, group_bytes):
    items = [(None, "five six seven"), (None, "eight nine"), (3, "six seven ten"), (4, None)]
    texts = ["x five six seven ten y", "five six seven eight nine", "six seven", None, "six seven ten"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = D.scan_documents(docs, bench, group_bytes=group_bytes)
    facts = D.contamination(F.col("found"))
    got = rows.select("row.doc_id", *[c.alias(k) for k, c in facts.items()]).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(map(tuple, got)) == sorted(con.sql(OP6_SQL).fetchall())
    assert {r.doc_id: r.n_hit for r in got} == {0: 4, 1: 5, 2: 0, 3: 0, 4: 3}


def test_groups_are_bounded_and_sent_part_by_part(spark):
    """Copies of an item count once, groups stay near their size, a part holds only its items."""
    texts = random_texts(3, 300, 12) + ["a b c a b c"] * 200
    items = [(i if i < 300 else 7, t) for i, t in enumerate(texts)] + [(None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, parts = D.grouped_items(bench, "item_id", "text", 400)
    kept = {(str(i), t) for i, t in items if t}
    assert {(r["name"], r["text"]) for r in rows.collect()} == kept and rows.count() == len(kept)
    assert parts == -(-sum(len(t) for _, t in kept) // 400) > 3
    sent = [group for at in range(0, parts, 2) for group in D.sent_groups(rows, range(at, at + 2))]
    assert {item for _, group in sent for item in group.value} == kept
    assert max(sum(len(t) for _, t in group.value) for _, group in sent) < 3 * 400
    assert D.sent_groups(rows.limit(0), range(2)) == []


def test_automata_are_built_once_and_let_go():
    class Sent:
        def __init__(self, value):
            self.value = value

    one, two = ("k1", Sent([("1", "a b c")])), ("k2", Sent([("2", "c d")]))
    first = D.automata_of([one], 10)
    assert D.automata_of([one, two], 10)[0] is first[0]
    assert D.automata_of([one], 3)[0] is not first[0]  # another window
    D.automata_of([two], 10)
    assert list(D._BUILT) == ["k2:10"]


def test_very_long_text_and_long_run_of_item_words(spark):
    """A run of 200,000 item words, and one item at the end of a text of 400,000 others."""
    run = " ".join(["a", "b"] * 100_000)
    long = "z " * 400_000 + "a b a b a"
    docs = spark.createDataFrame([(0, run), (1, long), (2, "z a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "a b a b a")], "item_id long, text string")
    rows = D.scan_documents(docs, bench)
    got = {r.doc: [tuple(h) for h in r.hits] for r in rows.select(F.col("row.doc_id").alias("doc"), "found.hits").collect()}
    assert got == {0: [(0, 199_999)], 1: [(400_000, 400_005)], 2: []}


def test_strip_spans(spark):
    bench = spark.createDataFrame([(1, "one two three four"), (2, None), (None, "five six")], "item_id long, text string")
    texts = ["Zero, ONE two; three four! End.", "five six", None, "one two three", "one two three four"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.strip_spans(docs, bench, max_coverage=0.9).collect()}
    assert got == {0: "Zero, ! End.", 1: "five six", 2: None, 3: "one two three"}
    longer = {r.doc_id: r.text for r in D.strip_spans(docs, bench, min_words=5).collect()}
    assert longer == dict(enumerate(texts))
    assert D.scan_documents(docs.limit(0), bench).count() == 0
    none = D.scan_documents(docs, bench.limit(0)).select(F.size("found.hits").alias("n"))
    assert {r.n for r in none.collect()} == {0}
