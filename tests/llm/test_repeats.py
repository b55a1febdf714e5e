"""Repeated strings against brute force, and the merge of transforms against sorting."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.llm import anchors, repeats
from assayline.llm.anchors import REACH
from conftest import SF


def brute(rows):
    """{(id, text): (n_bytes, n_removed, n_spans, sha)} for rows with ids."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, np.int8)
        for s in range(len(raw) - REACH + 1):
            w = raw[s : s + REACH]
            if w in seen:
                gone[s : s + REACH] = 1
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = int((np.diff(np.concatenate(([0], gone))) == 1).sum())
        out[i, text] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(rows):
    return sorted(
        (r.id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in rows.collect()
    )


def texts(seed, n, size, letters):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), size)) for _ in range(n)]


def hard_rows():
    a, b, c = texts(1, 3, 400, "abcdefghij é\n")
    rows = [a, b + a[50:250] + c, a, a[:99], a[:100], c[::-1] + a[120:300], "x" * 1000, "x" * 350,
            (b[:130] + "ab" * 200) * 3, None, "", c[10:115] + c[20:140], b[7:140], "é" * 130]
    rows += [f"{n}{b[n : n + 90]}{a[200:305]}{c[n * 3 : n * 3 + 60]}" for n in range(30)]
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("heavy", [20_000, 3])
def test_hard_texts(spark, heavy, monkeypatch):
    rows = hard_rows()
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5)
    want = sorted((i, *brute(rows)[i, t]) for i, t in rows)
    assert result(repeats.remove_repeats(docs, heavy_runs=heavy)) == want


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted((i, *facts) for (i, _), facts in brute(rows).items())
    assert result(repeats.remove_repeats(docs)) == want


def test_cases(spark):
    (a,) = texts(4, 1, 300, "abcdef ")
    rows = [(None, a, 1), (4, a, 2), (4, a, 3), (2, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = [(r.id, r.n_removed) for r in repeats.remove_repeats(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 300), (4, 0), (4, 0), (2, 0)], key=str)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_texts_of_one_id_stay_apart(spark):
    """Two texts under a null id whose hashes agree in 25 bits: only one holds a repeat."""
    (a, b) = texts(5, 2, 220, "abcdefghij")
    rows = spark.range(30_000).select(
        F.concat(F.lit(a), F.lit(" "), F.col("id").cast("string")).alias("one"),
        F.concat(F.lit(b[:150]), F.lit(" "), F.col("id").cast("string")).alias("two"),
    )
    mark = lambda c: F.xxhash64(c).bitwiseAND((1 << 25) - 1).alias("mark")
    both = rows.select("one", mark("one")).join(rows.select("two", mark("two")), "mark")
    one, two, _ = min((r.one, r.two, r.mark) for r in both.collect())
    docs = [(1, a), (None, one), (None, two)]
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    facts = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got.collect())
    assert facts == sorted([(len(a), 0, 0), (len(one), len(a), 1), (len(two), 0, 0)])


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_anchors_agree(letters, monkeypatch):
    """Equal windows have equal anchors, also over block ends."""
    monkeypatch.setattr(anchors, "BLOCK", 64)
    one, two = texts(2, 2, 500, letters)
    key = {}
    for raw in ((one + two[:200]).encode(), (two[50:300] + one[100:350]).encode()):
        start, size, anchor, _ = anchors.owned_windows(raw)
        assert size.sum() == len(raw) - REACH + 1
        for s, n, h in zip(start, size, anchor):
            for w in range(s, s + n):
                assert key.setdefault(raw[w : w + REACH], h) == h


def test_merge_equals_sorting(monkeypatch):
    monkeypatch.setattr(repeats, "REACH", 12)
    rng = np.random.default_rng(3)
    segs = ["".join(rng.choice(list("ab"), rng.integers(12, 60))).encode() for _ in range(60)]
    shards = []
    for part in (segs[:5], segs[5:6], segs[6:40], segs[40:]):
        cols = [np.append(np.frombuffer(s, np.uint8).astype(np.int16) + 1, 0) for s in part]
        shards.append(np.concatenate(cols).astype(np.int16))
    block, place = repeats.merged_intervals(shards)
    joined = np.concatenate(shards)
    got: dict = {}
    for b, p in zip(block.tolist(), place.tolist()):
        got.setdefault(b, set()).add(p)
    want: dict = {}
    for p in range(len(joined) - 11):
        w = joined[p : p + 12]
        if (w > 0).all():
            want.setdefault(w.tobytes(), set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
