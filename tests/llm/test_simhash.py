"""Fingerprints and classes against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from assayline.llm import simhash
from assayline.llm.common import components

from conftest import SF


def plain_code(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(codes):
    """Smallest key reachable for {key: code}."""
    keys = sorted(codes)
    c = np.array([codes[k] for k in keys], np.uint64)
    a, b = np.nonzero(np.bitwise_count(c[:, None] ^ c[None]) <= 3)
    label = simhash._joined(np.arange(len(c)), a, b)
    return {k: keys[label[i]] for i, k in enumerate(keys)}


def scattered(rng, n, families, flips):
    base = rng.integers(0, 2**63, families, dtype=np.uint64)
    codes = base[rng.integers(0, families, n)]
    for _ in range(flips):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(codes)


@pytest.mark.parametrize("text", ["", "A", "a B", "A b\tC", "x\x1cy z\xa0w q", "É é A\x0bB\x0cC d"])
def test_fingerprint(text, monkeypatch):
    assert simhash.fingerprint_of(text) == plain_code(text)
    long = (text + " tail") * 50
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", 7)
    assert simhash.fingerprint_of(long) == plain_code(long)


@pytest.mark.parametrize("n", [2, 7, 8, 9, 65, 300, 2500])
def test_node_search(n):
    codes = scattered(np.random.default_rng(n), n, max(1, n // 9), 3)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    want = plain_classes(dict(enumerate(codes.tolist())))
    assert simhash.linked_within(codes).tolist() == [want[i] for i in range(len(codes))]


@pytest.mark.parametrize("node_rows", [4096, 20, 3])
def test_links_whatever_the_node_size(spark, node_rows):
    codes = scattered(np.random.default_rng(5), 900, 40, 4).tolist()
    signed = [simhash._signed(c) for c in codes]
    rows = spark.createDataFrame([(c,) for c in signed], "code long")
    roots = {r.node: r.root for r in components(simhash.near_links(rows, node_rows)).collect()}
    want = plain_classes(dict(zip(signed, codes)))
    assert {c: roots.get(c, c) for c in signed} == want


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    codes = {r.doc_id: plain_code(r.text) for r in docs.collect()}
    want = plain_classes(codes)
    got = simhash.classes(docs).select("*", simhash.as_hex("code").alias("hex")).collect()
    assert len(got) == len(codes)
    for r in got:
        assert (r.hex, r.component_id) == (f"{codes[r.doc_id]:016x}", want[r.doc_id])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_cases(spark):
    rows = [
        (3, None, 1), (2, "", 2), (None, " \t", 3), (5, "one two three four", 4),
        (5, "one two three four", 4), (None, "only null ids here", 5),
        (None, "only null ids here", 5), (7, "words " * 30_000, 6), (8, "words " * 30_001, 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.classes(docs).collect()), key=str)
    assert got == sorted(
        [(3, 2), (2, 2), (None, 2), (5, 5), (5, 5), (None, None), (None, None), (7, 7), (8, 7)],
        key=str,
    )
    kept = sorted(((r.doc_id, r.code) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(2, 2), (5, 4), (None, 5), (7, 6)], key=str)
    assert simhash.classes(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_long_chain(spark):
    chain = spark.range(1, 300).selectExpr("id AS a", "id - 1 AS b")
    rows = components(chain).collect()
    assert len(rows) == 300 and {r.root for r in rows} == {0}
