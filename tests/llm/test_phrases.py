"""Collocations against plain counting of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from assayline.llm import phrases

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def pieces(text):
    for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
        yield re.findall(r"[^ \t]+", piece)


def plain(rows, longest=5, least=100, top=2000, percent=100):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            held = counts.setdefault(lang, Counter())
            for n in range(1, longest + 1):
                held.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, held in counts.items():
        found = []
        cands = {p: a for p, a in held.items() if len(p) > 1 and a >= least}
        for p, a in cands.items():
            inside = any(
                len(q) > len(p)
                and 100 * b >= percent * a
                and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in cands.items()
            )
            if not inside:
                score, k = min(
                    (1000 * a * totals[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p))
                )
                found.append((-score, -a, " ".join(p), held[p[:k]], held[p[k:]]))
        found.sort(key=lambda f: (*f[:2], f[2].encode()))
        out += [
            (lang, i + 1, f[2], -f[1], f[3], f[4], totals[lang], -f[0]) for i, f in enumerate(found[:top])
        ]
    return sorted(out)


def corpus(seed, n):
    draw = random.Random(seed)
    words = ["The", "of", "é", "É", "a b", "x", "YZ", "tea", "cup", "of", "tea"]
    marks = [" ", "\t", "  ", " ", " ", " ", ". ", "\n", "\r", ",", "!"]
    texts = [
        "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randint(0, 60))) for _ in range(n)
    ]
    texts += [None, "", " \t ", "tea " * 3000, "of the " * 500, texts[0], texts[0]]
    return [(draw.choice(["en", "de", None, "und"]), t) for t in texts]


@pytest.mark.parametrize("seed,least,top,percent", [(0, 5, 2000, 100), (1, 20, 15, 80), (2, 3, 100, 100)])
def test_collocations(spark, seed, least, top, percent):
    rows = corpus(seed, 120)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, phrase int")
    got = phrases.collocations(docs.repartition(3), least=least, top=top, percent=percent)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, least, top, percent)


def test_shorter_phrases_and_no_rows(spark):
    rows = corpus(5, 60)
    docs = spark.createDataFrame(rows, "lang string, text string")
    for longest in (2, 3):
        got = phrases.collocations(docs, longest=longest, least=4)
        assert sorted(map(tuple, got.collect())) == plain(rows, longest, 4)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs, least=10**9).count() == 0


def test_chunks_hold_every_phrase_once():
    for _, text in corpus(9, 40):
        want, got = Counter(), Counter()
        for words in pieces(text):
            for n in range(1, 6):
                want.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        for own, chunk in phrases.chunks_of((text or "").encode(), 4, 7):
            words = chunk.decode().split(" ")
            assert 0 < own <= 7 and len(words) <= own + 4
            for n in range(1, 6):
                got.update(" ".join(words[i : i + n]) for i in range(min(own, len(words) - n + 1)))
        assert got == want


def test_equal_passages_make_equal_chunks():
    words = [f"w{i}" for i in range(2000)]
    passage = " ".join(words[500:1500])
    one = Counter(c for c in phrases.chunks_of(passage.encode(), 4))
    text = " ".join(words[:77]) + " " + passage + " " + " ".join(words[:9])
    two = Counter(c for c in phrases.chunks_of(text.encode(), 4))
    assert sum((one & two).values()) >= len(one) - 3


def test_bit_table_loses_nothing(spark):
    found = [("en", f"w{i} x{i % 7}") for i in range(3000)]
    held = spark.createDataFrame(found, "lang string, phrase string")
    table = phrases.bit_table(held)
    hits = {}
    for letter in "wy":
        words = [f"{letter}{i} x{i % 7}".encode() for i in range(3000)]
        block = pa.table({"lang": ["en"] * 3000, "words": words, "own": [2] * 3000, "freq": [5] * 3000})
        hits[letter] = sum(b.num_rows for b in phrases.block_counts(block, [2], table, 2))
    assert hits["w"] == 3000 and hits["y"] < 30


def test_large_counts(spark):
    a = 9 * 10**14
    grams = spark.createDataFrame(
        [("en", "x", 1, a), ("en", "y", 1, a + 1), ("en", "x y", 2, a - 7)],
        "lang string, phrase string, n int, a long",
    )
    totals = spark.createDataFrame([("en", 10**15)], "lang string, total long")
    got = phrases.scored(grams, totals).first()
    assert got.score == 1000 * (a - 7) * 10**15 // (a * (a + 1))
