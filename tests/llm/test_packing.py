"""Packing against the library on whole texts, a one-by-one best fit and the round trip."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayline.llm import packing
from assayline.llm.queries import QUERIES
from conftest import SF
from test_tokens import HARD


@pytest.fixture(scope="module")
def plain():
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: [*model.encode(t or "", add_special_tokens=False).ids, 2]


def one_by_one(counts, capacity):
    """Residual tokens of all sequences after packing every piece on its own."""
    limits = capacity.limits()
    weights = np.array(capacity.weights) / limits.astype(float) ** 2
    rests = []
    for length in sorted(counts, reverse=True):
        piece = np.array([length, 1, length * length])
        for _ in range(counts[length]):
            able = [i for i, r in enumerate(rests) if (r >= piece).all()]
            if able:
                best = min(able, key=lambda i: (((rests[i] - piece) ** 2 * weights).sum(), i))
                rests[best] = rests[best] - piece
            else:
                rests.append(limits - piece)
    return rests


@pytest.mark.parametrize("seed", range(8))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    caps = packing.Capacity(60, *[(None, None), (5, None), (None, 1800), (4, 2000)][seed % 4])
    top = 42 if seed % 4 > 1 else 60
    counts = {int(n): int(rng.integers(1, 9)) for n in rng.integers(1, top + 1, 30)}
    plan = packing.best_fit(counts, caps)
    want = one_by_one(counts, caps)
    held = {}
    for length, n in counts.items():
        seq, off = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist()):
            held.setdefault(s, []).append((o, length))
    assert sorted(held) == list(range(plan.sequences)) and plan.sequences == len(want)
    for rows in held.values():
        rows.sort()
        assert [o for o, _ in rows] == np.cumsum([0, *[n for _, n in rows]])[:-1].tolist()
        assert len(rows) <= caps.limits()[1]
        assert sum(n * n for _, n in rows) <= caps.limits()[2]
    got = sorted(sum(n for _, n in rows) for rows in held.values())
    assert got == sorted(int(caps.tokens - r[0]) for r in want)


def test_piece_above_a_capacity():
    with pytest.raises(ValueError):
        packing.best_fit({50: 1}, packing.Capacity(60, None, 100))


def test_documents(spark, plain):
    got = {}
    rows = QUERIES["op11_best_fit_packing"](spark, SF).collect()
    for r in rows:
        got.setdefault(r.doc_id, {})[r.piece] = r
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids, at = plain(text), 0
        for k in range(len(got[doc_id])):
            r = got[doc_id][k]
            assert r.start == at and (r.length == 1024 or k == 0)
            raw = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
            at += r.length
        assert at == len(ids) and len(got[doc_id]) == -(-at // 1024)
    full = {}
    for r in rows:
        full.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in full.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *[n for _, n in places]])[:-1].tolist()
        assert sum(n for _, n in places) <= 1024
    total = sum(r.length for r in rows)
    assert len(full) <= 1.03 * total / 1024 + 1


def test_round_trip_and_cases(spark, plain):
    rows = [(i % 3 or None, t, "x") for i, t in enumerate([*HARD, None, "same", "same", "a " * 9000])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, piece string").repartition(3)
    packed = packing.pack_documents(docs, keep_ids=True, capacity=packing.Capacity(100, 20))
    pieces = packed.collect()
    held = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in pieces:
        s = held[r.sequence_id]
        assert s.ids[r.offset : r.offset + r.length] == r.ids and r.offset + r.length in s.ends
        assert len(s.ids) <= 100 and len(s.ends) <= 20
    assert sum(len(s.ids) for s in held.values()) == sum(r.length for r in pieces)
    want = sorted((i or 0, len(plain(t)), sum(plain(t))) for i, t, _ in rows)
    docs_of = {}
    for i, t, _ in rows:
        docs_of.setdefault(i, []).append(plain(t))
    for i, wanted in docs_of.items():
        own = [r for r in pieces if r.id == i]
        assert sum(r.length for r in own) == sum(map(len, wanted))
        assert sorted(x for r in own for x in r.ids) == sorted(x for w in wanted for x in w)
    assert len(want) == len(rows)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_encoder(plain):
    encode = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*HARD, "x" + " " * 300 + "y", "œuvre – “ça” … ¿qué?", "a<|endoftext|>b"]
    assert [[*ids, 2] for ids in encode(texts)] == [plain(t) for t in texts]
