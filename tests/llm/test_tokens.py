"""Piecewise token counts against the library on whole texts."""

from __future__ import annotations

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayline.llm import tokens

from conftest import SF

HARD = [
    "",
    " ",
    "a  b\n\n c\t\td \n",
    "it's 'tis  don't\r\n\r\nx",
    "x<|endoftext|> y <|endoftext|>\n<|endoftext|>",
    "no break 　wide\x1cfile\x85next",
    "﻿mark ​zero",
    "é́ 漢字 テスト 😀😀  ﷽",
    "a" * 30_000 + " " * 5_000 + "b 1" * 4_000,
    "\n" * 999 + "!?" * 500,
]


@pytest.fixture(scope="module")
def plain():
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


def test_hard_texts(plain):
    counter = tokens.PieceCounter(tokens.default_tokenizer())
    assert counter.count(HARD) == [plain(t) for t in HARD]
    assert counter.count(HARD) == [plain(t) for t in HARD]


def test_documents(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in tokens.count_tokens(docs).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), plain(text))
        assert r.over_limit == (r.n_tokens > 512)


def test_cases(spark):
    rows = [(1, None, "x"), (None, "two words", "y"), (1, "", "z"), (1, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = [tuple(r) for r in tokens.count_tokens(docs).collect()]
    want = [(1, 0, 0, False), (None, 9, 2, False), (1, 0, 0, False), (1, 0, 0, False)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_small_memory(plain, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 10)
    counter = tokens.PieceCounter(tokens.default_tokenizer())
    assert counter.count(HARD) == [plain(t) for t in HARD]
