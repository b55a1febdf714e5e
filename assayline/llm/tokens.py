"""Token counts: batches balanced by bytes, long texts split where no token can span.

A token of the byte-level tokenizers never reaches from a character that is not white
space into a following run of white space, so a text may be cut in front of every such
run. The cuts make pieces of one word and the white space ahead of it; equal pieces of a
batch are encoded once, and only their lengths leave the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of every common definition, so safe whatever the tokenizer takes for space.
PIECES = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: Characters on whose nature definitions of white space differ, or that may join a run.
ODD_SPACE = re.compile(
    "[\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]"
)
BATCH_BYTES = 1 << 20
CACHE_PIECES = 300_000
CACHED_CHARS = 48


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(path: str) -> Callable[[list[str]], list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


class PieceCounter:
    """Counts tokens of texts by their pieces, with a bounded memory of piece lengths."""

    def __init__(self, path: str):
        self.encode = _encoder(path)
        self.splits = path.endswith(".json")
        self.known: dict[str, int] = {}

    def _learn(self, pieces: set[str]) -> dict[str, int]:
        """Lengths of new pieces, encoded in batches of about ``BATCH_BYTES``."""
        new, batch, held = {}, [], 0
        for piece in pieces:
            batch.append(piece)
            held += len(piece)
            if held >= BATCH_BYTES:
                new.update(zip(batch, self.encode(batch)))
                batch, held = [], 0
        if batch:
            new.update(zip(batch, self.encode(batch)))
        return new

    def _count_block(self, texts: list[str]) -> list[int]:
        split = [
            PIECES.findall(t) if self.splits and not ODD_SPACE.search(t) else [t] for t in texts
        ]
        lengths = self._learn(set().union(*split) - self.known.keys()) if split else {}
        known = self.known
        out = []
        for pieces in split:
            try:
                out.append(sum([known[p] for p in pieces]))
            except KeyError:
                out.append(sum([known[p] if p in known else lengths[p] for p in pieces]))
        if len(known) + len(lengths) > CACHE_PIECES:
            known.clear()
        known.update((k, v) for k, v in lengths.items() if len(k) <= CACHED_CHARS)
        if len(known) > CACHE_PIECES:
            known.clear()
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Token numbers, block by block of about equal bytes."""
        out, block, held = [], [], 0
        for text in texts:
            block.append(text)
            held += len(text)
            if held >= 2 * BATCH_BYTES:
                out += self._count_block(block)
                block, held = [], 0
        return out + self._count_block(block)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text column as the library for the file gives it.

    No begin, end or added special tokens; special strings inside a text as the library
    handles them by default; no truncation or padding. Null and empty text: 0. Files of
    ``tokenizers`` with a byte-level split are cut into pieces; a text that holds a
    character on which definitions of white space differ, and every text for
    ``sentencepiece``, is encoded whole.
    """
    file = path or default_tokenizer()

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PieceCounter(file)
        for batch in batches:
            texts = batch.to_pylist()
            yield pa.array(counter.count([t or "" for t in texts]), pa.int64())

    return count(text)


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    path: str | None = None,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; nothing is shuffled.

    Null text counts as empty: 0 bytes, 0 tokens. Ids pass through as they are, null and
    repeated ones too. No rows: no rows.
    """
    text = F.col(f"row.`{text_col}`")
    rows = docs.select(F.struct(id_col, text_col).alias("row")).select(
        F.col(f"row.`{id_col}`").alias(id_col),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(text, path).alias("n_tokens"),
    )
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
