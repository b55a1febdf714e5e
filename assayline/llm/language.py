"""Language ID with bit-sliced Bloom filters: one word of language bits per filter cell.

Cell ``i`` holds a bit for every language that set it. The AND of a gram's cells gives
all languages that contain the gram at once; the popcounts per language over the grams
of a text, corrected for the share a full filter would give by chance, decide.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import drawn, held_out

SIZES = (2, 3, 4)
CELL_BITS = 20
PROBES = 2
#: Most labelled documents per language that the filters are learned from.
SAMPLE_PER_LANGUAGE = 1000
#: A gram belongs to a language if it is in this share of the sampled documents.
MIN_SHARE = 0.004
BLOCK = 1 << 20


@functools.cache
def _folded() -> np.ndarray:
    """Lower-case letter for each code point, 0 for what is no letter."""
    chars = map(chr, range(0x110000))
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in chars], np.uint32)


def gram_hashes(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the letter n-grams of all words, with word edges, block by block."""
    reach = max(SIZES) - 1
    for at in range(0, len(text), BLOCK):
        # a gram belongs to the block it starts in; the first edge comes before the text
        part = text[max(0, at - 1) : at + BLOCK + reach - 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _folded()[codes].astype(np.uint64)
        if at == 0:
            c = np.concatenate(([np.uint64(0)], c))
        if at + BLOCK + reach - 1 >= len(text):
            c = np.concatenate((c, [np.uint64(0)]))
        starts = min(BLOCK, len(c)) if at + BLOCK < len(text) else len(c)
        letter = c > 0
        h = c
        for n in range(2, max(SIZES) + 1):
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(n)
            if n not in SIZES or len(h) == 0:
                continue
            ok = np.ones(len(h), bool)  # letters inside, edges only at the ends
            for k in range(1, n - 1):
                ok &= letter[k : k + len(h)]
            ends = letter[: len(h)] & letter[n - 1 : n - 1 + len(h)] if n == 2 else letter[1 : 1 + len(h)]
            ok &= ends
            ok[starts:] = False
            g = h[ok]
            yield (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def cells(grams: np.ndarray) -> list[np.ndarray]:
    return [
        (grams >> np.uint64(64 - CELL_BITS * (p + 1)) & np.uint64((1 << CELL_BITS) - 1)).astype(
            np.int64
        )
        for p in range(PROBES)
    ]


class Filters:
    """Languages and the filter words: array of (cells, slices of 64 languages)."""

    def __init__(self, languages: list[str], filled: list[tuple[int, int, int]], common: str | None):
        self.languages, self.common = languages, common
        self.slices = max(1, -(-len(languages) // 64))
        self.at = np.array([f[0] for f in filled], np.int64)
        self.slot = np.array([f[1] for f in filled], np.int64)
        self.word = np.array([f[2] & (2**64 - 1) for f in filled], np.uint64)

    def table(self) -> np.ndarray:
        out = np.zeros((self.slices, 1 << CELL_BITS), np.uint64)
        out[self.slot, self.at] = self.word
        return out

    def false_rates(self, table: np.ndarray) -> np.ndarray:
        """Chance that a gram of no language finds a language: fill to the probes."""
        bits = np.arange(len(self.languages))
        fill = [((table[b // 64] >> np.uint64(b % 64)) & np.uint64(1)).mean() for b in bits]
        return np.array(fill) ** PROBES

    def counts(self, table: np.ndarray, text: str) -> tuple[np.ndarray, int]:
        """Grams of the text found in each language, and all grams."""
        out, total = np.zeros(len(self.languages), np.int64), 0
        for grams in gram_hashes(text):
            total += len(grams)
            where = cells(grams)
            for s in range(self.slices):
                mask = functools.reduce(np.bitwise_and, [table[s][w] for w in where])
                for b in range(s * 64, min(len(out), s * 64 + 64)):
                    out[b] += np.count_nonzero(mask & np.uint64(1 << (b % 64)))
        return out, total

    def decide(self, table: np.ndarray, rates: np.ndarray, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        found, total = self.counts(table, text)
        share = np.clip((found / max(total, 1) - rates) / np.maximum(1 - rates, 1e-9), 0, 1)
        best = int(share.argmax())
        return (self.languages[best], float(share[best])) if share[best] > 0 else (self.common, 0.0)


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> Filters:
    """Filters from at most ``per_language`` labelled, not held-out ids of each language.

    A gram is learned for a language if ``MIN_SHARE`` of its drawn documents hold it, two at
    least; a language with at most 50 labelled documents learns every gram, as few of its
    grams are met twice. All texts of a drawn id teach. What reaches the driver is at most one
    row per filter cell and 64 languages. Rows with null id, language or text teach nothing. No rows: no languages.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    known = known.where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    if not sizes:
        return Filters([], [], None)
    languages = [r["lang"] for r in sizes]
    common = max(sizes, key=lambda r: r["n"])["lang"]
    bit_of = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    rows_of = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], r["n"])])
    known = known.where(drawn(F.col("id"), per_language, rows_of[F.col("lang")]))
    known = known.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language)
    known = known.select("id", bit_of[F.col("lang")].alias("bit")).distinct()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(known), "id").select("bit", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[int, list[np.ndarray]] = {}
            for bit, text in zip(batch["bit"].to_pylist(), batch["text"].to_pylist()):
                found = list(gram_hashes(text)) if text else []
                if found:
                    parts.setdefault(bit, []).append(np.unique(np.concatenate(found)))
            for bit, found in parts.items():
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gram), bit, np.int32)), pa.array(gram.view(np.int64)), pa.array(n)],
                    ["bit", "gram", "n"],
                )

    counted = rows.mapInArrow(grams, "bit int, gram long, n long").groupBy("bit", "gram")
    least = F.create_map(
        *[
            F.lit(x)
            for i, r in enumerate(sizes)
            for x in (i, max(2.0, MIN_SHARE * min(per_language, r["n"])) if r["n"] > 50 else 1.0)
        ]
    )
    often = counted.agg(F.sum("n").alias("n")).where(F.col("n") >= least[F.col("bit")])
    places = [
        F.shiftrightunsigned("gram", 64 - CELL_BITS * (p + 1)).bitwiseAND((1 << CELL_BITS) - 1)
        for p in range(PROBES)
    ]
    word = F.expr("shiftleft(1L, bit % 64)")
    filled = (
        often.select(F.explode(F.array(*places)).alias("at"), F.floor(F.col("bit") / 64).alias("slot"), word.alias("word"))
        .groupBy("at", "slot")
        .agg(F.bit_or("word").alias("word"))
    )
    return Filters(languages, [tuple(r) for r in filled.collect()], common)


def language(text: Column, spark, filters: Filters) -> Column:
    """Struct (lang_pred, score) of a text column."""
    sent = spark.sparkContext.broadcast(filters)

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        table = model.table()
        rates = model.false_rates(table)
        for batch in batches:
            out = [model.decide(table, rates, t.as_py()) for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                ["lang_pred", "score"],
            )

    return predict(text)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, over whole texts.

    Null text or text without a letter: ``und`` with score 0. A text no filter knows gets
    the most frequent language with score 0; equal shares go to the first by name. A null
    id is not held out. Nothing to learn from: ``und`` everywhere. No rows: no rows.
    """
    filters = learn(docs, id_col, text_col, lang_col, per_language)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = language(F.col("text"), docs.sparkSession, filters)
    rows = rows.select("id", held_out(F.col("id")).alias("held_out"), got.alias("got"))
    return rows.select(F.col("id").alias(id_col), "held_out", "got.lang_pred", "got.score")
