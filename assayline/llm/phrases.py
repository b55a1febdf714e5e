"""Phrase collocations by prefix-free parsing.

The words of a text piece are cut into chunks at trigger words, which their own hash names,
so equal passages are cut alike wherever they stand. A chunk carries the next words as an
overlap, as many as a phrase can reach past it; a phrase belongs to the chunk it starts in and
is counted there alone. The dictionary holds every distinct chunk once with its frequency, and
phrases are counted inside distinct chunks, weighted by frequency.

Phrases are counted by length; a longer one is counted only where all its parts of the length
counted before are frequent, which a bit table of bounded size tells with errors on the safe
side: it never loses a frequent phrase, and what it lets through is counted exactly.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from assayline.llm.common import join_facts, materialize
from assayline.operators.scale import broadcast_if_small

#: Every byte that ends a piece becomes a line end, a tab a space.
PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
SPACES = re.compile(b" +")
#: One word in so many is a trigger; a chunk without one is cut after so many words.
TRIGGER, LONGEST = 32, 4096
#: Entries of the dictionary held by a task, bytes of text cut and bytes of chunks counted at once.
HELD, TEXT_BYTES, BLOCK_BYTES = 200_000, 1 << 20, 12 << 20
#: Bits of the table for each frequent phrase, and bits of the table at most (128 MB).
BITS_EACH, MAX_BITS, SLICE_BITS = 16, 1 << 30, 1 << 15
SALTS = 64


def chunks_of(text: bytes, overlap: int, longest: int = LONGEST) -> list[tuple[int, bytes]]:
    """(own words, words joined by a space) of the chunks of a text. A word is a trigger by a
    hash of its length, its first and its last three bytes."""
    text = text.lower().translate(PLAIN)
    if b"  " in text:
        text = SPACES.sub(b" ", text)
    letters = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = (letters != 32) & (letters != 10)
    edges = np.flatnonzero(np.diff(inside))
    first, last = edges[::2], edges[1::2]
    if not len(first):
        return []
    code = (last - first).astype(np.uint32)
    for at in (first, *[np.maximum(last - k, first) for k in (1, 2, 3)]):
        code = (code ^ letters[at]) * np.uint32(0x9E3779B1)
    piece = np.cumsum(letters == 10)[first]
    new = np.append(True, piece[1:] != piece[:-1])
    pieces = np.flatnonzero(new)
    sizes = np.diff(np.append(pieces, len(first)))
    nth = np.arange(len(first)) - np.repeat(pieces, sizes)
    new |= ((code >> np.uint32(16)) % TRIGGER == 0) | (nth % longest == 0)
    start = np.flatnonzero(new)
    own = np.diff(np.append(start, len(first)))
    end = np.minimum(start + own + overlap, np.repeat(pieces + sizes, sizes)[start])
    spans = zip(first[start].tolist(), last[end - 1].tolist())
    return list(zip(own.tolist(), [text[a:b] for a, b in spans]))


def dictionary(
    docs: DataFrame, lang_col: str, text_col: str, longest_phrase: int = 5
) -> DataFrame:
    """Stored table (lang, words, own, freq) of distinct chunks; frequencies are summed in the
    task before they are shuffled."""
    rows = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                own, words = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(own), pa.string()),
                        pa.array(words, pa.binary()).cast(pa.string()),
                        pa.array(own, pa.int32()),
                        pa.array(found.values(), pa.int64()),
                    ],
                    ["lang", "words", "own", "freq"],
                )
            held.clear()

        def parts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
            """Texts of a language, joined by line ends up to about ``TEXT_BYTES``."""
            texts: dict[str, list[bytes]] = {}
            sizes: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = texts.setdefault(lang, [])
                own.append(text.as_py())
                sizes[lang] += len(own[-1])
                if sizes[lang] > TEXT_BYTES:
                    yield lang, b"\n".join(texts.pop(lang))
                    del sizes[lang]
            for lang, own in texts.items():
                yield lang, b"\n".join(own)

        for batch in batches:
            for lang, text in parts(batch):
                chunks = chunks_of(text, longest_phrase - 1)
                held.setdefault(lang, Counter()).update(chunks)
                if sum(map(len, held.values())) > HELD:
                    yield from out()
        yield from out()

    found = rows.mapInArrow(parse, "lang string, words string, own int, freq long")
    found = found.groupBy("lang", "words", "own").agg(F.sum("freq").alias("freq"))
    return materialize(found, "chunks")


def gram_hashes(words: np.ndarray, n: int, seeds: np.ndarray) -> np.ndarray:
    """Hash of the n words from every place on, of word hashes and a seed at each place."""
    size = max(len(words) - n + 1, 0)
    out = seeds[:size].copy()
    for j in range(n):
        out = (out ^ words[j : j + size]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


@F.arrow_udf(LongType())
def phrase_hash(lang: pa.Array, phrase: pa.Array) -> pa.Array:
    out = [0]
    seeds = _codes(lang.cast("binary"))
    for seed, text in zip(seeds, phrase.to_pylist()):
        words = np.array([xxhash.xxh3_64_intdigest(w) for w in text.encode().split(b" ")], np.uint64)
        out.append(gram_hashes(words, len(words), np.full(len(words), seed))[0])
    return pa.array(np.array(out[1:], np.uint64).view(np.int64))


def bit_table(phrases: DataFrame) -> np.ndarray:
    """Bit table of stored phrases (lang, phrase), two bits each, as bytes. The driver gets at
    most ``MAX_BITS`` bits, in slices."""
    bits = 1 << 20
    while bits < min(phrases.count() * BITS_EACH, MAX_BITS):
        bits *= 2
    code = phrase_hash("lang", "phrase")
    spots = F.array(code.bitwiseAND(bits - 1), F.shiftright(code, 33).bitwiseAND(bits - 1))
    places = phrases.select(F.explode(spots).alias("at"))
    slices = places.groupBy(F.floor(F.col("at") / SLICE_BITS).alias("slice")).agg(
        F.collect_set((F.col("at") % SLICE_BITS).cast("int")).alias("own")
    )
    table = np.zeros(bits // 8, np.uint8)
    for row in slices.toLocalIterator():
        one = np.zeros(SLICE_BITS, bool)
        one[row.own] = True
        at = row.slice * SLICE_BITS // 8
        table[at : at + SLICE_BITS // 8] = np.packbits(one, bitorder="little")
    return table


def in_table(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set."""
    mask = np.uint64(len(table) * 8 - 1)
    found = np.ones(len(codes), bool)
    for at in (codes & mask, (codes.view(np.int64) >> 33).view(np.uint64) & mask):
        found &= (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _codes(words: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()], np.uint64)


def block_counts(
    rows: pa.Table, lengths: Sequence[int], table: np.ndarray | None, part: int
) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n, a) of the phrases of ``lengths`` words that start in the own words of
    chunks (lang, words, own, freq), counted at once over numbers of words."""
    langs = rows["lang"].combine_chunks().dictionary_encode()
    lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    split = pc.split_pattern(rows["words"].combine_chunks(), " ")
    bounds = split.offsets.to_numpy().astype(np.int64)
    words = split.flatten().dictionary_encode()
    ids, names = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    row = np.repeat(np.arange(len(lang)), np.diff(bounds))
    place = np.arange(len(ids))
    left = bounds[1:][row] - place
    own = place < (bounds[:-1] + rows["own"].to_numpy())[row]
    freq, lang = rows["freq"].to_numpy()[row], lang[row]
    if table is not None:
        codes = gram_hashes(_codes(names)[ids], part, _codes(langs.dictionary.cast("binary"))[lang])
        parts = in_table(table, codes)
    for n in lengths:
        able = own & (left >= n)
        if table is not None:
            for j in range(n - part + 1):
                able[: max(len(parts) - j, 0)] &= parts[j:]
        at = np.flatnonzero(able)
        number = lang[at]
        for j in range(n):  # exact numbers of ever longer phrases
            if j > 1:
                number = pd.factorize(number)[0]
            number = number * len(names) + ids[at + j]
        number, values = pd.factorize(number)
        sums = np.zeros(len(values), np.int64)
        np.add.at(sums, number, freq[at])
        first = np.zeros(len(values), np.int64)
        first[number[::-1]] = at[::-1]
        found = [names.take(pa.array(ids[first + j])) for j in range(n)]
        phrase = pc.binary_join_element_wise(*found, b" ") if n > 1 else found[0]
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(lang[first])),
                phrase.cast(pa.string()),
                pa.array(np.full(len(first), n, np.int32)),
                pa.array(sums),
            ],
            ["lang", "phrase", "n", "a"],
        )


def gram_counts(
    chunks: DataFrame, lengths: Sequence[int], frequent: DataFrame | None, part: int, least: int
) -> DataFrame:
    """Stored (lang, phrase, n, a) of all phrases of ``lengths`` words found ``least`` times or
    more. ``frequent`` are those of ``part`` words, without which a phrase cannot be."""
    spark = chunks.sparkSession
    held = None if frequent is None else spark.sparkContext.broadcast(bit_table(frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if held is None else held.value
        block, size = [], 0
        for batch in batches:
            block.append(batch)
            size += batch.nbytes
            if size > BLOCK_BYTES:
                yield from block_counts(pa.Table.from_batches(block), lengths, table, part)
                block, size = [], 0
        if block:
            yield from block_counts(pa.Table.from_batches(block), lengths, table, part)

    rows = chunks.select("lang", F.col("words").cast("binary"), "own", "freq")
    found = rows.mapInArrow(count, "lang string, phrase string, n int, a long")
    found = found.groupBy("lang", "phrase", "n").agg(F.sum("a").alias("a"))
    found = materialize(found.where(F.col("a") >= least), "phrases")
    if held is not None:
        held.destroy()
    return found


def _key(lang: Column, phrase: Column) -> Column:
    return F.concat(F.length(lang).cast("string"), F.lit(":"), lang, phrase)


def _part_counts(cuts: DataFrame, grams: DataFrame, key: str, name: str) -> DataFrame:
    """``cuts`` with the count of the phrase named by ``key``; frequent keys are not shuffled."""
    uses = cuts.groupBy(key).agg(F.count(F.lit(1)).alias("uses"))
    facts = uses.join(grams.select(F.col("key").alias(key), F.col("a").alias(name)), key)
    return join_facts(cuts, materialize(facts, "phrase-parts"), key, "uses").drop(key)


def scored(grams: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, n, a, cut, l, r, score) of phrases of two words and more, at the cut with
    the lowest score. Products are decimals of up to 38 digits and the division is a whole one:
    exact for counts up to 10^17."""
    grams = grams.withColumn("key", _key(F.col("lang"), F.col("phrase")))
    words = F.split("phrase", " ")
    cuts = grams.where("n > 1").select(
        "lang", "phrase", "n", "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("cut")
    )
    head = F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ")
    tail = F.array_join(F.slice(words, F.col("cut") + 1, F.col("n")), " ")
    cuts = materialize(
        cuts.select("*", _key(F.col("lang"), head).alias("head"), _key(F.col("lang"), tail).alias("tail")),
        "phrase-cuts",
    )
    cuts = materialize(_part_counts(cuts, grams, "head", "l"), "phrase-heads")
    cuts = _part_counts(cuts, grams, "tail", "r")
    cuts = cuts.join(broadcast_if_small(totals), "lang")
    exact = {c: F.col(c).cast("decimal(17,0)") for c in ("a", "l", "r", "total")}
    cuts = cuts.withColumns({f"_{c}": e for c, e in exact.items()})
    score = F.expr("(_a * _total * 1000BD) div (_l * _r)")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r"))
    return cuts.groupBy("lang", "phrase", "n", "a", "total").agg(best.alias("best")).select(
        "lang", "phrase", "n", "a", "total", "best.*"
    )


def outermost(found: DataFrame, percent: int = 100) -> DataFrame:
    """Phrases that no longer one contains ``percent`` in a hundred times as often. A phrase
    that is inside a much longer one is inside one of a word more that is as frequent."""
    words = F.split("phrase", " ")
    inner = found.where("n > 2").select(
        "lang",
        "a",
        F.explode(
            F.array(
                F.array_join(F.slice(words, F.lit(1), F.col("n") - 1), " "),
                F.array_join(F.slice(words, F.lit(2), F.col("n")), " "),
            )
        ).alias("phrase"),
    )
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = found.join(inner, ["lang", "phrase"], "left")
    return rows.where(~F.coalesce(100 * F.col("longer") >= percent * F.col("a"), F.lit(False)))


def best_per_language(found: DataFrame, top: int) -> DataFrame:
    """First ``top`` of each language by score, count and phrase, ranked; each of ``SALTS``
    parts of a language is cut to ``top`` first."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    rows = found.withColumn("_part", part)
    for keys in (["lang", "_part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rows = rows.withColumn("rank", place).where(F.col("rank") <= top)
    return rows.drop("_part")


def collocations(
    docs: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    longest: int = 5,
    least: int = 100,
    top: int = 2000,
    percent: int = 100,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of every language.

    A null language is ``und``, a null text is empty, a text without words counts nothing;
    repeated rows count as often as they are there. No phrase found ``least`` times: no rows.
    Words and marks are as they stand, A-Z in lower case; a phrase lies within a piece between
    the marks ``.,;:!?`` and line ends. Other columns are not looked at. A text is parsed whole
    in its task; chunks have at most ``LONGEST`` own words.
    """
    chunks = dictionary(docs, lang_col, text_col, longest)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("total"))
    totals = materialize(totals, "phrase-totals")
    levels = [[1], [2], [3], list(range(4, longest + 1))]
    grams, last, part = [], None, 0
    for lengths in levels:
        if lengths and lengths[0] <= longest:
            last = gram_counts(chunks, lengths, last, part, least)
            grams.append(last)
            part = lengths[0]
    every = grams[0]
    for more in grams[1:]:
        every = every.unionByName(more)
    found = best_per_language(outermost(scored(every, totals), percent), top)
    return found.select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        "a",
        "l",
        "r",
        F.col("total").alias("n"),
        "score",
    )
