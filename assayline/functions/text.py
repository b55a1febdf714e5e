"""Text normalization and word n-grams as column expressions."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayline.fixed_values import LOWERCASE, PUNCTUATION, UPPERCASE, WHITESPACE


#: Odd factor of the rolling gram hash.
HASH_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normalize(col: Column) -> Column:
    """Lower case, white space collapsed to single spaces, no outer spaces."""
    return F.trim(F.regexp_replace(F.lower(col), WHITESPACE, " "))


def words(col: Column) -> Column:
    """White-space separated words; empty text gives an empty array."""
    return F.array_remove(F.split(col, WHITESPACE), "")


def word_count(col: Column) -> Column:
    return F.size(words(col))


def gram_at(word_array: Column, i: Column, n: int) -> Column:
    """The n words from position ``i`` (0-based), joined by a space.

    Single element reads: ``slice`` inside a lambda would copy the whole array for
    every gram.
    """
    return F.concat_ws(" ", *[F.get(word_array, i + k) for k in range(n)])


def gram_starts(word_array: Column, n: int) -> Column:
    """0-based start positions of all n-grams; empty when there are too few words."""
    return F.when(
        F.size(word_array) >= n, F.sequence(F.lit(0), F.size(word_array) - n)
    ).otherwise(F.array().cast("array<int>"))


def grams(col: Column, n: int) -> Column:
    """All n-grams of a text whose words are parted by single spaces.

    One scan of the text: at every word start the next n words are captured ahead and
    one word is consumed. Possessive quantifiers rule out backtracking.
    """
    pattern = rf"(?=((?:\S++ ){{{n - 1}}}\S++))\S++ ?"
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(1))


def gram_marks(col: Column, n: int) -> Column:
    """A number for every gram of ``grams(col, n)`` that goes by its longest word, of several the one
    with the largest hash. Equal grams have equal numbers, and so have most neighbours in a text."""
    found = F.array_remove(F.split(col, " "), "")

    def mark(word: Column) -> Column:
        size = F.least(F.length(word), F.lit(127)).cast("long")
        return F.shiftleft(size, 56).bitwiseOR(F.shiftrightunsigned(F.xxhash64(word), 8))

    def largest(marks: Column) -> Column:
        if n == 1:
            return marks
        return F.transform(
            gram_starts(marks, n), lambda i: F.greatest(*[F.get(marks, i + k) for k in range(n)])
        )

    # a lambda over an array of one element: the marks of the words are made once, not for every gram
    return F.get(F.transform(F.array(F.transform(found, mark)), largest), F.lit(0))


def normalize_strict(col: Column) -> Column:
    """ASCII letters to lower case, ASCII punctuation removed, nothing else touched."""
    return F.translate(col, UPPERCASE + PUNCTUATION, LOWERCASE)


def normalize_spaced(col: Column) -> Column:
    """Strict normalization with single spaces between the words that are left."""
    return F.trim(F.regexp_replace(normalize_strict(col), WHITESPACE, " "))


#: Words of normalized text whose gram hashes a Python worker makes at a time; a text is not cut.
HASH_WORDS = 1 << 19


def gram_hashes(col: Column, n: int) -> Column:
    """A 64-bit hash of every gram of ``grams(col, n)``, from hashes of its words in order, so no
    gram is built; a null text gives null. Equal grams have equal hashes."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def hashed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False)
            sizes, start = np.cumsum(sizes, dtype=np.int64), 0
            while start < len(batch):
                limit = (sizes[start - 1] if start else 0) + 8 * HASH_WORDS
                stop = max(start + 1, int(np.searchsorted(sizes, limit, "right")))
                yield _rolled(batch.slice(start, stop - start), n)
                start = stop

    return hashed(col)


def _rolled(texts: pa.Array, n: int) -> pa.Array:
    """Hashes of the grams of texts whose words are parted by single spaces."""
    split = pc.split_pattern(texts, " ")
    words = split.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False)
    known = words.dictionary.to_numpy(zero_copy_only=False).astype(object)
    word = hash_array(known, categorize=False)[code] if len(code) else np.zeros(0, np.uint64)
    sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    # an empty text is one empty word to ``split``, and no word here
    empty = pc.fill_null(pc.equal(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    total = np.zeros(max(len(word) - n + 1, 0), np.uint64)
    for k in range(n):
        total = total * HASH_FACTOR + word[k : k + len(total)]
    total = (total ^ (total >> np.uint64(32))) * HASH_FACTOR
    counts = np.where(empty, 0, np.maximum(sizes - n + 1, 0))
    at = np.arange(int(counts.sum())) + np.repeat(ends - sizes - (np.cumsum(counts) - counts), counts)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    null = texts.is_null()
    return pa.ListArray.from_arrays(offsets, pa.array(total[at].view(np.int64)), mask=null)


SPANS = T.ArrayType(
    T.StructType()
    .add("word", T.StringType())
    .add("start", T.IntegerType())
    .add("stop", T.IntegerType())
)


#: Characters of text whose words a Python worker holds at a time; one text is never cut.
SPAN_CHARS = 1 << 19


@F.arrow_udf(SPANS)
def word_spans(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Words with first and last character position (inclusive) in the text.

    A batch of texts is answered in slices of about ``SPAN_CHARS`` characters, so memory
    does not grow with the rows of a batch.
    """
    find = re.compile(r"\S+").finditer

    def answer(ends: list, words: list, starts: array, stops: array, null: list) -> pa.Array:
        cols = [pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())]
        spans = pa.StructArray.from_arrays(cols, ["word", "start", "stop"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans, mask=pa.array(null, pa.bool_()))

    for batch in texts:
        held = 0
        ends, words, starts, stops, null = [0], [], array("i"), array("i"), []
        for value in batch:
            text = value.as_py()
            for m in find(text or ""):
                words.append(m.group())
                starts.append(m.start())
                stops.append(m.end() - 1)
            ends.append(len(words))
            null.append(text is None)
            held += len(text or "")
            if held >= SPAN_CHARS:
                yield answer(ends, words, starts, stops, null)
                held = 0
                ends, words, starts, stops, null = [0], [], array("i"), array("i"), []
        if null:
            yield answer(ends, words, starts, stops, null)
