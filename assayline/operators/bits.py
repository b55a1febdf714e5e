"""Map-side filter by a bit table in slices of bounded size.

A set of 64-bit hashes is folded into words of 64 bits by ``bit_or`` in a ``groupBy``;
each hash sets four bits of one word. The words are stored in slices, and a slice is one
row, so a probe is a broadcast join on the slice number that reads one word: rows of the
large side are dropped where they are read, and only survivors are shuffled. The table may
let a row through that is not in the set, and never drops one that is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.session import materialize

BITS_PER_KEY = 24
SLICE_BITS = 12
SLICE_WORDS = 1 << SLICE_BITS
PASS_SLICES = 1 << 11  # 64 MiB of words in one broadcast
MAX_PASSES = 4
PROBES = 4


def _place(key: Column, words: int) -> Column:
    """Word of a hash, from its upper 40 bits."""
    return F.pmod(F.shiftrightunsigned(key, 24), F.lit(words))


def _mask(key: Column) -> Column:
    """Four bits of a word, six bits of the hash for each."""
    one = F.lit(1).cast("long")
    picks = [
        F.call_function(
            "shiftleft", one, F.shiftrightunsigned(key, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        )
        for i in range(PROBES)
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), picks)


class BitTable:
    """Stored slices ``(_slice, _words)`` of a set of hashes."""

    def __init__(self, slices: DataFrame, count: int):
        self.slices = slices
        self.count = count

    def survivors(self, df: DataFrame, key: Column) -> DataFrame:
        """Rows of ``df`` whose hash may be in the set, without an exchange of ``df``: one
        pass over it for every ``PASS_SLICES`` slices. Null hashes are never in it."""
        words = self.count * SLICE_WORDS
        kept = []
        for first in range(0, self.count, PASS_SLICES):
            last = min(first + PASS_SLICES, self.count)
            part = self.slices.where(F.col("_slice").between(first, last - 1))
            place, mask = _place(key, words), _mask(key)
            word = F.get("_words", F.pmod(place, F.lit(SLICE_WORDS)).cast("int"))
            at = F.shiftright(place, SLICE_BITS)
            hit = (F.col("_slice") == at) & (word.bitwiseAND(mask) == mask)
            kept.append(df.join(F.broadcast(part), hit, "left_semi"))
        return reduce(DataFrame.unionAll, kept)


def bit_table(
    keys: DataFrame, key: str, rows: int, bits_per_key: int = BITS_PER_KEY
) -> BitTable:
    """Bit table of the 64-bit hashes in column ``key``; ``rows`` is their number.

    The table grows with the set up to ``MAX_PASSES`` broadcasts of ``PASS_SLICES`` slices;
    beyond that it has fewer bits a key, and lets more rows through.
    """
    wanted = -(-max(rows, 1) * bits_per_key // (64 * SLICE_WORDS))
    count = max(1, min(wanted, PASS_SLICES * MAX_PASSES))
    words = count * SLICE_WORDS
    spark = keys.sparkSession
    col = F.col(key)
    filled = (
        keys.where(col.isNotNull())
        .groupBy(_place(col, words).alias("_at"))
        .agg(F.bit_or(_mask(col)).alias("_bits"))
    )
    empty = spark.range(words).select(F.col("id").alias("_at"), F.lit(0).cast("long").alias("_bits"))
    whole = filled.unionByName(empty).groupBy("_at").agg(F.bit_or("_bits").alias("_bits"))
    slices = whole.groupBy(
        F.shiftright("_at", SLICE_BITS).alias("_slice")
    ).agg(F.array_sort(F.collect_list(F.struct("_at", "_bits"))).alias("_words"))
    slices = slices.select("_slice", F.transform("_words", lambda w: w["_bits"]).alias("_words"))
    return BitTable(materialize(slices, "bits"), count)
