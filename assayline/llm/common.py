"""What the operators share: reading, stored steps and connected components.

Rows with columns of any other name pass through the operators packed into one struct,
so an input column can never clash with a helper column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.session import materialize, scratch_path

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A key with more than one in so many of all rows is hot.
HOT_PARTS = 1000

__all__ = [
    "ASCII_SPACE",
    "ASCII_UPPER",
    "ascii_lower",
    "bounded_batches",
    "components",
    "drawn",
    "held_out",
    "join_facts",
    "materialize",
    "read",
    "scratch_path",
]


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so whole texts fit a Python worker."""
    if int(spark.conf.get(BATCH_ROWS)) > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower case for A-Z alone; every other code point stays."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """Remainder 1 of crc32(doc_id as text) mod 3; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drawn(col: Column, wanted: Column | int, rows: Column | int) -> Column:
    """Condition that a hash of ``col`` falls among about ``2 * wanted + 100`` of ``rows``
    rows, so that a sample is cut down before any sort, however many rows there are."""
    wanted, rows = (F.lit(x) if isinstance(x, int) else x for x in (wanted, rows))
    return F.pmod(F.xxhash64(col, F.lit(5)), F.lit(1 << 40)) < (2 * wanted + 100) / F.greatest(
        rows, F.lit(1)
    ) * (1 << 40)


def join_facts(rows: DataFrame, facts: DataFrame, key: str, number: str = "n") -> DataFrame:
    """Inner join of ``rows`` with the stored table ``facts``, which has one row per key and
    in ``number`` how many of ``rows`` have it; the number is not returned.

    A key with more than one in ``HOT_PARTS`` of all rows is met by broadcast, as there are
    fewer than ``HOT_PARTS`` such keys whatever the size, and its rows stay where they are;
    the others are shuffled, and no task meets more than that share under one key.
    """
    total = facts.agg(F.sum(number)).first()[0] or 0
    hot = F.col(number) * HOT_PARTS > total
    often = F.broadcast(facts.where(hot).drop(number))
    rest = rows.join(often.select(key), key, "left_anti")
    rest = rest.join(facts.where(~hot).drop(number), key)
    return rows.join(often, key).unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` as (node, root): the smallest node reachable.

    Large-star and small-star rounds in turn: every round joins neighbours to the
    smallest node they know, links only ever point to smaller nodes, and the rounds
    needed grow with the logarithm of the longest chain. Each round is stored in the
    shared folder. A node with very many links is aggregated before the shuffle, and
    is joined back without being shuffled. Only nodes with links are returned.
    """
    edges = materialize(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        least = materialize(least.select("a", F.least("a", "m").alias("m"), "n"), "least")
        large = join_facts(both, least, "a").where("b > a").select(F.col("b").alias("a"), "m")
        large = materialize(large.where("a <> m").distinct(), "large-star")
        lowest = large.groupBy("a").agg(F.min("m").alias("r"), F.count(F.lit(1)).alias("n"))
        small = (
            join_facts(large, materialize(lowest, "lowest"), "a")
            .select(F.explode(F.array(F.col("a"), F.col("m"))).alias("a"), F.col("r").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = materialize(small, "small-star")
        if same_rows(edges, after):
            stars = after.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
        edges = after


def same_rows(one: DataFrame, two: DataFrame) -> bool:
    """Whether two tables of distinct (a, b) rows are equal, by count and hash sums."""
    mix = F.xxhash64("a", "b").cast("decimal(38,0)")
    facts = [F.count(F.lit(1)), F.sum(mix), F.sum(F.hash("a", "b").cast("long"))]
    return one.agg(*facts).first() == two.agg(*facts).first()
