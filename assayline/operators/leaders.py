"""First come, first kept: rows in order, of which a row goes if an earlier kept row shares
a link with it. The rule is not transitive, so it is settled in rounds, not by grouping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.operators.scale import broadcast_if_small
from assayline.session import materialize


def same(cols: Sequence[str]) -> Column:
    """Null-safe equality of columns with the ``_k0``, ``_k1`` ... of a side table."""
    return reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(cols)]
    )


def side(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(cols)])


def displaced(
    held: DataFrame, place: Sequence[str], rank: str, link: str, fixed: DataFrame | None = None
) -> DataFrame:
    """Rows ``place`` that a kept row of lower ``rank``, or a link of ``fixed``, displaces.

    ``held`` is a stored table with one row per row and link; rows of one rank do not meet.
    In a round a row goes if a kept row of lower rank has one of its links, and is kept once
    all rows of lower rank that share a link with it are settled; the others wait. The lowest
    rank among the waiting rows always settles, and rounds are as many as the longest chain
    of rows that wait for each other.
    """
    at, none = F.col(rank).cast("long"), F.lit(None).cast("long")
    if fixed is None:
        fixed = held.select(link).limit(0)
    kept = fixed.select(link, F.lit(-1).cast("long").alias("lo"))
    waiting, removed = held, None
    while True:
        facts = (
            waiting.select(link, at.alias("first"), none.alias("lo"))
            .unionByName(kept.select(link, none.alias("first"), "lo"))
            .groupBy(link)
            .agg(F.min("first").alias("first"), F.min("lo").alias("lo"))
            .where("first IS NOT NULL")
        )
        judged = waiting.join(broadcast_if_small(facts), link).groupBy(*place).agg(
            F.max(F.coalesce(F.col("lo") < at, F.lit(False))).alias("hit"),
            F.max(F.col("first") < at).alias("blocked"),
        )
        judged = materialize(judged, "judged")
        gone = judged.where("hit").select(*place)
        removed = gone if removed is None else removed.unionAll(gone)
        later = judged.where("NOT hit AND blocked")
        if later.isEmpty():
            return removed
        clear = broadcast_if_small(side(judged.where("NOT hit AND NOT blocked"), place))
        fresh = waiting.join(clear, same(place), "left_semi").select(link, at.alias("lo"))
        kept = kept.unionByName(fresh).groupBy(link).agg(F.min("lo").alias("lo"))
        kept = materialize(kept, "kept-links")
        later = broadcast_if_small(side(later, place))
        waiting = materialize(waiting.join(later, same(place), "left_semi"), "waiting")
