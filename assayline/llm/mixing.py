"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a token target (shares by weight, no source above ``max_repeat`` passes)
and a schedule that says how its weight moves over training time. The documents of a
source are laid end to end in a hash order; pass after pass this axis is its demand. The
integral of the schedule maps time to the demand met so far; inverting it gives every
document its training position, and the mix is range-sorted by it. Column expressions
alone, and only ids and sizes are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import materialize
from assayline.operators.scale import running_in_order

#: Relative weight at even steps of training time, one list per source in turn.
SHAPES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeat: float = 3
) -> DataFrame:
    """(source, rank, rows, source_size, target) from rows (source, size).

    Sources by code point, null last, take ``weights`` in turn. The target is
    min(max_repeat * source_size, level * weight) with the one level at which targets
    sum to all sizes: what is cut from a full source is shared again by weight. The
    level is read off the sources sorted by the level at which they fill up. One row per
    source is sorted in one task, so this holds for as many sources as a task can sort.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    ranked = totals.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    )
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn(
        "weight", F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int"))
    ).withColumn("cap", F.col("source_size") * float(max_repeat))
    by_fill = Window.orderBy("fill", "rank")
    every = Window.partitionBy(F.lit(0))
    levels = (
        ranked.withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn(
            "spent",
            F.coalesce(
                F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
            ),
        )
        .withColumn(
            "left", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
        )
        .withColumn("level", (F.sum("source_size").over(every) - F.col("spent")) / F.col("left"))
    )
    first = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "rank", "level")))
    return levels.withColumn("at", first.over(every)["level"]).select(
        "source",
        "rank",
        "rows",
        "source_size",
        F.least("cap", F.coalesce(F.col("at"), F.lit(float("inf"))) * F.col("weight")).alias(
            "target"
        ),
    )


def _offsets(rows: DataFrame) -> DataFrame:
    """Add ``before``: sizes of the source's documents ahead in hash order.

    The stored rows are range-partitioned on the whole order, so a part has an even share
    of all rows, however hot a source or an id is, and only one row per source and part is
    summed in order. Rows alike in everything are told apart by their place in the table.
    """
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    order = [F.col(c) for c in ("order", "id", "tie", "place")]
    placed = running_in_order(rows.withColumn("place", place), ["source"], order, {"upto": F.col("size")})
    return placed.withColumn("before", F.col("upto") - F.col("size"))


def _time_of(share: Column, shape: Sequence[float]) -> Column:
    """Time in 0..1 at which a source with this schedule has met ``share`` of its demand.

    The schedule is linear between its points, its integral quadratic; the inverse is
    the root of the piece in which the share lies.
    """
    step = 1.0 / (len(shape) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(shape, shape[1:])]
    total, done, out = sum(areas), 0.0, F.lit(1.0)
    pieces = []
    for i, area in enumerate(areas):
        a, b = shape[i], shape[i + 1]
        rest = share * total - done
        slope = (b - a) / step
        # a t + slope t^2 / 2 = rest, in the form that is stable for slope 0
        root = F.sqrt(F.greatest(F.lit(0.0), a * a + rest * (2 * slope)))
        pieces.append((done + area, i * step + F.when(rest <= 0, 0.0).otherwise(2 * rest / (a + root))))
        done += area
    for end, value in reversed(pieces):
        out = F.when(share * total <= end, value).otherwise(out)
    return F.least(F.lit(1.0), out)


def curriculum(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    max_repeat: float = 3,
    shapes: Sequence[Sequence[float]] = SHAPES,
) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, source, positions.

    ``taken`` is the number of words of all placed passes, repeats counted: whole passes over
    the source, and in the last pass documents in hash order until the target is met (the
    last one in part). ``positions`` has the training time of each taken pass in 0..1.

    Null or empty text has size 0, is never taken and has no positions; a null source is
    a source of its own, last in order; a null id is ordered by its text hash. Repeated
    rows count each. Order depends on ids and texts alone, so reruns agree. No rows: no
    rows. A source's targets and sizes are sums of all its rows.
    """
    packed = docs.select(F.struct("*").alias("row"))
    order = F.md5(F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit("")))
    rows = packed.select(
        F.col(f"row.`{id_col}`").alias("id"),
        F.col(f"row.`{source_col}`").alias("source"),
        word_count(F.col(f"row.`{text_col}`")).alias("size"),
        order.alias("order"),
        F.xxhash64(f"row.`{text_col}`").alias("tie"),
    )
    rows = materialize(rows, "sizes")
    targets = materialize(source_targets(rows, weights, max_repeat), "targets")
    plan = targets.select(
        F.col("source").alias("t_source"), "rank", "source_size", "target"
    )
    placed = _offsets(rows).join(
        plan, F.col("source").eqNullSafe(F.col("t_source"))
    )
    passes = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    rest = F.floor(F.col("target") - F.col("passes") * F.col("source_size")) - F.col("before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    placed = placed.withColumn("passes", passes.cast("long")).withColumn(
        "part", part.cast("long")
    )
    n_pos = F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)
    demand = lambda p: (p * F.col("source_size") + F.col("before")) / F.col("target")

    def at(p: Column) -> Column:
        out = _time_of(demand(p), shapes[0])
        for i, shape in enumerate(shapes[1:], 1):
            out = F.when(F.col("rank") % len(shapes) == i, _time_of(demand(p), shape)).otherwise(out)
        return out

    def place(p: Column) -> Column:
        words = F.when(p < F.col("passes"), F.col("size")).otherwise(F.col("part"))
        return F.struct(at(p).alias("position"), words.alias("words"))

    none = F.array().cast("array<struct<position: double, words: bigint>>")
    places = F.when(
        (F.col("size") > 0) & (n_pos > 0), F.transform(F.sequence(F.lit(0), n_pos - 1), place)
    ).otherwise(none)
    words = lambda n, p: n + p["words"]
    return placed.withColumn("places", places).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        F.aggregate("places", F.lit(0).cast("long"), words).alias("taken"),
        "source",
        F.col("places.position").alias("positions"),
    )


def by_first_position(mixed: DataFrame) -> DataFrame:
    """One row per document, range-sorted by the position of its first pass; documents that
    are not taken come last."""
    order = [F.try_element_at("positions", F.lit(1)).asc_nulls_last(), F.col(mixed.columns[0])]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per taken pass, range-sorted by position; ``taken_here`` are its words."""
    rows = mixed.select("*", F.posexplode("positions").alias("pass", "position"))
    here = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    rows = rows.withColumn("taken_here", here).drop("positions")
    order = ["position", rows.columns[0], "pass"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
