"""Building blocks that stay bounded when one key holds a large share of the rows.

A window over a hot key would put the whole key into one task. The helpers here
cut every key into order-preserving chunks, work inside (key, chunk), and add the
totals of the earlier chunks; only one row per (key, chunk) meets in one place.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.session import materialize

CHUNK_ROWS = 1 << 20
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
HASH_ROWS = 1 << 16
RANK_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"
SPARSE = 4  # id range over rows from which on ids count as sparse
SURPLUS = 4  # rows over k up to which a key is not cut
SKETCH = 10_000
FRACTIONS = [2.0**-i for i in range(10, 0, -1)]  # cuts a sketch offers, as shares of a key
_ALL = "_all"
SCANS = {"Project", "Filter", "Relation", "RelationV2", "LocalRelation", "LogicalRDD", "Union"}


def chunk_of(order: str, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a unique integer order column: at most ``rows`` rows each."""
    return F.floor(F.col(order) / F.lit(rows)).cast("long")


def _row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: texts and nested values by their length, others 8 bytes."""
    total = F.lit(0)
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(col), F.lit(0))
        elif "<" in kind:
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0))
        else:
            total = total + 8
    return total.cast("long")


def is_scan(df: DataFrame) -> bool:
    """Whether a plan only reads, projects and filters stored rows."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    names = re.findall(r"^[\s:+-]*(\w+)", plan, re.MULTILINE)
    return set(names) <= SCANS


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Broadcast hint only within a bound of rows and of bytes; larger inputs are left to a
    shuffle join. What is more than a scan is stored first, so it is computed once."""
    if not is_scan(df):
        df = materialize(df, "side")
    return F.broadcast(df) if small(df, max_rows, max_bytes) else df


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is within both bounds."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    chunk: Sequence[Column] | None = None,
    within: Sequence[Column] | None = None,
) -> DataFrame:
    """Inclusive running sums per key. No row is lost: null keys are keys of their own
    and null order values come first.

    Default order is the unique integer column ``order``: dense ids are cut into ranges,
    sparse ones are range-partitioned, with the same sums. For another order give
    ``chunk`` (leading sort columns, small enough groups) and ``within`` (the rest).
    """
    if chunk is None:
        facts = df.agg(F.count(F.lit(1)), F.max(order) - F.min(order)).first()
        if (facts[1] or 0) > SPARSE * max(facts[0], CHUNK_ROWS):
            return running_in_order(df, keys, [F.col(order).asc()], sums)
    chunk = list(chunk) if chunk is not None else [chunk_of(order)]
    within = list(within) if within is not None else [F.col(order).asc()]
    parts = [f"_c{i}" for i in range(len(chunk))]
    base = df.withColumns(dict(zip(parts, chunk)))
    if not keys:
        base = base.withColumn(_ALL, F.lit(0))
    group = list(keys) if keys else [_ALL]
    cell = [*group, *parts]

    totals = base.groupBy(*cell).agg(
        *[F.sum(expr).alias(f"_t_{name}") for name, expr in sums.items()]
    )
    before = (
        Window.partitionBy(*group)
        .orderBy(*parts)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(cell)],
        *[
            F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}")
            for name in sums
        ],
    )
    local = (
        Window.partitionBy(*cell)
        .orderBy(*within)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    out = base.withColumns(
        {f"_l_{name}": F.sum(expr).over(local) for name, expr in sums.items()}
    ).join(offsets, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(cell)])
    out = out.withColumns(
        {name: F.col(f"_l_{name}") + F.col(f"_o_{name}") for name in sums}
    )
    helper = [*parts, *[f"_k{i}" for i in range(len(cell))]]
    helper += [f"_{p}_{n}" for n in sums for p in "lo"]
    return out.drop(*helper, *([] if keys else [_ALL]))


def numbered(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "pos"
) -> DataFrame:
    """1-based position per key by the unique integer column ``order``."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def running_in_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]
) -> DataFrame:
    """Running sums per key in any unique order.

    Range partitioning on the whole order gives chunks of even size even when one key
    or one value is hot; they are written once so that chunk numbers stay fixed.
    """
    spread = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    fixed = materialize(spread, "ordered")
    return running(fixed, keys, "", sums, [F.col("_part")], order).drop("_part")


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "pos"
) -> DataFrame:
    """1-based position per key in any unique order."""
    return running_in_order(df, keys, order, {name: F.lit(1).cast("long")})


def nearest(df: DataFrame, keys: Sequence[str], lead: Column, k: int) -> DataFrame:
    """Rows among which the ``k`` smallest by ``lead`` of every key are, and not many more.

    ``lead`` is a number without nulls that the wanted order starts with. A quantile sketch
    per key names a cut, an exact count says whether it keeps k rows, and only then rows
    beyond it are left out where they are read. Cuts are tightened until a key has at most
    ``SURPLUS`` times k rows or equal values allow no more. Keys with fewer rows have no cut.
    """
    rows = df.withColumn("_lead", lead.cast("double"))
    named = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)]
    at = F.lit(True)
    for i, c in enumerate(keys):
        at = at & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    names = [f"_k{i}" for i in range(len(keys))]
    while True:
        facts = rows.groupBy(*named).agg(
            F.count(F.lit(1)).alias("_n"),
            F.percentile_approx("_lead", FRACTIONS, SKETCH).alias("_q"),
        ).where(F.col("_n") > SURPLUS * k)
        wanted = (F.lit(1.2 * k) + 4 * F.col("_n") / SKETCH) / F.col("_n")
        pick = F.greatest(F.size(F.filter(F.array(*map(F.lit, FRACTIONS)), lambda f: f < wanted)), F.lit(0))
        cuts = facts.select(*names, "_n", F.get("_q", pick).alias("_cut")).where("_cut IS NOT NULL")
        cuts = materialize(cuts, "cuts")
        if cuts.isEmpty():
            return rows.drop("_lead")
        under = rows.join(broadcast_if_small(cuts), at).where("_lead <= _cut")
        held = under.groupBy(*names, "_cut").agg(
            F.count(F.lit(1)).alias("_held"), F.first("_n").alias("_n")
        )
        good = held.where((F.col("_held") >= k) & (F.col("_held") < F.col("_n")))
        good = materialize(good.select(*names, "_cut"), "cuts")
        if good.isEmpty():
            return rows.drop("_lead")
        rows = rows.join(broadcast_if_small(good), at, "left")
        rows = rows.where("_cut IS NULL OR _lead <= _cut").drop("_cut", *names)


def first_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    name: str = "pos",
    lead: Column | None = None,
) -> DataFrame:
    """First ``k`` rows per key with their position, the same rows for every k.

    Up to the rank limit of the session Spark cuts every key to k rows before the shuffle
    already; a larger k is ranked in chunks, and with ``lead`` (see ``nearest``) only rows
    near the first k are ranked.
    """
    if k > int(df.sparkSession.conf.get(RANK_SETTING)):
        near = df if lead is None else nearest(df, keys, lead, k)
        return ranked(near, keys, order, name).where(F.col(name) <= k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def hash_text(cols: Sequence[str], seed: int) -> Column:
    """Hex text that orders rows pseudo-randomly, the same on every run."""
    parts = [F.col(c).cast("string") for c in cols]
    return F.sha2(F.concat_ws("|", *parts, F.lit(str(seed))), 256)


def hash_ranked(
    df: DataFrame,
    keys: Sequence[str],
    id_cols: Sequence[str],
    seed: int,
    name: str = "pos",
    digits: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Seeded random 1-based position per key; chunk = leading hex digits, as many as keep
    a chunk at about ``HASH_ROWS`` rows. With ``limit`` only so many rows per key are kept."""
    mixed = df.withColumn("_h", hash_text(id_cols, seed))
    if limit is not None:
        mixed = nearest(mixed, keys, F.conv(F.substring("_h", 1, 12), 16, 10), limit)
    if digits is None:
        digits = 1
        rows = mixed.count()
        while rows > HASH_ROWS * 16**digits:
            digits += 1
    order = [F.col("_h"), *[F.col(c) for c in id_cols]]
    one = {name: F.lit(1).cast("long")}
    out = running(mixed, keys, "", one, [F.substring("_h", 1, digits)], order).drop("_h")
    return out if limit is None else out.where(F.col(name) <= limit)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key. The rank limit is applied before the shuffle as well, so a
    hot key sends one row per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
