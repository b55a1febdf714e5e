"""Exact near-duplicate vectors by dual traversal of cover trees.

Unit vectors with a cosine of at least c are at most sqrt(2 - 2 c) apart. In a cover tree
the radius halves from level to level; a pair of nodes whose centres are further apart
than that distance plus both covering radii holds no link and is dropped whole. Vectors
are compared inside a label only. Equal vectors are one point with a count. A label with
many points gets cells around centres (the upper levels of the tree, from a bounded
sample); a point visits a cell only if the ball and the bisector bound allow a link. A
cell is worked on in blocks of bounded size, so neither a hot label nor a hot cell ever
meets in one task. A block returns link counts and a star per class, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import components, drawn, join_facts, materialize
from assayline.llm.simhash import _joined

LEAF = 16
BLOCK_ROWS = 8192
CELL_ROWS = 65_536
MAX_CENTRES = 2048
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; safe for very large and small values."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def net(x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Greedy net: centres further apart than ``radius`` and the centre number of each row."""
    centres: list[int] = []
    owner = np.full(len(x), -1)
    for first in range(0, len(x), 512):
        rows = np.arange(first, min(first + 512, len(x)))
        if centres:
            d = distances(x[rows], x[centres])
            near = d.argmin(axis=1)
            ok = d[np.arange(len(rows)), near] <= radius
            owner[rows[ok]] = near[ok]
            rows = rows[~ok]
        inside = distances(x[rows], x[rows])
        free = np.ones(len(rows), bool)
        for i in range(len(rows)):
            if free[i]:
                cover = free & (inside[i] <= radius)
                cover[i] = True
                owner[rows[cover]] = len(centres)
                centres.append(int(rows[i]))
                free &= ~cover
    return np.array(centres, np.int64), owner


class Node:
    __slots__ = ("centre", "radius", "points", "children", "middles", "reach")

    def __init__(self, x: np.ndarray, points: np.ndarray, level: float):
        """A node over ``points``; the first is its centre, ``level`` its level's radius."""
        self.centre, self.points, self.children = int(points[0]), points, []
        away = distances(x[points], x[self.centre : self.centre + 1])[:, 0]
        self.radius = float(away.max())
        if len(points) <= LEAF or self.radius <= SLACK:
            return
        while level / 2 >= self.radius:
            level /= 2
        centres, owner = net(x[points], level / 2)
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        for n, centre in enumerate(centres):
            own = points[order[cuts[n] : cuts[n + 1]]]
            own = np.concatenate(([points[centre]], own[own != points[centre]]))
            self.children.append(Node(x, own, level / 2))
        self.middles = x[[c.centre for c in self.children]]
        self.reach = np.array([c.radius for c in self.children])


def dual_pairs(a: Node, x: np.ndarray, b: Node, y: np.ndarray, cosine: float):
    """Arrays (i, j) of all pairs of rows of x and y with at least that cosine."""
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    left, right, stack = [], [], [(a, b)]

    def leaves(p: np.ndarray, q: np.ndarray) -> None:
        i, j = np.nonzero(x[p] @ y[q].T >= cosine)
        left.append(p[i])
        right.append(q[j])

    while stack:
        u, v = stack.pop()
        if not u.children and not v.children:
            if len(u.points) * len(v.points) <= 1 << 20:
                leaves(u.points, v.points)
            else:  # equal directions beyond a leaf
                for s in range(0, len(u.points), 512):
                    leaves(u.points[s : s + 512], v.points)
            continue
        us, um, ur = (u.children, u.middles, u.reach) if u.children else ([u], x[[u.centre]], np.array([u.radius]))
        vs, vm, vr = (v.children, v.middles, v.reach) if v.children else ([v], y[[v.centre]], np.array([v.radius]))
        for s in range(0, len(us), 512):
            d = distances(um[s : s + 512], vm)
            for i, j in zip(*np.nonzero(d <= eps + ur[s : s + 512, None] + vr[None, :])):
                stack.append((us[s + i], vs[j]))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _block_links(cosine: float):
    """Work on one block: homes against visitors."""

    def links(table: pa.Table) -> pa.Table:
        home = table.filter(pa.compute.field("home"))
        guest = table.filter(~pa.compute.field("home"))
        out = {"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "n": np.empty(0, np.int64)}
        if len(home) and len(guest):
            x, y = unit(_matrix(home["emb"])), unit(_matrix(guest["emb"]))
            hid, gid = home["id"].to_numpy(), guest["id"].to_numpy()
            trees = [Node(m, np.arange(len(m)), 2.0) for m in (x, y)]
            i, j = dual_pairs(trees[0], x, trees[1], y, cosine)
            if table["hb"][0].as_py() == table["vc"][0].as_py():  # a block against itself
                ok = hid[i] < gid[j]
                i, j = i[ok], j[ok]
            if len(i):
                n_home, n_guest = home["mult"].to_numpy(), guest["mult"].to_numpy()
                ids, place = np.unique(np.concatenate((hid[i], gid[j])), return_inverse=True)
                a, b = place[: len(i)], place[len(i) :]
                n = np.bincount(a, n_guest[j], len(ids)) + np.bincount(b, n_home[i], len(ids))
                root = _joined(np.arange(len(ids)), a, b)
                out = {"a": ids, "b": ids[root], "n": np.rint(n).astype(np.int64)}
        return pa.table(out)

    return links


def _centres(points: DataFrame, cell_rows: int, max_centres: int) -> dict[str, np.ndarray]:
    """Centres for the groups with more than ``cell_rows`` points, at most ``max_centres``
    in all; from a sample of at most eight rows a centre, drawn by a hash of the id."""
    sizes = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    big = sizes.where(F.col("n") > cell_rows).orderBy(F.col("n").desc(), "grp")
    big = big.limit(max_centres // 2).collect()
    rows = sum(r["n"] for r in big)
    plan = {
        r["grp"]: max(2, min(-(-r["n"] // cell_rows), max_centres * r["n"] // rows)) for r in big
    }
    if not plan:
        return {}
    wanted = points.sparkSession.createDataFrame(
        [(r["grp"], plan[r["grp"]], r["n"]) for r in big], "grp string, k long, n long"
    )
    first = Window.partitionBy("grp").orderBy(F.xxhash64("id", F.lit(3)), "id")
    sample = points.join(F.broadcast(wanted), "grp")
    sample = sample.where(drawn(F.col("id"), 8 * F.col("k"), F.col("n")))
    sample = sample.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= 8 * F.col("k"))
    out: dict[str, list] = {}
    for r in sample.orderBy("grp", "rn").select("grp", "emb").collect():
        out.setdefault(r["grp"], []).append(r["emb"])
    centres = {}
    for grp, rows in out.items():
        x, radius, chosen = unit(np.array(rows)), 2.0, np.array([0])
        while len(chosen) < plan[grp] and radius > 1e-3:
            radius /= 2
            chosen, _ = net(x, radius)
        centres[grp] = x[chosen[: plan[grp]]]
    return centres


def near_pairs(
    points: DataFrame,
    cosine: float,
    block_rows: int = BLOCK_ROWS,
    cell_rows: int = CELL_ROWS,
    max_centres: int = MAX_CENTRES,
) -> DataFrame:
    """(a, b, n) from distinct points (grp, id, mult, emb): ``n`` linked vectors found for
    ``a`` in one block, and ``b`` the smallest point it is connected to there."""
    spark = points.sparkSession
    eps = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    centres = spark.sparkContext.broadcast(_centres(points, cell_rows, max_centres))

    @F.arrow_udf("cell int, away double")
    def settle(groups: pa.Array, embs: pa.Array) -> pa.Array:
        known, cell, away = centres.value, [], []
        for grp, emb in zip(groups.to_pylist(), embs):
            if grp in known:
                d = distances(unit(emb.values.to_numpy()[None, :]), known[grp])[0]
                cell.append(int(d.argmin()))
                away.append(float(d.min()))
            else:
                cell.append(0)
                away.append(0.0)
        return pa.StructArray.from_arrays(
            [pa.array(cell, pa.int32()), pa.array(away, pa.float64())], ["cell", "away"]
        )

    if centres.value:
        placed = points.withColumn("at", settle("grp", "emb")).select(
            "grp", "id", "mult", "emb", "at.cell", "at.away"
        )
        placed = materialize(placed, "cells")
        reach = {}
        wide = placed.where(F.col("grp").isin(list(centres.value)))
        for r in wide.groupBy("grp", "cell").agg(F.max("away").alias("r")).collect():
            reach[r["grp"], r["cell"]] = r["r"]
        radii = spark.sparkContext.broadcast(reach)

        @F.arrow_udf("array<int>")
        def visits(groups: pa.Array, embs: pa.Array, cells: pa.Array) -> pa.Array:
            out, between = [], {}
            for grp, emb, cell in zip(groups.to_pylist(), embs, cells.to_pylist()):
                found = [cell]
                if grp in centres.value:
                    c = centres.value[grp]
                    if grp not in between:
                        r = [radii.value.get((grp, k), -np.inf) for k in range(len(c))]
                        between[grp] = distances(c, c), np.array(r)
                    gaps, r = between[grp]
                    d = distances(unit(emb.values.to_numpy()[None, :]), c)[0]
                    later = np.arange(len(c)) > cell
                    with np.errstate(divide="ignore", invalid="ignore"):
                        side = (d**2 - d[cell] ** 2) / (2 * gaps[cell])
                    near = later & (d <= r + eps) & (np.nan_to_num(side, nan=0.0) <= eps)
                    found += np.flatnonzero(near).tolist()
                out.append(found)
            return pa.array(out, pa.list_(pa.int32()))

        guests = placed.withColumn("to", F.explode(visits("grp", "emb", "cell")))
    else:
        placed = points.withColumn("cell", F.lit(0))
        guests = placed.withColumn("to", F.lit(0))
    guests = guests.select(
        "grp", F.col("to").alias("cell"), (F.col("to") == F.col("cell")).alias("own"), "id", "mult", "emb"
    )
    parts = lambda n: F.ceil(F.col(n) / block_rows).cast("int")
    is_own = F.col("own").cast("long")
    counted = (
        guests.groupBy("grp", "cell")
        .agg(F.sum(is_own).alias("homes"), F.sum(1 - is_own).alias("others"))
        .select("grp", "cell", parts("homes").alias("nb"), parts("others").alias("nv"))
    )
    counted = materialize(counted.where("nb > 0"), "blocks")
    slot = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), F.col(n)).cast("int")
    spread = lambda a, b: F.explode(F.sequence(a, b))
    # blocks 0 to nb - 1 are the points of the cell, those from nb on its visitors; a block of
    # the cell meets itself, the later ones and all visitors, so each pair is looked at once
    last = F.col("nb") - 1
    keys, facts = ["grp", "cell", "hb", "vc"], ["id", "mult", "emb"]
    homes = placed.join(counted, ["grp", "cell"]).withColumn("hb", slot("nb"))
    homes = homes.withColumn("vc", spread(F.col("hb"), last + F.col("nv")))
    seen = guests.join(counted, ["grp", "cell"])
    seen = seen.withColumn("vc", F.when(F.col("own"), slot("nb")).otherwise(F.col("nb") + slot("nv")))
    seen = seen.withColumn("hb", spread(F.lit(0), F.least("vc", last)))
    rows = homes.select(*keys, F.lit(True).alias("home"), *facts).union(
        seen.select(*keys, F.lit(False).alias("home"), *facts)
    )
    return rows.groupBy(*keys).applyInArrow(_block_links(cosine), "a long, b long, n long")


def classes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    **sizes,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors of one label and length are compared; null labels, null and empty vectors, and
    vectors that are zero or hold null or non-finite components link with nothing and are
    classes of their own. Repeated rows are vectors of their own. A null id is never the
    smallest id of a class, and is never kept; a class of null ids alone has a null
    component. No rows: no rows.
    """
    emb = F.transform(F.col("v").cast("array<double>"), lambda c: c + F.lit(0.0))  # -0.0 to 0.0
    usable = (
        F.col("label").isNotNull()
        & F.forall("emb", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
        & F.exists("emb", lambda c: c != 0)
    )
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")
    ).withColumn("emb", emb)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn(
        "grp", F.when(F.col("ok"), F.concat_ws(":", F.size("emb").cast("string"), "label"))
    )
    rows = rows.withColumn("h1", F.when(F.col("ok"), F.xxhash64("emb")))
    rows = rows.withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit("emb"), "emb")))
    points = rows.where("ok").groupBy("grp", "h1", "h2", "emb").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("mult")
    )
    # numbers of the stored rows tell points apart, whatever their ids
    points = materialize(points.withColumn("id", F.monotonically_increasing_id()), "points")
    found = near_pairs(points.select("grp", "id", "mult", "emb"), cosine, **sizes)
    found = materialize(found, "vector-links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(found.where("a <> b").select("a", "b"))
    linked = points.join(roots, points["id"] == roots["node"]).select("id", "first", "root")
    linked = materialize(linked, "linked-points")
    low = linked.groupBy("root").agg(F.min("first").alias("low"), F.count(F.lit(1)).alias("n"))
    low = join_facts(linked, materialize(low, "class-ids"), "root").select(F.col("id").alias("l_id"), "low")
    facts = (
        points.select("grp", "h1", "h2", "id", "first", "mult")
        .join(counts, F.col("id") == F.col("a"), "left")
        .join(low, F.col("id") == F.col("l_id"), "left")
        .select(
            F.col("grp").alias("f_grp"),
            F.col("h1").alias("f_h1"),
            F.col("h2").alias("f_h2"),
            (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("links"),
            F.when(F.col("l_id").isNull(), F.col("first")).otherwise(F.col("low")).alias("low"),
        )
    )
    same = [F.col(k) == F.col(f"f_{k}") for k in ("grp", "h1", "h2")]
    out = rows.select("id", "grp", "h1", "h2").join(facts, same, "left")
    component = F.when(F.col("f_h1").isNull(), F.col("id")).otherwise(F.col("low"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
