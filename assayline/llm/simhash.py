"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints within ``MAX_BITS`` differing bits are linked. The index is a hierarchy of
nodes, each holding the bits its fingerprints share (mask and pattern). On top, the 64
bits are cut into five blocks; two of them must be equal in every linked pair, so each
fingerprint goes to ten nodes whose mask is a pair of blocks. A node with more than
``NODE_ROWS`` fingerprints is factored further: the bits it leaves open are cut into four
blocks, one of which must be equal, and its fingerprints move to the longer masks, until
a node is small; with 12 open bits it cannot be large. In a small node the fingerprints
are sorted by Gray rank, runs of neighbours are grouped under the bits they share, level
by level, and the search goes down adding up the differences on newly shared bits,
dropping a whole group as soon as the sum exceeds the limit. Links are followed inside a
node and leave it as a star, so a node never gives more rows than it has fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import components, join_facts, materialize

MAX_BITS = 3
SHINGLE = 3
NODE_ROWS = 4096
FANOUT = 8
WORDS_AT_ONCE = 1 << 16


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 of all word shingles; 0 without words.

    Words are taken a block at a time, so a very long text needs little memory beside it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    n, sums, hashed = len(words) - shingle + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE + shingle - 1]
        line = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        starts = [0, *ends[: len(part) - shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        h = np.array([hashed(line[a:b], 42) for a, b in zip(starts, stops)], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column as a signed 64-bit number."""

    @F.arrow_udf("long")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            codes = [fingerprint_of(t.as_py()) for t in batch]
            yield pa.array(np.array(codes, np.uint64).view(np.int64), pa.int64())

    return found(text)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def open_blocks(mask: int, parts: int) -> list[int]:
    """The bits a mask leaves open, cut into ``parts`` masks of even size."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def linked_within(codes: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """For each code of a node the first code it is connected to, as an index.

    Codes must be distinct and sorted by Gray rank. Groups of ``FANOUT`` neighbours form
    the levels; every level knows the mask and pattern shared below it.
    """
    levels = [(np.full(len(codes), ~np.uint64(0)), codes)]
    while len(levels[-1][0]) > 1:
        mask, pattern = levels[-1]
        starts = np.arange(0, len(mask), FANOUT)
        ones = np.bitwise_and.reduceat(pattern, starts)
        zeros = np.bitwise_or.reduceat(pattern, starts)
        shared = np.bitwise_and.reduceat(mask, starts) & ~(ones ^ zeros)
        levels.append((shared, ones & shared))
    label = np.arange(len(codes))
    for first in range(0, len(codes), 256):
        query = np.arange(first, min(first + 256, len(codes)))
        top_mask, top_pattern = levels[-1]
        node = np.zeros(len(query), np.int64)
        spent = np.bitwise_count((codes[query] ^ top_pattern[node]) & top_mask[node])
        for level in range(len(levels) - 2, -1, -1):
            near = spent <= limit
            # links are symmetric: groups wholly before the query were its queries once
            near &= (node + 1) * FANOUT ** (level + 1) > query
            query, node, spent = query[near], node[near], spent[near]
            up_mask = levels[level + 1][0]
            mask, pattern = levels[level]
            child = node[:, None] * FANOUT + np.arange(FANOUT)
            real = child < len(mask)
            child, parent = child[real], np.repeat(node, real.sum(axis=1))
            query = np.repeat(query, real.sum(axis=1))
            fresh = mask[child] & ~up_mask[parent]
            spent = np.repeat(spent, real.sum(axis=1)) + np.bitwise_count(
                (codes[query] ^ pattern[child]) & fresh
            )
            node = child
        found = (spent <= limit) & (node > query)
        label = _joined(label, query[found], node[found])
    return label


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the label classes over the pairs (a, b); labels stay smallest indices."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low != high
        if not open_.any():
            return label
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        root = np.arange(len(label))
        np.minimum.at(root, high, low)
        while True:
            after = root[root]
            if (after == root).all():
                break
            root = after
        label = root[label]


def _node_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of links from rows sorted by (mask, pattern); nodes may span batches."""
    held: list[pa.RecordBatch] = []

    def stars(mask, pattern, code):
        same = np.concatenate(([False], (mask[1:] == mask[:-1]) & (pattern[1:] == pattern[:-1])))
        starts = np.append(np.flatnonzero(~same), len(code))
        big = np.flatnonzero(np.diff(starts) > 1)
        ones, others = [], []
        for s, e in zip(starts[big].tolist(), starts[big + 1].tolist()):
            codes = code[s:e]
            codes = codes[np.argsort(gray_rank(codes))]
            if len(codes) == 2:
                label = np.array([0, 0 if int(codes[0] ^ codes[1]).bit_count() <= MAX_BITS else 1])
            else:
                label = linked_within(codes)
            linked = label != np.arange(len(codes))
            ones.append(codes[linked])
            others.append(codes[label[linked]])
        if ones:
            cols = [np.concatenate(x).view(np.int64) for x in (ones, others)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b"])
        return None

    def columns(parts):
        table = pa.Table.from_batches(parts)
        return [
            table[c].to_numpy().view(np.uint64) if c == "code" else table[c].to_numpy()
            for c in ("mask", "pattern", "code")
        ]

    for batch in batches:
        held.append(batch)
        mask, pattern, code = columns(held)
        last = np.flatnonzero((mask != mask[-1]) | (pattern != pattern[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            out = stars(mask[:cut], pattern[:cut], code[:cut])
            if out is not None:
                yield out
            rest = pa.Table.from_batches(held).slice(cut).combine_chunks().to_batches()
            held = rest
    if held:
        out = stars(*columns(held))
        if out is not None:
            yield out


def _in_nodes(rows: DataFrame, masks: list[int]) -> DataFrame:
    """Rows (code) moved to one node for each of the masks."""
    each = [F.lit(_signed(m)) for m in masks]
    return rows.select("code", F.explode(F.array(*each)).alias("mask")).select(
        "mask", F.col("mask").bitwiseAND(F.col("code")).alias("pattern"), "code"
    )


def near_links(codes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct codes within ``MAX_BITS`` bits.

    Nodes are counted with partial aggregation first; those above ``node_rows`` go one
    level down, all others are searched where the shuffle by node puts them.
    """
    blocks = open_blocks(0, 5)
    rows = _in_nodes(codes.select("code"), [a | b for a, b in combinations(blocks, 2)])
    out = None
    while True:
        sizes = rows.groupBy("mask", "pattern").agg(F.count(F.lit(1)).alias("n"))
        heavy = materialize(sizes.where(F.col("n") > node_rows), "heavy-nodes")
        none = heavy.isEmpty()
        light = rows if none else rows.join(heavy, ["mask", "pattern"], "left_anti")
        placed = light.repartition("mask", "pattern").sortWithinPartitions("mask", "pattern")
        links = placed.mapInArrow(_node_links, "a long, b long").distinct()
        out = links if out is None else out.union(links)
        if none:
            return out
        masks = [r["mask"] & (2**64 - 1) for r in heavy.select("mask").distinct().collect()]
        full = rows.join(heavy.drop("n"), ["mask", "pattern"], "left_semi")
        deeper = None
        for mask in masks:  # at most as many as masks exist on this level
            part = full.where(F.col("mask") == _signed(mask)).select("code").distinct()
            part = _in_nodes(part, [mask | b for b in open_blocks(mask, 4) if b])
            deeper = part if deeper is None else deeper.union(part)
        rows = materialize(deeper.distinct(), "deeper-nodes")


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", node_rows: int = NODE_ROWS
) -> DataFrame:
    """(doc_id, mark, code, root, component_id) of every row.

    Equal fingerprints are one node of the link graph, so copies cost nothing beyond
    their own row. ``root`` is the class as its smallest code, ``mark`` a hash of the text.
    ``component_id`` is the smallest id reachable; null ids are never the smallest, and a
    class of null ids alone has a null ``component_id``. Null and empty texts and texts
    without words have fingerprint zero and are linked like any other. Repeated rows fall
    into the same class. No rows: no rows.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", F.xxhash64(text).alias("mark"), fingerprint(text).alias("code"))
    rows = materialize(rows, "codes")
    codes = rows.groupBy("code").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    codes = materialize(codes, "distinct-codes")
    roots = components(near_links(codes, node_rows))
    linked = codes.join(roots, codes["code"] == roots["node"]).select("code", "first", "root")
    linked = materialize(linked, "linked-codes")
    smallest = linked.groupBy("root").agg(F.min("first").alias("low"), F.count(F.lit(1)).alias("n"))
    moved = join_facts(linked, materialize(smallest, "class-ids"), "root").select(
        F.col("code").alias("m_code"), "root", "low"
    )
    alone = F.col("m_code").isNull()
    named = codes.join(moved, F.col("code") == F.col("m_code"), "left").select(
        "code",
        F.coalesce("root", "code").alias("root"),
        F.when(alone, F.col("first")).otherwise(F.col("low")).alias("low"),
        "n",
    )
    return join_facts(rows, materialize(named, "named-codes"), "code").select(
        F.col("id").alias(id_col), "mark", "code", "root", F.col("low").alias("component_id")
    )


def as_hex(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the input columns.

    The row with the smallest id stays, null ids last; of rows that share the id the one
    with the smallest text hash, and of equal rows one.
    """
    found = classes(docs, id_col, text_col).select(
        "root", F.struct(F.col(id_col).isNull().alias("k_null"), F.col(id_col).alias("k_id"), "mark").alias("key")
    )
    best = found.groupBy("root").agg(F.min("key").alias("key"))
    best = best.select(
        "key.k_null", F.coalesce("key.k_id", F.lit(0)).alias("k_id"), F.col("key.mark").alias("k_mark")
    )
    row_id = F.col(f"row.`{id_col}`")
    packed = docs.select(F.struct("*").alias("row")).select(
        "row",
        row_id.isNull().alias("k_null"),
        F.coalesce(row_id, F.lit(0)).alias("k_id"),
        F.xxhash64(f"row.`{text_col}`").alias("k_mark"),
    )
    keys = ["k_null", "k_id", "k_mark"]
    kept = packed.join(best, keys, "left_semi")
    again = Window.partitionBy(*keys).orderBy(F.xxhash64("row"))
    return kept.withColumn("k", F.row_number().over(again)).where("k = 1").select("row.*")
