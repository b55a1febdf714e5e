"""Repeated byte strings: Burrows-Wheeler transforms of shards merged by refinement.

A string of ``REACH`` bytes that also starts earlier is removed; matches stay inside a
document. Three steps find them without sorting all suffixes of the corpus:

1. Every document is cut into runs of windows that share an anchor (``anchors``). Runs are
   brought together by anchor. An anchor seen once has no repeats. Of runs with equal
   content only the first stays, the others are removed whole; within a batch of
   documents that is settled before the shuffle.
2. What is left are runs that share an anchor but not all bytes. Their texts are gathered by
   anchor into shards; each shard has its own Burrows-Wheeler transform. The transforms
   are merged by refining their interleave one symbol at a time: in round k the suffixes
   of all shards are in order of k symbols, and the places where neighbours part give the
   common prefixes. Suffixes that have parted from all others leave the merge. After
   ``REACH`` rounds the intervals still open are the repeated windows.
3. An anchor with too many different runs for one task is resolved by grouping its windows
   themselves, with partial aggregation.

Texts travel between the steps compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.anchors import REACH, owned_windows
from assayline.llm.common import materialize

SIZE_BITS = 7
HEAVY_RUNS = 20_000
SHARD_BYTES = 1 << 16
GROUP_BYTES = 1 << 21
NO_ID = (1 << 63) - 1
SETTLED = np.int64(-(1 << 63))


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, text): null ids last in order, the text's 64-bit hash.

    A document is its (id, mark): different texts that share an id stay apart.
    """
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.xxhash64(text_col).alias("mark"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = [pack(t.as_buffer()) for t in batch["text"]]
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["mark"], pa.array(texts, pa.binary())], ["id", "mark", "z"]
        )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, g, id, pos, mark) of each run; pos packs start and windows.

    Of equal runs in a batch all but the first are settled here: they carry the sign bit
    and need not meet the others, so a hot run gives each batch one row for its anchor.
    """
    for batch in batches:
        out = []
        for i, mark, text in zip(batch["id"].to_pylist(), batch["mark"].to_pylist(), batch["text"]):
            start, size, anchor, content = owned_windows(text.as_buffer().to_pybytes())
            if len(start):
                same = [np.full(len(start), v) for v in (i, mark)]
                pos = start << SIZE_BITS | size
                out.append((anchor.view(np.int64), content.view(np.int64), same[0], pos, same[1]))
        if out:
            h, g, i, pos, mark = (np.concatenate(c) for c in zip(*out))
            order = np.lexsort((mark, pos, i, g, h))
            h, g, i, pos, mark = (c[order] for c in (h, g, i, pos, mark))
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
            head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            late = (i != i[head]) | (pos != pos[head]) | (mark != mark[head])
            pos = np.where(late, pos | SETTLED, pos)
            cols = [pa.array(c) for c in (h, g, i, pos, mark)]
            yield pa.RecordBatch.from_arrays(cols, ["h", "g", "id", "pos", "mark"])


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h, g, id, pos, mark): runs to remove, and first runs of an anchor
    that has several contents. One row is carried from batch to batch."""
    carry = None  # last content's first run, and whether its anchor had one before

    def rows(h, gone, *run):
        cols = [pa.array(c) for c in (h, gone, *run)]
        return pa.RecordBatch.from_arrays(cols, ["h", "gone", "id", "pos", "mark"])

    for batch in batches:
        cols = [batch[c].to_numpy() for c in ("h", "g", "id", "pos", "mark")]
        settled = cols[3] < 0
        if settled.any():
            h, _, i, pos, mark = (c[settled] for c in cols)
            yield rows(h, np.full(len(h), True), i, pos ^ SETTLED, mark)
            cols = [c[~settled] for c in cols]
            if not len(cols[0]):
                continue
        before = False
        if carry is not None:
            cols = [np.concatenate(([c], col)) for c, col in zip(carry[0], cols)]
            before = carry[1]
        h, g, i, pos, mark = cols
        fresh_h = np.concatenate(([True], h[1:] != h[:-1]))
        fresh = fresh_h | np.concatenate(([True], g[1:] != g[:-1]))
        heads = np.flatnonzero(fresh)
        head = heads[np.cumsum(fresh) - 1]
        # an equal row is the same run
        gone = (i != i[head]) | (pos != pos[head]) | (mark != mark[head])
        follows = ~fresh_h[heads]
        follows[0] |= before
        leads = np.append(~fresh_h[heads[1:]], False)
        edge = heads[:-1][(follows | leads)[:-1]]
        carry = ([c[heads[-1]] for c in cols], bool(follows[-1]))
        for at, flag in ((np.flatnonzero(gone), True), (edge, False)):
            if len(at):
                yield rows(h[at], np.full(len(at), flag), i[at], pos[at], mark[at])
    if carry is not None and carry[1]:
        yield rows(*[np.array([c]) for c in (carry[0][0], False, *carry[0][2:])])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the open runs of each document."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        keys = zip(batch["id"].to_pylist(), batch["mark"].to_pylist())
        for (i, mark), z, spans in zip(keys, batch["z"], batch["spans"].to_pylist()):
            raw = unpack.decompress(z.as_buffer())
            for s in spans:
                start, size = s["pos"] >> SIZE_BITS, s["pos"] & ((1 << SIZE_BITS) - 1)
                seg = raw[start : start + size + REACH - 1]
                for col, v in zip(out, (s["h"], i, s["pos"], mark, seg)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(out, (*[pa.int64()] * 4, pa.binary()))],
            ["h", "id", "pos", "mark", "seg"],
        )


def sorted_suffixes(text: np.ndarray) -> np.ndarray:
    """Suffix order of a shard by doubling; symbol 0 ends a segment and is never equal."""
    n = len(text)
    rank = text.astype(np.int64)
    ends = np.flatnonzero(text == 0)
    rank = np.where(text == 0, 0, rank + len(ends))
    rank[ends] = np.arange(len(ends))
    width = 1
    while width < REACH:
        second = np.zeros(n, np.int64)
        second[:-width] = rank[width:] + 1
        key = rank * (rank.max() + 2) + second
        order = np.argsort(key, kind="stable")
        step = np.concatenate(([0], (np.diff(key[order]) != 0).cumsum()))
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            break
        width *= 2
    return np.argsort(rank, kind="stable")


def merged_intervals(shards: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(interval, place) arrays: places in the joined shards of all suffixes whose first
    ``REACH`` symbols occur more than once. Every shard is segments, each ended by 0."""
    bwt, lf, suffix, base = [], [], [], 0
    for text in shards:
        order = sorted_suffixes(text)
        last = text[order - 1]  # a segment's end stands before the first of its shard
        back = np.empty(len(text), np.int64)
        back[np.argsort(last, kind="stable")] = np.arange(len(text))
        bwt.append(last)
        lf.append(back + base)
        suffix.append(order + base)
        base += len(text)
    bwt, lf, suffix = map(np.concatenate, (bwt, lf, suffix))
    at = np.arange(base)  # the interleave: all of shard 1, then all of shard 2, ...
    block = np.zeros(base, np.int64)
    for _ in range(REACH):
        c = bwt[at]
        order = np.argsort(c, kind="stable")
        order = order[np.searchsorted(c[order], 1) :]  # ends of segments equal nothing
        c, at, block = c[order], lf[at[order]], block[order]
        if len(at) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        part = np.concatenate(([True], (c[1:] != c[:-1]) | (block[1:] != block[:-1])))
        alone = part & np.append(part[1:], True)
        at, block = at[~alone], np.cumsum(part)[~alone]
    return block, suffix[at]


def repeated_runs(
    segs: list[bytes], ids: np.ndarray, pos: np.ndarray, marks: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every window that is not the first of its kind."""
    shards, starts, shard, size, place = [], [], [], 0, 0
    for seg in segs:
        starts.append(place)
        shard.append(np.frombuffer(seg, np.uint8).astype(np.int16) + 1)
        shard.append(np.zeros(1, np.int16))
        size += len(seg) + 1
        place += len(seg) + 1
        if size >= SHARD_BYTES:
            shards.append(np.concatenate(shard))
            shard, size = [], 0
    if shard:
        shards.append(np.concatenate(shard))
    block, where = merged_intervals(shards)
    if not len(block):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.array(starts)
    seg = np.searchsorted(starts, where, side="right") - 1
    off = where - starts[seg]
    first, mark = (pos[seg] >> SIZE_BITS) + off, marks[seg]
    order = np.lexsort((mark, first, ids[seg], block))
    block, seg, off, first, mark = (x[order] for x in (block, seg, off, first, mark))
    heads = np.concatenate(([True], block[1:] != block[:-1]))
    head = np.flatnonzero(heads)[np.cumsum(heads) - 1]
    late = (ids[seg] != ids[seg[head]]) | (first != first[head]) | (mark != mark[head])
    return seg[late], off[late]


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows to remove, as runs (id, pos, mark), from segments sorted by anchor."""

    def resolve(parts):
        table = pa.Table.from_batches(parts)
        ids, pos, marks = (table[c].to_numpy() for c in ("id", "pos", "mark"))
        segs = [s.as_py() for s in table["seg"].combine_chunks()]
        seg, off = repeated_runs(segs, ids, pos, marks)
        order = np.lexsort((off, seg))
        seg, off = seg[order], off[order]
        if not len(seg):
            return None
        cut = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (off[1:] != off[:-1] + 1))))
        size = np.diff(np.append(cut, len(seg)))
        seg, off = seg[cut], off[cut]
        out = ((pos[seg] >> SIZE_BITS) + off) << SIZE_BITS | size
        cols = [pa.array(c) for c in (ids[seg], out, marks[seg])]
        return pa.RecordBatch.from_arrays(cols, ["id", "pos", "mark"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < GROUP_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        h = table["h"].to_numpy()
        last = np.flatnonzero(h != h[-1])
        if len(last):  # whole anchors only
            cut = int(last[-1]) + 1
            out = resolve(table.slice(0, cut).to_batches())
            if out is not None:
                yield out
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        out = resolve(held)
        if out is not None:
            yield out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of a heavy anchor's segment by its 128-bit hash."""
    digest = xxhash.xxh3_128_intdigest
    for batch in batches:
        keys = zip(*[batch[c].to_pylist() for c in ("id", "pos", "mark")])
        for (i, pos, mark), seg in zip(keys, batch["seg"]):
            raw, start = seg.as_py(), pos >> SIZE_BITS
            n = len(raw) - REACH + 1
            both = [digest(raw[s : s + REACH]) for s in range(n)]
            cols = [
                np.array([b & (2**64 - 1) for b in both], np.uint64).view(np.int64),
                np.array([b >> 64 for b in both], np.uint64).view(np.int64),
                np.full(n, i),
                np.arange(start, start + n) << SIZE_BITS | 1,
                np.full(n, mark),
            ]
            names = ["w1", "w2", "id", "pos", "mark"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)


def _late_windows(segments: DataFrame) -> DataFrame:
    rows = segments.mapInArrow(_windows, "w1 long, w2 long, id long, pos long, mark long")
    run = F.struct("id", "pos", "mark")
    first = rows.groupBy("w1", "w2").agg(F.min(run).alias("first"))
    both = rows.join(first, ["w1", "w2"])
    return both.where(run != F.col("first")).select("id", "pos", "mark")


def repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_runs: int = HEAVY_RUNS
) -> DataFrame:
    """(id, pos, mark) of runs of repeated windows: ``pos`` packs start and windows."""
    packed = _packed(docs, id_col, text_col)
    runs = packed.mapInArrow(_runs, "h long, g long, id long, pos long, mark long")
    meet = F.when(F.col("pos") < 0, F.xxhash64("id", "pos", "mark")).otherwise(F.col("h"))
    runs = runs.repartition(meet).sortWithinPartitions("h", "g", "id", "pos", "mark")
    found = materialize(
        runs.mapInArrow(_classified, "h long, gone boolean, id long, pos long, mark long"), "runs"
    )
    gone = found.where("gone").select("id", "pos", "mark")
    edges = found.where("NOT gone")
    wanted = edges.groupBy("id", "mark").agg(F.collect_list(F.struct("h", "pos")).alias("spans"))
    texts = packed.where(F.octet_length("text") >= REACH).mapInArrow(
        _compressed, "id long, mark long, z binary"
    )
    segments = texts.join(wanted, ["id", "mark"]).mapInArrow(
        _segments, "h long, id long, pos long, mark long, seg binary"
    )
    sizes = edges.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    heavy = materialize(sizes.where(F.col("n") > heavy_runs).select("h"), "heavy-anchors")
    none = heavy.isEmpty()
    light = segments if none else segments.join(heavy, "h", "left_anti")
    light = light.repartition("h").sortWithinPartitions("h", "id", "pos", "mark")
    late = light.mapInArrow(_resolved, "id long, pos long, mark long")
    if not none:
        late = late.union(_late_windows(segments.join(heavy, "h", "left_semi")))
    return gone.union(late)


def _cut(raw: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """(kept bytes, bytes removed, maximal removed runs)."""
    spans = np.sort(spans)
    start, size = spans >> SIZE_BITS, spans & ((1 << SIZE_BITS) - 1)
    end = start + size + REACH - 1
    reach = np.maximum.accumulate(end)
    cut = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    starts, ends = start[cut].tolist(), reach[np.append(cut[1:], len(start)) - 1].tolist()
    parts, done, gone = [], 0, 0
    for a, b in zip(starts, ends):
        parts.append(raw[done:a])
        gone += b - a
        done = b
    return b"".join([*parts, raw[done:]]), gone, len(starts)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for z, spans in zip(batch["z"], batch["spans"]):
            raw = unpack.decompress(z.as_buffer())
            if spans.is_valid:
                kept, gone, runs = _cut(raw, spans.values.to_numpy())
                rows.append((len(raw), gone, runs, kept))
            else:
                rows.append((len(raw), 0, 0, raw))
        ids = pa.array([None if i == NO_ID else i for i in batch["id"].to_pylist()], pa.int64())
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([ids, *cols], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_runs: int = HEAVY_RUNS
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the bytes left.

    Removed is each byte covered by a string of ``REACH`` bytes that also starts earlier:
    at a smaller id, or in the same document at an earlier start. Null ids come last; of
    different texts with one id the earlier start comes first, then a hash of the text;
    rows equal in id and in the 64-bit hash of the text are one document and get the same
    result. Null and empty texts count as 0 bytes. Very long texts are hashed in blocks. No rows: no rows.
    """
    spans = repeats(docs, id_col, text_col, heavy_runs)
    by_doc = spans.groupBy("id", "mark").agg(F.collect_set("pos").alias("spans"))
    texts = _packed(docs, id_col, text_col).mapInArrow(_compressed, "id long, mark long, z binary")
    rows = texts.join(by_doc, ["id", "mark"], "left").select("id", "z", "spans")
    return rows.mapInArrow(
        _finished, "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
