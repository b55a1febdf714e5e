"""Best-fit packing of documents into sequences under several capacities.

A piece of a document is a vector (tokens, one document, attention cost = tokens squared),
and a sequence has a residual capacity in each. Pieces come longest first; each goes to the
open sequence that it fits under every constraint and that keeps the least weighted
residual norm. Pieces of one length are the same vector, and sequences that hold the same
pieces have the same residual, so the choice is made for whole ranges of equal sequences
and counts of equal pieces: the plan needs the number of pieces by length and nothing else,
and its size depends on the capacities, not on the corpus. Tasks then look up the place of
the r-th piece of a length.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import materialize
from assayline.llm.tokens import default_tokenizer
from assayline.operators.scale import broadcast_if_small

END_ID = 2
#: Anything but printable ASCII, tab, line ends, Latin letters and a few marks; the start of
#: a special string; white space too long for the faster library.
ODD = re.compile("[^\t\n\r -~¡¿À-ÖØ-öø-ɏ–—‘’“”…]")
LONG_SPACE = re.compile("[ \t\n\r]{256}")
RANK_BITS = 44


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds at most; ``None`` leaves a dimension unbounded. ``weights``
    are those of tokens, documents and attention cost in the residual norm."""

    tokens: int = 1024
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1 / 64, 1 / 64)

    def limits(self) -> np.ndarray:
        top = self.tokens
        return np.array([top, min(self.documents or top, top), self.attention or top * top])


@dataclass(frozen=True)
class Plan:
    """Places by (length, first rank): from there on every ``per`` pieces of the length go
    to one sequence, beginning with sequence ``first`` at ``offset``."""

    key: np.ndarray
    first: np.ndarray
    per: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << RANK_BITS) | rank
        at = np.searchsorted(self.key, key, side="right") - 1
        nth = key - self.key[at]
        return self.first[at] + nth // self.per[at], self.offset[at] + nth % self.per[at] * length


def best_fit(counts: Mapping[int, int], capacity: Capacity) -> Plan:
    """Plan for ``counts`` pieces by length, longest first.

    A sequence that takes a piece has a smaller residual norm than before, so the next equal
    piece goes to the same one while it fits; then to the next sequence of the range, then
    to the range of the next larger norm, and at last to new sequences. Ties go to the
    sequence opened first. Raises if one piece alone breaks a capacity.
    """
    limits = capacity.limits()
    weights = np.array(capacity.weights) / limits.astype(float) ** 2
    starts, sizes, rests = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    opened, places = 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        piece = np.array([length, 1, length * length])
        if (piece > limits).any():
            raise ValueError(f"a piece of {length} tokens breaks a capacity")
        per = (rests // piece).min(axis=1)
        able = np.flatnonzero(per)
        norm = ((rests[able] - piece) ** 2 * weights).sum(axis=1)
        added: list[tuple[int, int, np.ndarray]] = []

        def fill(start: int, size: int, rest: np.ndarray, fits: int) -> None:
            """Put pieces into the range; its parts go to ``added``."""
            nonlocal left, rank
            full = min(size, left // fits)
            parts = [(full, fits), (int(full < size), left % fits if full < size else 0)]
            for n, each in parts:
                if n and each:
                    places.append((length, rank, start, each, int(limits[0] - rest[0])))
                    rank, left = rank + n * each, left - n * each
                    added.append((start, n, rest - each * piece))
                    start, size = start + n, size - n
            if size:
                added.append((start, size, rest))

        touched = []
        for i in able[np.lexsort((starts[able], norm))]:
            if not left:
                break
            touched.append(i)
            fill(int(starts[i]), int(sizes[i]), rests[i], int(per[i]))
        if left:
            fits = int((limits // piece).min())
            new = -(-left // fits)
            fill(opened, new, limits, fits)
            opened += new
        keep = np.ones(len(starts), bool)
        keep[touched] = False
        starts = np.concatenate([starts[keep], [a[0] for a in added]]).astype(np.int64)
        sizes = np.concatenate([sizes[keep], [a[1] for a in added]]).astype(np.int64)
        rests = np.concatenate([rests[keep], *[a[2][None] for a in added]]).astype(np.int64)
        usable = rests.min(axis=1) > 0
        starts, sizes, rests = starts[usable], sizes[usable], rests[usable]
    rows = np.array(places, np.int64).reshape(-1, 5)
    key = (rows[:, 0] << RANK_BITS) | rows[:, 1]
    order = np.argsort(key)
    return Plan(key[order], *(rows[order, i] for i in (2, 3, 4)), opened)


def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """Ids of texts as ``tokenizers`` gives them for ``path``, no special tokens added.

    Where the ranks of the same vocabulary lie beside the file, texts of plain letters and
    marks go through ``tiktoken``, which gives the same ids in a quarter of the time.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def plain(texts: list[str]) -> list[list[int]]:
        return [x.ids for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return plain
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}
    )

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            plain([t])[0]
            if ODD.search(t) or "<|" in t or LONG_SPACE.search(t)
            else fast.encode_ordinary(t)
            for t in texts
        ]

    return encode


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: int = 1024,
    path: str | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth[, ids]) of every document, stored.

    A document is its ids and then id 2; one longer than ``tokens`` is cut into pieces of
    ``tokens``, of which the first may be shorter. ``part`` is the task that wrote the row and
    ``nth`` counts the pieces of that length in it, so ranks need no sort.
    """
    file = path or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"
    fields += ", ids array<int>" if keep_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(file)
        part = TaskContext.get().partitionId()
        seen = np.zeros(tokens + 1, np.int64)
        for batch in batches:
            at, piece, start, length, crc, nth, kept = ([] for _ in range(7))
            for i, text in enumerate(batch.column(1)):
                ids = array("I", encode([text.as_py() or ""])[0])
                ids.append(END_ID)
                raw = memoryview(ids.tobytes())
                first = len(ids) % tokens or tokens
                edges = [0, *range(first, len(ids) + 1, tokens)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    nth.append(int(seen[b - a]))
                    seen[b - a] += 1
                    if keep_ids:
                        kept.append(ids[a:b].tolist())
            cols = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32())]
            cols += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            cols += [pa.array([part] * len(at), pa.int32()), pa.array(nth, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            if keep_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return materialize(rows.mapInArrow(cut, fields), "pieces")


def pack(cut: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """Stored ``pieces`` with ``sequence_id`` and ``offset``.

    The rank of a piece among those of its length is its number in its task after the pieces
    of the tasks before: one row per task and length is summed, pieces are not shuffled
    unless that table passes the limits of a broadcast. The driver gets one row per length.
    """
    spots = materialize(
        cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-lengths"
    )
    counts = {r[0]: r[1] for r in spots.groupBy("length").agg(F.sum("n")).collect()}
    if not counts:
        return cut.select(
            *[c for c in cut.columns if c not in ("part", "nth")],
            F.lit(0).cast("long").alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        )
    plan = best_fit(counts, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = spots.select(
        "part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    before = broadcast_if_small(materialize(before, "ranks"))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        at = plan.place(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x) for x in at], ["sequence_id", "offset"])

    rows = cut.join(before, ["part", "length"])
    rows = rows.withColumn("_at", place("length", F.col("before") + F.col("nth")))
    out = [F.col(c) for c in cut.columns if c not in ("part", "nth")]
    return rows.select(*out, "_at.sequence_id", "_at.offset")


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: Capacity = Capacity(),
    path: str | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece.

    Null and empty texts are the one id 2. Null and repeated ids pass through: every row is
    a document of its own. No rows: no rows. Other columns are not looked at. A text is
    encoded whole, so the longest text has to fit a task; its pieces may go to different
    sequences. Sequences are filled without gaps from offset 0.
    """
    cut = pieces(docs, id_col, text_col, capacity.tokens, path, keep_ids)
    return pack(cut, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, ends): the token ids of every sequence and where its pieces end, from
    pieces packed with ``keep_ids``; a group holds at most the tokens of one sequence."""
    held = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id",
        F.flatten(F.col("held.ids")).alias("ids"),
        F.transform("held", lambda x: x["offset"] + F.size(x["ids"])).alias("ends"),
    )
