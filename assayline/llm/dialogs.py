"""Conversation repair by weighted interval parsing.

The grammar of the repaired roles, ``(s?(ua)+)?``, is right-linear; with a nonterminal N(p, q)
for "leads from state p to state q" it is in Chomsky normal form: N(p, q) -> N(p, r) N(r, q),
and N(p, q) -> one row under one edit. Every cell of a span holds, per nonterminal, the least
(cost, audit); the cells of single rows are closed under insertions on both sides. Spans are
combined bottom-up by length. Each derivation crosses every split point in some state, so all
splits of a span give the same minimum, and one split per span is enough: the cells of n rows
need n - 1 combinations, and the spans of one conversation can lie in many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from assayline.llm.common import materialize
from assayline.operators.scale import broadcast_if_small, ranked

#: States: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, ACCEPTING = range(4), (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letters of an edit path in the order of the audit letters D, I, K, R: delete, insert user,
#: insert assistant, keep, rerole to user, rerole to assistant. Paths from one state that
#: agree up to a place are in one state there, so they sort as their audits do.
INSERTS, REROLES = {"u": "H", "a": "I"}, {"u": "R", "a": "S"}
#: Rows as one letter: role initial s, u, a or x for another one, in upper case if truncated;
#: d for a row that has to go.
MUST_GO = "d"
BLOCK_ROWS, FAN = 512, 64
BLANK = r"\x20\x09-\x0D"

Cell = dict[tuple[int, int], tuple[int, str]]


def join_cells(left: Cell, right: Cell) -> Cell:
    """Cells of two neighbouring spans as the cells of their union."""
    out: Cell = {}
    for (p, r), (cost, path) in left.items():
        for q in STATES:
            if (r, q) in right:
                more, rest = right[r, q]
                new = (cost + more, path + rest)
                if (p, q) not in out or new < out[p, q]:
                    out[p, q] = new
    return out


def insertions() -> Cell:
    """Cells of the empty span: the cheapest insertions from state to state."""
    cells: Cell = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, role), q in STEPS.items():
            if role in INSERTS:
                for start in STATES:
                    if (start, p) in cells:
                        cost, path = cells[start, p]
                        new = (cost + INSERT, path + INSERTS[role])
                        if (start, q) not in cells or new < cells[start, q]:
                            cells[start, q] = new
    return cells


EMPTY = insertions()


@lru_cache(maxsize=100_000)
def short_span(rows: str) -> Cell:
    """Cells of a span of few rows; equal spans are parsed once."""
    if len(rows) > 1:
        half = 1 << (len(rows) - 1).bit_length() - 1
        return join_cells(short_span(rows[:half]), short_span(rows[half:]))
    edits: Cell = {(p, p): (DELETE, "D") for p in STATES}
    more = TRUNCATED if rows.isupper() else 0
    if rows != MUST_GO:
        for (p, role), q in STEPS.items():
            if role in REROLES:
                edits[p, q] = (REROLE + more, REROLES[role])
            if role == rows.lower():
                edits[p, q] = (KEEP + more, "K")
    return join_cells(join_cells(EMPTY, edits), EMPTY)


def combine(spans: Sequence[Cell]) -> Cell:
    """Cells of neighbouring spans, joined pair by pair until one is left."""
    spans = list(spans) or [EMPTY]
    while len(spans) > 1:
        pairs = [join_cells(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[2 * len(pairs) :]
    return spans[0]


def parse(rows: str) -> Cell:
    """Cells of all rows: short spans of 8 rows, then by doubled length."""
    return combine([short_span(rows[i : i + 8]) for i in range(0, len(rows), 8)])


def cheapest(cells: Cell) -> tuple[int, str]:
    return min(cells[0, q] for q in ACCEPTING if (0, q) in cells)


_CELLS = pa.list_(
    pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("path", pa.string())])
)
_PATHS = pa.struct([("cost", pa.int64()), ("paths", pa.list_(pa.string()))])
CELLS, PATHS = from_arrow_type(_CELLS), from_arrow_type(_PATHS)


def _pack(cells: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "path": s} for (p, q), (c, s) in cells.items()]


def _unpack(cells: list[dict]) -> Cell:
    return {(c["p"], c["q"]): (c["cost"], c["path"]) for c in cells}


@F.arrow_udf(CELLS)
def parse_rows(rows: pa.Array) -> pa.Array:
    return pa.array([_pack(parse(r)) for r in rows.to_pylist()], _CELLS)


@F.arrow_udf(CELLS)
def combine_spans(spans: pa.Array) -> pa.Array:
    joined = [_pack(combine([_unpack(c) for c in s])) for s in spans.to_pylist()]
    return pa.array(joined, _CELLS)


def best_path(cells: Column, block_rows: int) -> Column:
    """Cost and edit path of a conversation, the path cut into blocks of ``block_rows`` rows;
    insertions stand before the row that follows them, the last ones in the last block."""

    @F.arrow_udf(PATHS)
    def best(cells: pa.Array) -> pa.Array:
        out = []
        for cell in cells.to_pylist():
            cost, path = cheapest(_unpack(cell))
            ends = [m.end() for m in re.finditer("[DKRS]", path)]
            cuts = [0, *ends[block_rows - 1 : -1 : block_rows], len(path)]
            out.append({"cost": cost, "paths": [path[a:b] for a, b in zip(cuts, cuts[1:])]})
        return pa.array(out, _PATHS)

    return best(cells)


def damage(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) damaged by crc32 of ``conv:turn``: 0 of 20 drops a row, 1
    empties its text, 2 takes out ``.!?``, 3 repeats it, 4 sets the role user. ``copy`` tells
    the repeated rows apart."""
    name = F.concat_ws(
        ":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv", "turn")]
    )
    rows = rows.withColumn("_h", F.crc32(name.cast("binary")) % 20).where("_h <> 0")
    text = F.when(F.col("_h") == 1, "").when(
        F.col("_h") == 2, F.regexp_replace("text", "[.!?]", "")
    )
    return rows.select(
        "conv",
        "turn",
        F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(0), F.when(F.col("_h") == 3, 1).otherwise(0))).alias("copy"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Stored rows (conv, pos, turn, role, text, fault) in order of their conversation.

    ``pos`` counts from 0 by turn (nulls first); rows of one turn go by role and text. The
    first fault counts: blank, duplicate (role and text as in an earlier row, compared by
    128-bit hash), truncated. Rows are range-partitioned by conversation and turn, so a long
    conversation lies in many tasks; only rows that have a double meet the earlier one.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = ranked(rows, ["conv"], [*order, F.col("copy")])
    mark = F.concat_ws(
        ":", F.coalesce(F.col("conv").cast("string"), F.lit("")), F.col("conv").isNull(),
        F.length("role"), F.col("role"), F.col("text"),
    )
    rows = materialize(
        rows.select(
            "conv",
            (F.col("pos") - 1).alias("pos"),
            "turn",
            "role",
            "text",
            (~F.col("text").rlike(f"[^{BLANK}]")).alias("blank"),
            (~F.col("text").rlike(rf"[.!?][{BLANK}]*\z")).alias("open"),
            F.unhex(F.md5(mark.cast("binary"))).alias("mark"),
        ),
        "dialog-rows",
    )
    first = rows.groupBy("mark").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialize(first.where("n > 1").drop("n"), "dialog-doubles")
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("pos") > F.col("first"), "duplicate")
        .when(F.col("open"), "truncated")
    )
    rows = rows.join(broadcast_if_small(first), "mark", "left")
    rows = rows.select("conv", "pos", "turn", "role", "text", fault.alias("fault"))
    return materialize(rows, "dialog-faults")


def facts(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated) of faulty rows, summed per turn first."""
    kinds = ("blank", "duplicate", "truncated")
    turns = rows.groupBy("conv", "turn").agg(
        *[F.count_if(F.col("fault") == k).alias(k) for k in kinds]
    )
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *[F.sum(k).alias(k) for k in kinds]
    )


def _initial() -> Column:
    return F.substring("role", 1, 1)


def spans(rows: DataFrame) -> DataFrame:
    """(conv, block, rows, illegal): blocks of ``BLOCK_ROWS`` rows as letters, and how many
    neighbouring initials are not su, ua or au, with the first row of the next block."""
    letter = F.when(_initial().isin("s", "u", "a"), _initial()).otherwise("x")
    letter = F.when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    letter = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).otherwise(letter)
    block = F.floor(F.col("pos") / BLOCK_ROWS)
    edge = (F.col("pos") % BLOCK_ROWS == 0) & (F.col("pos") > 0)
    own = F.struct("pos", letter.alias("letter"), _initial().alias("initial"))
    cut = rows.select(
        "conv", F.explode(F.when(edge, F.array(block, block - 1)).otherwise(F.array(block))).alias("block"), own.alias("r")
    )
    groups = cut.groupBy("conv", "block").agg(F.array_sort(F.collect_list("r")).alias("r"))
    inside = F.filter("r", lambda x: F.floor(x["pos"] / BLOCK_ROWS) == F.col("block"))
    names = F.col("r.initial")
    pairs = F.zip_with(
        F.slice(names, 1, F.size("r") - 1),
        F.slice(names, 2, F.size("r")),
        lambda a, b: F.concat(a, b),
    )
    return groups.select(
        "conv",
        "block",
        F.array_join(F.transform(inside, lambda x: x["letter"]), "").alias("rows"),
        F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au"))).cast("long").alias("illegal"),
    )


def parse_conversations(rows: DataFrame) -> DataFrame:
    """(conv, cost, paths) of every conversation: cells of blocks, joined ``FAN`` at a time in
    as many rounds as the longest conversation needs."""
    cells = rows.select("conv", "block", parse_rows("rows").alias("cells"))
    while True:
        cells = materialize(cells, "dialog-cells")
        if not (cells.agg(F.max("block")).first()[0] or 0):
            break
        found = F.array_sort(F.collect_list(F.struct("block", "cells")))
        cells = (
            cells.groupBy("conv", F.floor(F.col("block") / FAN).alias("up"))
            .agg(found.alias("found"))
            .select(
                "conv", F.col("up").alias("block"), combine_spans(F.col("found.cells")).alias("cells")
            )
        )
    return cells.select("conv", best_path(F.col("cells"), BLOCK_ROWS).alias("best")).select("conv", "best.*")


def repaired_rows(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """(conv, pos, nth, edit, role, text) of the repaired conversations; ``pos`` is the row an
    edit stands at, ``nth`` its place among the edits there."""
    paths = parsed.select(F.col("conv").alias("_conv"), F.posexplode("paths").alias("_block", "path"))
    block = F.floor(F.col("pos") / BLOCK_ROWS) == F.col("_block")
    rows = rows.join(paths, F.col("conv").eqNullSafe(F.col("_conv")) & block)
    steps = F.regexp_extract_all("path", F.lit("([HI]*[DKRS](?:[HI]+$)?)"))
    step = F.element_at(steps, (F.col("pos") % BLOCK_ROWS + 1).cast("int"))
    rows = rows.withColumn("_step", step).select(
        "conv", "pos", "role", "text", F.posexplode(F.split("_step", "")).alias("nth", "edit")
    )
    role = F.when(F.col("edit").isin("H", "R"), "user").when(
        F.col("edit").isin("I", "S"), "assistant"
    )
    return rows.where("edit <> 'D'").select(
        "conv",
        "pos",
        "nth",
        "edit",
        role.otherwise(F.col("role")).alias("role"),
        F.when(F.col("edit").isin("H", "I"), "").otherwise(F.col("text")).alias("text"),
    )


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, sha256) of the newline-joined ``role:text``. A digest is made in order, so the
    rows of a conversation stream through one task, sorted there; none are held."""
    kind = repaired.schema["conv"].dataType.simpleString()
    rows = repaired.select("conv", "pos", "nth", F.concat_ws(":", "role", "text").alias("line"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "pos", "nth")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, running, conv_type = None, None, pa.null()
        for batch in batches:
            convs, sums = [], []
            conv_type = batch.column(0).type
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if running is not None and conv == last:
                    running.update(b"\n")
                else:
                    if running is not None:
                        convs.append(last)
                        sums.append(running.hexdigest())
                    last, running = conv, hashlib.sha256()
                running.update(line.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(convs, conv_type), pa.array(sums, pa.string())], ["conv", "sha256"]
            )
        if running is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([last], conv_type), pa.array([running.hexdigest()])], ["conv", "sha256"]
            )

    return rows.select("conv", "pos", "nth", "line").mapInArrow(digest, f"conv {kind}, sha256 string")


def as_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns under the names used here; null roles and texts are one space."""
    space = [F.coalesce(F.col(c), F.lit(" ")) for c in (role, text)]
    return df.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        space[0].alias("role"),
        space[1].alias("text"),
    )


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(verdicts, repaired) of rows (conv, turn, role, text[, copy]).

    ``verdicts`` has one row per conversation with rows: conv, gaps, blank, duplicate,
    truncated, illegal, cost, audit; ``repaired`` is ``repaired_rows``. A null conversation is
    one of its own, null turns come first, equal turns go by role and text, repeated rows are
    duplicates. A role that does not begin with s, u or a (an empty one too) cannot be kept.
    Empty tables give empty results.
    """
    if "copy" not in rows.columns:
        rows = rows.withColumn("copy", F.lit(0))
    rows = with_faults(rows)
    blocks = materialize(spans(rows), "dialog-spans")
    parsed = materialize(parse_conversations(blocks), "dialog-paths")
    illegal = blocks.groupBy("conv").agg(F.sum("illegal").alias("illegal"))
    audit = F.translate(F.array_join("paths", ""), "HS", "IR")
    verdicts = facts(rows)
    for more in (illegal, parsed.select("conv", "cost", audit.alias("audit"))):
        more = more.withColumnRenamed("conv", "_conv")
        verdicts = verdicts.join(more, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    return verdicts, repaired_rows(rows, parsed)


def repair_damaged(
    df: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Damage, judge and repair: one row per conversation of ``df``, also those that lose all
    rows (zeros, empty audit, hash of the empty text). Extra columns are not looked at."""
    rows = as_rows(df, conv, turn, role, text)
    verdicts, repaired = repair(damage(rows))
    out = rows.select(F.col("conv").alias(conv)).distinct()
    for more in (verdicts, digests(repaired)):
        out = out.join(more, F.col(conv).eqNullSafe(F.col("conv")), "left").drop("conv")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        F.col(conv),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
