"""Line dedup over levelled sorted runs of line hashes.

A run is a stored table (h1, h2, docs, last): the 128-bit hash of a line key, the number
of documents that hold it and the largest of their ids, sorted by the hash. Every batch of
documents becomes a run on level 0; as soon as a level has ``fanout`` runs they are merged
into one run of the next level, so a key is rewritten once per level only. For all
documents at once the runs are merged at the end and the frequent keys joined back; in
incremental use (``drop_seen_lines``) a batch is merge-anti-joined with the runs.
DataFrame operations alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.common import ASCII_SPACE, ascii_lower, materialize

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


class LineRuns:
    """Levelled sorted runs in the shared folder of the session."""

    def __init__(self, fanout: int = 4):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]

    @staticmethod
    def _merge(parts: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, parts)
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))

    def add(self, run: DataFrame) -> None:
        """Store a run and compact every level that is full."""
        self.levels[0].append(materialize(run.sortWithinPartitions(*KEY), "run"))
        for level, runs in enumerate(self.levels):
            if len(runs) < self.fanout:
                break
            if level + 1 == len(self.levels):
                self.levels.append([])
            merged = self._merge(runs).sortWithinPartitions(*KEY)
            self.levels[level + 1].append(materialize(merged, "run"))
            self.levels[level] = []

    def merged(self, spark: SparkSession) -> DataFrame:
        """All runs as one table of distinct keys."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return spark.createDataFrame([], "h1 long, h2 long, docs long, last long")
        return self._merge(runs)


def line_run(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """The run of one batch: each key of at least ``min_chars`` code points once per row."""
    keys = F.array_distinct(F.transform(_lines(F.col(text_col)), line_key))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.explode(keys).alias("key"))
    rows = rows.where(F.char_length("key") >= min_chars).select("id", *_hashes(F.col("key")))
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("docs"), F.max("id").alias("last")
    )


def _located(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, mark, pos, h1, h2) of every line long enough; docs has id, mark, text."""
    rows = docs.select("id", "mark", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("line", line_key(F.col("line")))
    return rows.where(F.char_length("line") >= min_chars).select(
        "id", "mark", "pos", *_hashes(F.col("line"))
    )


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.struct("*").alias("row")).select(
        "row",
        F.col(f"row.`{id_col}`").cast("long").alias("id"),
        F.col(f"row.`{text_col}`").alias("text"),
        F.xxhash64(f"row.`{text_col}`").alias("mark"),
    )


def _without(packed: DataFrame, drops: DataFrame) -> DataFrame:
    """Add ``kept`` (text without the lines at the dropped positions), n_lines, n_dropped."""
    found = drops.groupBy("id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    found = found.select(F.col("id").alias("g_id"), F.col("mark").alias("g_mark"), "gone")
    same = F.col("id").eqNullSafe(F.col("g_id")) & (F.col("mark") == F.col("g_mark"))
    both = packed.join(found, same, "left")

    def pieces(lines: Column) -> Column:
        starts = F.concat(F.array(F.lit(-1)), F.col("gone"))
        ends = F.concat(F.col("gone"), F.array(F.size(lines)))
        parts = F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 2, e - s - 1))
        return F.concat_ws("\n", F.flatten(parts))

    # one-element transform: the text is split once, not once per piece
    cut = F.transform(F.array(_lines(F.col("text"))), pieces)[0]
    return both.select(
        "row",
        "id",
        "text",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(cut).alias("kept"),
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    ).withColumn("n_dropped", F.greatest("n_dropped", F.lit(0)))


def frequent_keys(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    min_chars: int,
    min_docs: int,
    batches: int,
    fanout: int,
) -> DataFrame:
    """(h1, h2, last) of the keys held by at least ``min_docs`` documents."""
    runs = LineRuns(fanout)
    slot = F.pmod(F.xxhash64(id_col), F.lit(batches))
    for batch in range(batches):
        runs.add(line_run(docs.where(slot == batch), id_col, text_col, min_chars))
    wanted = runs.merged(docs.sparkSession).where(F.col("docs") >= min_docs)
    return materialize(wanted.select(*KEY, "last"), "frequent")


def drop_frequent_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 3,
    fanout: int = 2,
) -> DataFrame:
    """Rows with ``kept``: lines found in many documents stay in the largest id only.

    Returns (row, id, text, kept, n_lines, n_dropped); ``row`` is the input row. The
    documents are added to the runs in ``batches`` by a hash of the id.

    Null or empty text: one empty line, ``kept`` stays null or empty. Every row counts as
    a document, also a repeated one; rows that share the largest id all keep their lines.
    A null id is never the largest: such a row loses frequent lines unless all holders
    have null ids. Shorter keys are never dropped, the same line twice in a document is
    kept or dropped twice. Very long texts are split once per use. No rows: no rows.
    """
    packed = _packed(docs, id_col, text_col)
    often = frequent_keys(docs, id_col, text_col, min_chars, min_docs, batches, fanout)
    lines = _located(packed.select("id", "mark", "text"), min_chars)
    drops = lines.join(often, KEY).where(
        F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    )
    return _without(packed, drops.select("id", "mark", "pos"))


def drop_seen_lines(
    docs: DataFrame,
    runs: LineRuns,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
) -> DataFrame:
    """One batch of incremental use: lines of earlier batches are dropped, its own added.

    The lines are merge-anti-joined with the runs: what is left is new. Within the batch
    repeated lines stay. Same row layout and same cases as ``drop_frequent_lines``.
    """
    packed = _packed(docs, id_col, text_col)
    seen = materialize(runs.merged(docs.sparkSession).select(*KEY), "seen")
    lines = _located(packed.select("id", "mark", "text"), min_chars)
    drops = lines.join(seen, KEY, "left_semi").select("id", "mark", "pos")
    out = materialize(_without(packed, drops), "batch")
    fresh = line_run(docs, id_col, text_col, min_chars).join(seen, KEY, "left_anti")
    runs.add(fresh)
    return out
