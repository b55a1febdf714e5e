"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, pairs of neighbours and pairs with one word between
them, hashed to ``2 ** BITS`` coordinates. Training runs over a bounded sample of labelled rows in
``shards`` tasks, each with per-coordinate rates and L1, on coordinates seen in a few
documents at least; the sparse weights of the shards are averaged. What is broadcast is at most one double per coordinate.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayline.llm.common import drawn, held_out
from assayline.llm.decontaminate import WORD_BYTES

BITS = 20
PIECE = 4 << 20
#: Most labelled documents per class that training reads.
SAMPLE_PER_CLASS = 4000
SHARDS = 1
EPOCHS = 6
#: Fewest sampled documents of a shard that hold a coordinate the model may use.
MIN_DOCS = 3


def word_hashes(text: str | None) -> np.ndarray:
    """CRC of every word; a long text is cut at spaces, so only hashes are held."""
    if not text:
        return np.empty(0, np.uint32)
    raw = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES)
    if len(raw) <= PIECE:
        return np.array([zlib.crc32(w) for w in raw.split()], np.uint32)
    out, at = [], 0
    while at < len(raw):
        end = len(raw) if at + PIECE >= len(raw) else raw.rfind(b" ", at, at + PIECE) + 1
        if end <= at:  # one word longer than a piece
            end = raw.find(b" ", at) + 1 or len(raw)
        out.append(np.array([zlib.crc32(w) for w in raw[at:end].split()], np.uint32))
        at = end
    return np.concatenate(out)


def features(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Coordinates of all words, neighbour pairs and skip pairs, with repeats."""
    w = words.astype(np.uint64)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    grams = [w, w[:-1] * a + w[1:], w[:-2] * b + w[2:] + np.uint64(1)]
    mixed = np.concatenate([(g ^ (g >> np.uint64(29))) * a for g in grams])
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal for presence features; the last coordinate is the bias."""

    def __init__(self, size: int, rate=2.0, beta=1.0, l1=10.0, l2=0.0):
        self.rate, self.beta, self.l1, self.l2 = rate, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * self.l1 - z
        return np.where(
            np.abs(z) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n)) / self.rate + self.l2)
        )

    def learn(self, at: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label) * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate * w
        self.n[at] = n + g * g


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    per_class: int = SAMPLE_PER_CLASS,
    shards: int = SHARDS,
    epochs: int = EPOCHS,
    bits: int = BITS,
) -> np.ndarray:
    """Weights of all coordinates and the bias.

    Learns from at most ``per_class`` labelled ids of each class, drawn by a hash of the
    id, whose crc32 remainder is not the held-out one. Null ids, labels and texts without
    words teach nothing; of several labels for an id the highest counts, of several texts
    the one with the smallest hash. Without rows
    all weights are zero.
    """
    known = labels.select(
        F.col(id_col).alias("id"), (F.col(label_col) >= 1).cast("int").alias("label")
    ).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    count = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = F.when(F.col("label") == 1, count.get(1, 0)).otherwise(count.get(0, 0))
    known = known.where(drawn(F.col("id"), per_class, rows))
    first = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    known = known.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_class)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.where("text IS NOT NULL").join(F.broadcast(known.drop("k")), "id")
    # one row per drawn id, so at most 2 * per_class rows
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    rows = rows.groupBy("id", "label").agg(one.alias("one")).select("id", "label", "one.text")

    @F.arrow_udf("array<int>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [np.unique(features(word_hashes(t.as_py()), bits)) for t in batch]
            yield pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))

    order = F.xxhash64("id", F.lit(7))
    rows = rows.select(order.alias("o"), "id", "label", coded("text").alias("at"))
    rows = rows.repartition(shards, F.pmod("o", F.lit(shards))).sortWithinPartitions("o", "id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = Ftrl(1 << bits), []
        for batch in batches:
            for label, at in zip(batch["label"].to_pylist(), batch["at"]):
                held.append((np.append(at.values.to_numpy().astype(np.int64), 1 << bits), label))
        held = [x for x in held if len(x[0]) > 1]
        seen = np.zeros((1 << bits) + 1, np.int64)
        for at, _ in held:
            seen[at] += 1
        seen[-1] = MIN_DOCS
        held = [(at[seen[at] >= MIN_DOCS], label) for at, label in held]
        ones = sum(label for _, label in held)
        # positives are few: they count by the root of the imbalance
        weight = ((len(held) - ones) / ones) ** 0.5 if 0 < ones < len(held) else 1.0
        for _ in range(epochs):
            for at, label in held:
                model.learn(at, label, weight if label else 1.0)
        if held:
            w = model.weights(slice(None))
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(w[at]), pa.array(np.full(len(at), len(held)))],
                ["at", "w", "n"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1]), pa.array([0.0]), pa.array([len(held)])], ["at", "w", "n"]
            )

    parts = rows.mapInArrow(learn, "at long, w double, n long")
    sums = parts.groupBy("at").agg(F.sum(F.col("w") * F.col("n")).alias("w"), F.sum("n").alias("n"))
    weights, total = np.zeros((1 << bits) + 1), 1
    for r in sums.collect():  # at most one row per coordinate
        if r["at"] < 0:
            total = r["n"]
        else:
            weights[r["at"]] = r["w"]
    return weights / total


def toxicity(text: Column, spark, weights: np.ndarray) -> Column:
    """Probability of label 1 for a text column; null and empty texts get the bias alone."""
    bits = int(np.log2(len(weights) - 1))
    at = np.flatnonzero(weights)
    sent = spark.sparkContext.broadcast((at.astype(np.int32), weights[at]))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = np.zeros((1 << bits) + 1)
        w[sent.value[0]] = sent.value[1]
        for batch in batches:
            sums = []
            for t in batch:
                hit = features(word_hashes(t.as_py()), bits)
                sums.append(w[np.unique(hit[w[hit] != 0])].sum() + w[-1])
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(sums), -30, 30))), pa.float64())

    return score(text)


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.7,
    **fit,
) -> DataFrame:
    """(row, held_out, score, predicted): the input row as a struct and its score.

    Whole texts; every row is scored, also repeated ones and ones without id, text or
    words (they get the bias alone). A null id is not held out. No rows: no rows.
    """
    weights = train(docs, labels, id_col, text_col, **fit)
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row")).select(
        "row",
        held_out(F.col(f"row.`{id_col}`")).alias("held_out"),
        toxicity(F.col(f"row.`{text_col}`"), spark, weights).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
