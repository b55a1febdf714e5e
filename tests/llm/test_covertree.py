"""Vector classes against brute force, for any block and cell size."""

from __future__ import annotations

import numpy as np
import pytest

from assayline.llm import covertree
from assayline.llm.simhash import _joined


def brute(rows, cosine=0.98):
    """{place: (links, smallest id)} of (id, vector, label) rows."""
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows):
            if i == j or a is None or a != b or not ok(v) or not ok(w) or len(v) != len(w):
                continue
            x, y = np.array(v, float), np.array(w, float)
            link[i, j] = x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine
    label = _joined(np.arange(n), *np.nonzero(link))
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i] and rows[j][0] is not None]
        out.append((rows[i][0], int(link[i].sum()), min(ids, default=None)))
    return sorted(out, key=str)


def ok(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)


def vectors(seed, n, families, noise):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(families, 16))
    rows = base[rng.integers(0, families, n)] + rng.normal(size=(n, 16)) * noise
    rows[::7] = rows[0]  # copies
    return [(int(i), [float(c) for c in v], int(i) % 5 % 2) for i, v in enumerate(rows.astype(np.float32))]


def result(rows):
    got = rows.collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(
    "sizes",
    [{}, {"block_rows": 7}, {"cell_rows": 20, "block_rows": 16}, {"cell_rows": 5, "max_centres": 12}],
)
def test_classes(spark, sizes):
    rows = vectors(1, 150, 12, 0.12)
    assert result(covertree.classes(spark.createDataFrame(rows, SCHEMA), **sizes)) == brute(rows)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None),
        (4, None, 1), (5, [0.0, -0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1),
        (None, [0.0, 3.0], 1), (None, [0.0, 3.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1),
        (11, [1e-30, 0.0], 1), (12, [3e38, -0.0], 1), (13, [1.0, 0.0], 2),
    ]
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", id int")
    assert result(covertree.classes(docs)) == brute(rows)
    assert covertree.classes(docs.limit(0)).count() == 0


def test_many_equal_directions():
    x = covertree.unit(np.repeat([[1.0, 2.0], [2.0, 1.0]], 300, axis=0))
    i, j = covertree.dual_pairs(
        covertree.Node(x, np.arange(600), 2.0), x, covertree.Node(x, np.arange(600), 2.0), x, 0.98
    )
    assert len(set(zip(i.tolist(), j.tolist()))) == len(i) == 2 * 300 * 300


def test_null_and_negative_ids_in_several_labels(spark):
    """Equal vectors under different labels stay apart, whatever their ids."""
    v, w = [1.0, 2.0], [2.0, -1.0]
    rows = [(None, v, k) for k in (1, 2, 3)] + [(k, v, k) for k in (1, 2)] + [(3, v, 3)]
    rows += [(-1, w, 1), (-(2**62), w, 2), (None, w, 2), (-5, w, 2), (None, w, 4), (None, w, 4)]
    assert result(covertree.classes(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_many_ids_are_null(spark):
    rows = [(None if i % 3 else -i, v, k) for i, v, k in vectors(4, 120, 9, 0.12)]
    for sizes in ({}, {"block_rows": 11}, {"cell_rows": 10, "block_rows": 6}):
        assert result(covertree.classes(spark.createDataFrame(rows, SCHEMA), **sizes)) == brute(rows)
