"""Hard negatives against brute force over all pairs."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quotemill.llm import negatives
from quotemill.llm.common import table
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, row string, vec string, block int, part int, team int, dim string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, "z") for r in rows], SCHEMA)


def brute(rows):
    """The contract, pair by pair, over (vec_id, embedding, label)."""
    kept = {}
    for i, x, label in rows:
        if i is None or x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        vec = tuple(math.floor(256 * float(np.float32(v))) for v in x)
        kept[i, (label + 1) % 10 if i % 7 == 0 else label, vec] = None
    out = []
    for a, la, va in kept:
        if a % 50:
            continue
        score = [(-sum(p * q for p, q in zip(va, v)), i, label) for i, label, v in kept if len(v) == len(va) and (i, label, v) != (a, la, va)]
        score.sort()
        for ps, p, _ in [x for x in score if x[2] == la][:5]:
            held = [(ns, n) for ns, n, label in score if label != la and 50 * -ps <= 100 * -ns <= 95 * -ps][:3]
            out += [(a, p, k + 1, n, -ps, -ns) for k, (ns, n) in enumerate(held)]
    return sorted(out)


def rows_of(table):
    return [(r.vec_id, r.embedding, r.label) for r in table.select("vec_id", "embedding", "label").collect()]


@pytest.fixture(scope="module")
def many(spark):
    """Clusters, copies, ties, orthogonal and opposite vectors, a label with half of the rows."""
    rnd = random.Random(5)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(700):
        c = centres[rnd.randrange(8)]
        spread = rnd.choice([0, 0.01, 0.3])
        x = [v + rnd.gauss(0, spread) for v in c] if i % 3 else list(centres[0])
        rows.append((i, x, 1 if rnd.random() < 0.5 else rnd.randrange(10)))
    return frame(spark, rows)


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "chunk": 40, "fan": 2}, {"block": 1, "chunk": 7, "fan": 1}])
def test_as_brute_force(many, sizes):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert sorted(map(tuple, negatives.mine(many, label, **sizes).collect())) == brute(rows_of(many))


def test_given_table(spark):
    given = table(spark, SMALL, "embeddings")
    assert sorted(map(tuple, negatives.shifted(given).collect())) == brute(rows_of(given))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 3), (0, [1.0, 0.5], 3), (50, [1.0, 0.5], 4), (1, [1.0, 0.25], 4), (2, [0.75, 0.5], 4), (3, None, 4), (4, [None, 1.0], 4),
        (5, [nan, 1.0], 4), (6, [inf, 1.0], 4), (None, [1.0, 1.0], 4), (8, [1.0, 1.0], None), (9, [1.0], 4), (10, [], 4), (100, [], 4), (11, [-1.0, -1.0], 4),
        (12, [0.0, 0.0], 5), (13, [0.5, 0.25], 5), (15, [0.5, 0.25], 5), (150, [0.0, 0.0], 5), (16, [0.5, 0.5], 6), (16, [0.25, 0.5], 6),
    ]
    assert sorted(map(tuple, negatives.shifted(frame(spark, rows)).collect())) == brute(rows)


def test_empty(spark):
    assert negatives.shifted(frame(spark, [])).collect() == []
    assert negatives.shifted(frame(spark, [(1, [1.0], 2)])).collect() == []


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        negatives.shifted(frame(spark, [(0, [2.0**21], 1), (50, [1.0], 1)])).collect()


def test_tree_is_minimal():
    rnd = np.random.default_rng(3)
    points = rnd.integers(-9, 9, (40, 3)).astype(np.int32)
    order, parent, edge = negatives.spanning_tree(points)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and all(p < k for k, p in enumerate(parent))
    # Kruskal's algorithm gives the least total length.
    root = list(range(40))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = 0.0
    for gap, i, j in sorted((float(np.linalg.norm((points[i] - points[j]).astype(float))), i, j) for i in range(40) for j in range(i)):
        if find(i) != find(j):
            root[find(i)] = find(j)
            total += gap
    assert edge.sum() == pytest.approx(total)


def test_bounds_save_scores():
    """Among near copies, most rows are settled by their bounds; every row that a window holds is scored."""
    rnd = np.random.default_rng(7)
    centres = rnd.normal(0, 1, (20, 32)) * 256
    vecs = np.floor(centres[rnd.integers(0, 20, 1000)] + rnd.normal(0, 0.3, (1000, 32))).astype(np.int32)
    order, parent, edge = negatives.spanning_tree(vecs[:200])
    rows = pd.DataFrame({"vec_id": range(1000), "row": range(1000), "label": 0, "vec": [v.tobytes() for v in vecs]})
    block = type("Block", (), {"ids": order, "vecs": vecs[:200][order].tobytes(), "parent": parent, "edge": edge})
    tally, low, high = {}, 100_000, 300_000
    chunk = negatives.Chunk(rows, 32)
    for k, at, found in negatives.walk(block, chunk, lambda k, lo, hi: (hi >= low) & (lo <= high), tally):
        exact = vecs.astype(np.int64) @ vecs[:200][order][k].astype(np.int64)
        assert set(np.flatnonzero((exact >= low) & (exact <= high))) <= set(at) and (exact[at] == found).all()
    assert tally["scored"] < 0.35 * tally["pairs"]
