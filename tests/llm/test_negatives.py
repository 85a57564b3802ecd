"""Hard negatives against all pairs in plain Python, with ties, copies, nulls, hot values and many small tiles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, id string, tile int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(3)


def brute(rows, is_anchor):
    ok = {
        (k, label, tuple(math.floor(256 * c) for c in v))
        for k, v, label in rows
        if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    }
    out = []
    for a in ok:
        if a[0] is None or not is_anchor(a[0]):
            continue
        others = [
            (-sum(p * q for p, q in zip(a[2], b[2], strict=True)), b[0] is None, b[0] or 0, b[0], b[1])
            for b in ok
            if b != a and len(b[2]) == len(a[2])
        ]
        others.sort(key=lambda o: o[:3])
        for p in [o for o in others if o[4] == a[1]][:5]:
            fits = [o for o in others if o[4] != a[1] and 30 * -p[0] <= 100 * -o[0] <= 90 * -p[0]]
            out += [(a[0], p[3], n + 1, o[3], -p[0], -o[0]) for n, o in enumerate(fits[:10])]
    return sorted(out, key=str)


def found(spark, rows, modulus, **settings):
    got = negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % modulus == 0, **settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def drawn(n, dim, seed, labels=4):
    """Clustered vectors of few distinct values, so that scores tie; a third of all rows are one vector."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    x = np.round(centres[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, dim)), 1)
    x[: n // 3] = x[0]
    return [(int(i), x[i].tolist(), int(rng.integers(0, labels))) for i in rng.permutation(n)]


@pytest.mark.parametrize("settings", [{}, {"tile_rows": 100, "leaf": 8, "fanout": 3, "block": 20}])
def test_against_all_pairs(spark, settings):
    rows = drawn(500, 6, 2)
    rows += rows[:40]
    rows += [(10, [0.5] * 6, 1), (20, rows[0][1], 3), (None, rows[3][1], 2), (None, rows[4][1], 1)]
    rows += [(5000, None, 1), (5010, [None] * 6, 1), (5020, [float("nan")] * 6, 1), (5030, rows[0][1], None)]
    want = brute(rows, lambda k: k % 10 == 0)
    assert len(want) > 1_000
    assert found(spark, rows, 10, **settings) == want


def test_other_lengths_and_empty_vectors_meet_only_their_own(spark):
    rows = drawn(60, 4, 5) + [(k + 1000, v, label) for k, v, label in drawn(60, 3, 6)] + [(2000, [], 1), (2001, [], 1), (2002, [], 2)]
    assert found(spark, rows, 10) == brute(rows, lambda k: k % 10 == 0)


def test_large_entries_are_not_rounded(spark):
    rows = [(0, [2.0**20, 1.0], 0), (1, [2.0**20, 2.0], 0), (2, [2.0**20 * 0.75, 3.0], 1), (3, [2.0**20 * 0.75, 2.0], 1)]
    rows += [(4, [2.0**19, 1.0 + 2**-8], 1), (5, [2.0**19, 1.0], 1)]
    want = brute(rows, lambda k: k == 0)
    assert len(want) == 4 and found(spark, rows, 100) == want


def test_nothing_to_find(spark):
    assert found(spark, [], 10) == []
    assert found(spark, [(0, [1.0], 1)], 10) == []
    assert found(spark, [(0, [1.0], 1), (1, [2.0], 1)], 10) == []
    assert found(spark, [(0, [1.0], 1), (1, [-2.0], 1), (2, [0.5], 2)], 10) == []


def test_boxes_bound_what_they_hold():
    rng = np.random.default_rng(8)
    x, a = rng.integers(-300, 300, (200, 5)), rng.integers(-300, 300, (20, 5))
    x = x[negatives.packed_order(x)]
    tree = negatives.Tree.over(x)
    least, most = negatives.bounds(a, tree.low, tree.high)
    scores = a @ x.T
    assert (least[:, -1] <= scores.min(1)).all() and (most[:, -1] >= scores.max(1)).all()
    assert sorted(x.tolist()) == sorted(x[negatives.packed_order(x)].tolist())
