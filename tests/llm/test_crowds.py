"""Pairs of vectors inside a crowd of similar, unlinked ones."""

import numpy as np

from corpusloom.llm import vectors


def test_bits_needed_are_those_of_runs():
    rng = np.random.default_rng(0)
    keys = np.sort(np.concatenate([rng.integers(0, 1 << 48, 60), rng.integers(0, 1 << 20, 60), np.full(9, 77)]))
    for i, need in enumerate(vectors.bits_needed(keys, 4)):
        sizes = [np.sum(keys >> (48 - b) == keys[i] >> (48 - b)) for b in range(49)]
        assert need == next((b for b, n in enumerate(sizes) if n <= 5), 49)


def test_crowd_of_a_third_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre = unit(rng.normal(size=64))
    away = unit((x := rng.normal(size=(4_000, 64))) - (x @ centre)[:, None] * centre)
    cone = np.sqrt(0.8) * centre + np.sqrt(0.2) * away
    side = rng.normal(size=(150, 64))
    side = unit(side - np.sum(side * cone[:150], 1)[:, None] * cone[:150])
    planted = 0.91 * cone[:150] + np.sqrt(1 - 0.91**2) * side
    x = np.concatenate([cone, planted, unit(rng.normal(size=(8_000, 64)))]).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(df).collect()}
    y = unit(x.astype(np.float64))
    want = (y @ y.T >= 0.9).sum(1) - 1
    wrong = [i for i in range(len(x)) if got[i] != want[i]]
    assert want[:150].sum() >= 150 and len(wrong) <= 0.01 * (want > 0).sum()
