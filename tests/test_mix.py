import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.mix import interleave
from corpusloom.plans import mixture
from corpusloom.plans.mixture import build_mixture


def draw(seed, slot):
    return int(hashlib.md5(f"{seed}:{slot}".encode()).hexdigest()[:8], 16) / 2**32


def sequential(sources, weights, seed):
    """One slot after the other, until a source gives its last row."""
    taken, out, slot = [0] * len(sources), [], 0
    while sum(taken) < sum(map(len, sources)):
        u, n, edge = draw(seed, slot), 0, weights[0]
        while n < len(weights) - 1 and u >= edge:
            n += 1
            edge += weights[n]
        if not sources[n]:
            return out
        out.append((slot, n, sources[n][taken[n]]))
        taken[n] += 1
        slot += 1
        if taken[n] == len(sources[n]):
            return out
    return out


CASES = [
    ([300, 200], [0.5, 0.5]),
    ([40, 900, 500], [0.2, 0.3, 0.5]),
    ([3, 1000], [0.01, 0.99]),
    ([0, 10], [0.5, 0.5]),
    ([1, 1], [0.5, 0.5]),
]


@pytest.mark.parametrize(("sizes", "weights"), CASES)
@pytest.mark.parametrize("large", [False, True])
def test_interleave_equals_the_sequential_rule(spark, request, sizes, weights, large):
    if large:
        request.getfixturevalue("many_cells")
    ids = [[n * 10_000 + i for i in range(size)] for n, size in enumerate(sizes)]
    frames = [spark.createDataFrame([(i,) for i in part], "id long") for part in ids]
    got = sorted((r.row_idx, r.source_no, r.id) for r in interleave(frames, weights, 11, "id").collect())
    assert got == sequential(ids, weights, 11)


def test_mixture_keeps_validation_apart_and_own_splits(spark):
    corpus = lambda base, n: spark.createDataFrame([(base + i, f"t{base + i}") for i in range(n)], "id long, text string")
    own = corpus(5000, 60).selectExpr("id", "text", "if(id < 5020, 'validation', 'train') as split")
    mixed = build_mixture([corpus(0, 400), corpus(2000, 100), own], [0.4, 0.3, 0.3], "id", 5, sized=0, percent=10)
    rows = mixed.collect()
    by_split = {s: {r.id for r in rows if r.split == s} for s in ("train", "validation")}
    assert not by_split["train"] & by_split["validation"]
    assert {i for i in by_split["validation"] if 2000 <= i < 3000} <= set(range(2000, 2010))
    assert {i for i in by_split["validation"] if i >= 5000} <= set(range(5000, 5020))
    # 0.4 x (90 + 40) rows and one more are sampled for training, the next 0.4 x (10 + 20) and one more for validation.
    assert len({i for i in by_split["train"] if i < 1000}) <= 53
    for split in by_split:
        assert [r.row_idx for r in sorted((r for r in rows if r.split == split), key=lambda r: r.row_idx)] == list(range(len(by_split[split])))


def test_no_failed_row_vanishes(spark):
    rows = [(1, "d", "x  // c", "java"), (2, None, "x", "java"), (3, "d", None, "java"), (4, "d", "x = (1,\n", "python"), (5, None, None, "go")]
    code = spark.createDataFrame(rows, "id int, func_documentation_string string, whole_func_string string, language string")
    good, failed, seen = mixture.accounted(mixture.link_outcomes(code, ["id"], python=True), "linked")
    assert [(r.id, r.text) for r in good.collect()] == [(1, "d</s>x   ")] and "error" not in good.columns
    assert {r.id: r.error for r in failed.collect()} == {2: mixture.NO_DOC, 3: mixture.NO_CODE, 4: mixture.NOT_READ, 5: mixture.NO_DOC}
    assert seen == {mixture.NO_DOC: 2, mixture.NO_CODE: 1, mixture.NOT_READ: 1, "other": 0, "rows": 5}
    assert mixture.accounted(mixture.link_outcomes(code.limit(0), ["id"]), "none")[2]["rows"] == 0
    odd = mixture.link_outcomes(code, ["id"]).withColumn("error", F.lit("odd"))
    assert mixture.accounted(odd, "odd")[2]["other"] == 5
