"""The sample that the quality filters are fitted on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import quality


@pytest.fixture
def fitted(monkeypatch):
    """Which texts and labels a fit gets, instead of a fit."""

    def run(spark, docs, labels, **bounds):
        # The task's own copy of the module is not the test's: the weights carry what it saw.
        def saw(texts, y, prior, **_):
            seen = b"".join(len(t).to_bytes(4, "little") + int(v).to_bytes(4, "little") for t, v in zip(texts, y, strict=True))
            return quality.Network(np.zeros((4, 256, 1)), np.frombuffer(seen, np.uint32).astype(np.float64))

        monkeypatch.setattr(quality, "trained", saw)
        net = quality.fit(docs, labels, F.lit(True), **bounds)
        return None if net is None else sorted(map(tuple, net.out.reshape(-1, 2).astype(int).tolist()))

    return run


def tables(spark, sizes):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    return docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))


def test_long_texts_take_part(spark):
    taps = np.random.default_rng(1).normal(size=(4, 256, 3)).astype(np.float32)
    net = quality.Network(taps, np.zeros(7))
    data = np.random.default_rng(2).integers(0, 256, 2 * quality.CHUNK + 777, dtype=np.uint8)
    best, at = quality.strongest(taps, data)
    want = quality.halves(data.tobytes(), net.tables())
    assert np.allclose(best, want, atol=1e-5) and (np.diff(at, axis=0) > 0).all()
    alone = sum(taps[j][data[at + j], np.arange(3)] for j in range(4))
    assert np.allclose(alone, best, atol=1e-5)


def test_sample_is_bounded_by_bytes_and_not_by_length(spark, fitted):
    docs, labels = tables(spark, [10, 20, 100_000, 50, 0, 60])
    assert fitted(spark, docs, labels) == [(0, 0), (10, 0), (20, 1), (50, 1), (60, 1), (100_000, 0)]
    assert fitted(spark, docs, labels, fit_bytes=1_000) == [(0, 0), (10, 0), (20, 1), (50, 1), (60, 1)]


def test_sample_does_not_depend_on_files_or_repeats(spark, fitted):
    docs, labels = tables(spark, range(10, 400))
    bounds = {"sample": 20, "fit_bytes": 4_000}
    once = fitted(spark, docs, labels, **bounds)
    assert 0 < len(once) <= 80 and sum(n for n, _ in once) <= 4_000
    assert fitted(spark, docs.repartition(7).union(docs), labels.repartition(3), **bounds) == once


def test_no_fit_without_both_classes(spark, fitted):
    docs, labels = tables(spark, [5, 6])
    assert fitted(spark, docs, labels.where("quality = 1")) is None
    assert fitted(spark, docs.limit(0), labels) is None
