"""A byte-level convolutional quality classifier in numpy.

Each filter reads four bytes at a time; being a sum of one learned value per byte and place, it is two lookups by byte
pairs. A text is cut into overlapping chunks that cover it from end to end; a filter's strongest answer in a chunk stands
for the chunk. The mean and the maximum over all chunks, combined linearly, give the probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small
from corpusloom.sources.stage import staged

WIDTH = 4
FILTERS = 16
#: Bytes of half a chunk: chunks are 256 bytes and overlap by half.
HALF = 128
#: Labelled rows of each class that the filters are fitted on, and the bytes of all their texts.
SAMPLE = 700
FIT_BYTES = 16 << 20
PASSES = 12
THRESHOLD = 0.3
CHUNK = 1 << 18


def halves(data: bytes, tables: np.ndarray) -> np.ndarray:
    """The strongest answer of each filter in each run of HALF bytes; ``tables`` has a row of answers per pair of bytes.

    A text shorter than a filter is padded with zero bytes; the last run may be short.
    """
    found = []
    for start in range(0, max(1, len(data)), CHUNK):
        part = data[start : start + CHUNK + WIDTH - 1]
        b = np.frombuffer(part.ljust(WIDTH, b"\0"), np.uint8).astype(np.int32)
        pairs = (b[:-1] << 8) | b[1:]
        answers = tables[0][pairs[:-2]] + tables[1][pairs[2:]]
        if start and len(part) < WIDTH:
            continue
        found.append(np.maximum.reduceat(answers, np.arange(0, len(answers), HALF), axis=0))
    return np.concatenate(found)


def pooled(parts: np.ndarray) -> np.ndarray:
    """Mean and maximum over the chunks, each made of two neighbouring halves."""
    chunks = np.maximum(parts[:-1], parts[1:]) if len(parts) > 1 else parts
    chunks = np.maximum(chunks, 0)
    return np.concatenate([chunks.mean(0), chunks.max(0)])


class Network:
    def __init__(self, taps: np.ndarray, out: np.ndarray):
        """``taps``: (WIDTH, 256, FILTERS) values by place and byte; ``out``: weights of mean and maximum, and a bias."""
        self.taps, self.out = taps.astype(np.float32), out.astype(np.float64)

    def tables(self) -> np.ndarray:
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(1 << 16, -1)
        return np.stack([pair(self.taps[0], self.taps[1]), pair(self.taps[2], self.taps[3])])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        tables = self.tables() if not hasattr(self, "_tables") else self._tables
        self._tables = tables
        rows = np.stack([pooled(halves(t, tables)) for t in texts]) if texts else np.zeros((0, 2 * self.taps.shape[2]))
        return 1 / (1 + np.exp(-np.clip(rows @ self.out[:-1] + self.out[-1], -30, 30)))


def strongest(taps: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strongest answer of each filter in each run of HALF places, and its place; CHUNK places are in memory at a time."""
    n, found = len(b) - WIDTH + 1, []
    for start in range(0, n, CHUNK):
        m = min(CHUNK, n - start)
        answers = sum(taps[j][b[start + j : start + j + m]] for j in range(WIDTH))
        padded = np.full((-(-m // HALF) * HALF, taps.shape[2]), -np.inf, np.float32)
        padded[:m] = answers
        at = padded.reshape(-1, HALF, taps.shape[2]).argmax(1)
        at += np.arange(len(at))[:, None] * HALF
        found.append((np.take_along_axis(padded, at, 0), at + start))
    best, places = zip(*found, strict=True)
    return np.concatenate(best), np.concatenate(places)


def trained(texts: list[bytes], labels: np.ndarray, prior: float, filters: int = FILTERS, passes: int = PASSES) -> Network:
    """Gradient descent with Adam on the log loss, the classes weighing the same; then the bias is moved to ``prior``.

    Only the place of a chunk's maximum learns from it, so a step costs little more than the forward pass.
    """
    rng = np.random.default_rng(0)
    net = Network(rng.normal(0, 0.3, (WIDTH, 256, filters)), np.append(rng.normal(0, 0.3, 2 * filters), 0.0))
    weight = np.where(labels == 1, 0.5 / max(1e-9, labels.mean()), 0.5 / max(1e-9, 1 - labels.mean()))
    state = [[np.zeros_like(p, dtype=np.float64) for _ in range(2)] for p in (net.taps, net.out)]
    data = [np.frombuffer(t.ljust(WIDTH, b"\0"), np.uint8) for t in texts]
    step = 0
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), 32):
            d_taps, d_out = np.zeros(net.taps.shape), np.zeros(net.out.shape)
            for i in order[start : start + 32]:
                b = data[i]
                best, at = strongest(net.taps, b)
                if len(best) > 1:
                    right = best[1:] > best[:-1]
                    best, at = np.where(right, best[1:], best[:-1]), np.where(right, at[1:], at[:-1])
                active = np.maximum(best, 0)
                top = active.argmax(0)
                x = np.concatenate([active.mean(0), active.max(0)])
                p = 1 / (1 + np.exp(-np.clip(x @ net.out[:-1] + net.out[-1], -30, 30)))
                g = (p - labels[i]) * weight[i]
                d_out += np.append(g * x, g)
                d_best = np.broadcast_to(g * net.out[:filters] / len(active), active.shape).copy()
                d_best[top, np.arange(filters)] += g * net.out[filters:-1]
                d_best *= best > 0
                column = np.broadcast_to(np.arange(filters), at.shape)
                for j in range(WIDTH):
                    cell = b[at + j].astype(np.int64) * filters + column
                    d_taps[j] += np.bincount(cell.ravel(), d_best.ravel(), 256 * filters).reshape(256, filters)
            step += 1
            for p, d, (m, v) in zip((net.taps, net.out), (d_taps, d_out), state, strict=True):
                d = d / 32 + 1e-4 * p
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p -= (0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    net.out[-1] += np.log(prior / (1 - prior))
    return net


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, fit_bytes: int = FIT_BYTES) -> Network | None:
    """The network, from labelled rows for which ``learn`` holds; None if a class is missing.

    All labels are counted for the prior. About ``sample`` rows of each class are picked by a hash, whatever their length, and of
    those, in hash order, each that leaves the sum of their bytes within ``fit_bytes``: so one task fits, and a retry or another cut of the files
    gives the same rows. Labels that are null or neither 0 nor 1 are not used; a key with both labels counts for each; repeated documents
    count once.
    """
    known = labels.where(F.col(label).isin(0, 1) & learn).select(F.col(key).alias("_key"), F.col(label).alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("y") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0])) * (1 << 30)
    drawn = known.where(F.pmod(F.xxhash64(F.lit("fit"), "_key"), F.lit(1 << 30)) < share)
    # About twice ``sample`` rows, counted before they are broadcast: so texts are read where they lie.
    drawn = staged(drawn.dropDuplicates(), "drawn")
    drawn = F.broadcast(drawn) if small(drawn) else drawn
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).cast("binary").alias("t"))
    content = F.xxhash64("t").alias("h")
    sizes = rows.join(drawn, "_key").select("_key", "y", content, F.octet_length("t").alias("size")).distinct()
    # The sample is a bounded one: its keys, labels, hashes and sizes are what the driver sees.
    chosen, total = [], 0
    for r in sizes.orderBy(F.xxhash64(F.lit("order"), "_key", "h"), "_key", "h", "y").limit(4 * sample).collect():
        if total + r.size <= fit_bytes:
            chosen.append((r._key, r.y, r.h))
            total += r.size
    wanted = docs.sparkSession.createDataFrame(chosen, sizes.drop("size").schema)
    picked = rows.select("*", content).join(F.broadcast(wanted), ["_key", "h"]).dropDuplicates(["_key", "h", "y"]).select("t", "y")
    prior = counts[1] / (counts[0] + counts[1])

    def learn_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((y, t) for part in parts for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
        y = np.array([r[0] for r in rows], float)
        if 0 < y.sum() < len(y):
            net = trained([r[1] for r in rows], y, prior)
            yield pa.RecordBatch.from_pydict({"taps": [net.taps.tobytes()], "out": [net.out.tobytes()]})

    found = picked.repartition(1).mapInArrow(learn_all, "taps binary, out binary").collect()
    if not found:
        return None
    return Network(np.frombuffer(found[0].taps, np.float32).reshape(WIDTH, 256, -1), np.frombuffer(found[0].out, np.float64))


def scored(docs: DataFrame, net: Network | None, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep``, ``score`` and ``predicted`` of every row; null and empty texts are scored as zero bytes.

    Without a network every score is 0.5. Texts are read from end to end in chunks, very long ones too; rows never move. Each row
    is scored on its own: equal texts get equal scores, repeated rows stay rows, an empty table stays empty. A score equal to
    the threshold predicts 1. Columns of ``docs`` that are not kept may have any name; kept ones must not be called ``score``,
    ``predicted`` or ``_bytes``.
    """
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).cast("binary").alias("_bytes"))

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [t.as_py() for t in part.column(len(keep))]
            found = net.scores(texts) if net else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found)], names=[*keep, "score"])

    schema = rows.drop("_bytes").withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(per_batch, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
