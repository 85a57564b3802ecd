"""Near-duplicate vectors by sorted projection passes.

A pass draws random hyperplanes and sorts all vectors by the bits of their sides, first plane first; close vectors share
long beginnings and stand close together. Each is compared with the next WINDOW ones, exactly. The number of passes follows
from the number of vectors, as if they were spread evenly, so that a pair right at the threshold is met in some pass with
probability RECALL; closer pairs are met more surely. Where vectors crowd, more of them share the first bits: each pass tells how
many bits a vector needs to be alone with its window, and vectors whose passes do not add up to RECALL are compared with each
other block against block. The links of all passes make components; inside a component, where a window may be too short
for a dense group, all links are then counted block against block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.graph import components
from corpusloom.sources.stage import staged

THRESHOLD = 0.9
WINDOW = 64
BITS = 48
RECALL = 0.995
SEED = 5
#: Rows of a sorted partition, and of a block in which a component's links are counted.
PARTITION = 16_384
BLOCK = 512
#: Rows of a block in which vectors in crowds are compared, and of the slices of it that are multiplied at once.
CROWD_BLOCK = 4_096
SLICE = 512


def passes_for(rows: int, threshold: float, window: int, recall: float) -> int:
    """Passes until a pair at the threshold is met with probability ``recall``.

    Two vectors stand within the window if they share about log2(rows / window) bits; each bit agrees with probability
    1 - angle / pi.
    """
    agree = 1 - math.acos(threshold) / math.pi
    met = agree ** max(0.0, math.log2(max(1.0, rows / window)) + 1)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def unit(rows: pa.Array) -> np.ndarray:
    """Float vectors from their bytes, at length one, in double precision."""
    x = np.stack([np.frombuffer(r.as_py(), np.float32) for r in rows]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """``id, dim, v``: distinct vectors of finite, not all zero components as bytes, with ``least`` and ``n`` (their rows); and
    all rows with ``v`` (null if not usable)."""
    v = F.col(vector)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = staged(vectors.select(F.col(key).alias("key"), F.when(good, F.transform(v, lambda x: (x + F.lit(0.0)).cast("float"))).alias("v")), "rows")
    keys = rows.select("key", F.when(F.col("v").isNotNull(), F.sha2(F.array_join("v", ",").cast("binary"), 256)).alias("id"))
    distinct = rows.where("v is not null").withColumn("id", F.sha2(F.array_join("v", ",").cast("binary"), 256))
    distinct = distinct.groupBy("id").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    return staged(distinct.withColumn("dim", F.size("v")), "distinct"), staged(keys, "keys")


def as_bytes(rows: DataFrame, *names: str) -> DataFrame:
    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            packed = [np.asarray(v.values, np.float32).tobytes() for v in part.column(len(names))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(packed, pa.binary())], names=[*names, "v"])

    schema = rows.select(*names, F.lit(b"").alias("v")).schema
    return rows.select(*names, "v").mapInArrow(per_batch, schema)


def sort_keys(rows: DataFrame, passes: int, seed: int) -> DataFrame:
    """Every vector once per pass, with the bits of its sides as one number."""

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            dims = part.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                some = part.take(pa.array(at))
                x = unit(some.column(2))
                for p in range(passes):
                    planes = np.random.default_rng([seed, p, int(dim)]).normal(size=(int(dim), BITS))
                    bits = (x @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p, np.int32)), some.column(1), pa.array(bits), some.column(0), some.column(2)],
                        names=["pass", "dim", "sort_key", "id", "v"],
                    )

    return rows.mapInArrow(per_batch, "pass int, dim int, sort_key bigint, id string, v binary")


def bits_needed(keys: np.ndarray, window: int) -> np.ndarray:
    """Of each place in ascending keys, the least number of first bits that at most ``window`` + 1 keys around it share.

    Two keys that share so many bits stand within the window. BITS + 1 where even all bits are shared by more.
    """
    need, span = np.zeros(len(keys), np.int64), window + 1
    if len(keys) <= span:
        return need
    differ = keys[:-span] ^ keys[span:]
    shared = BITS + 1 - np.where(differ > 0, np.frexp(differ.astype(np.float64))[1], 0)
    padded = np.concatenate([np.zeros(span, np.int64), shared, np.zeros(span, np.int64)])
    return np.lib.stride_tricks.sliding_window_view(padded, span + 1).max(1)


def spanned(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over places 0..n-1 that connect what the links connect."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def window_links(parts: Iterator[pa.RecordBatch], window: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Stars that span the verified links of a sorted stream, and of each row (``b`` is null) the logarithm of the probability
    that the pass does not meet it with a vector at the threshold.

    The last rows of a batch are kept for the next. Rows at the ends of the stream, whose neighbours may be in another
    partition, are given no probability: they count as not met.
    """
    agree, span = 1 - math.acos(threshold) / math.pi, window + 1
    missed = np.maximum(np.log1p(-np.minimum(agree ** np.arange(BITS + 2.0), 1 - 1e-12)), -25.0)
    missed[BITS + 1] = 0.0
    rest: pa.Table | None = None
    for part in parts:
        whole = pa.Table.from_batches([part])
        whole = pa.concat_tables([rest, whole]).combine_chunks() if rest is not None else whole
        groups = np.char.add(np.char.add(whole["pass"].to_numpy().astype(str), "-"), whole["dim"].to_numpy().astype(str))
        ids, keys = np.array(whole["id"].to_pylist(), object), whole["sort_key"].to_numpy()
        edges, need = [], np.zeros(len(ids), np.int64)
        for cut in np.split(np.arange(len(ids)), np.flatnonzero(groups[1:] != groups[:-1]) + 1):
            x = unit(whole["v"].combine_chunks().take(pa.array(cut)))
            need[cut] = bits_needed(keys[cut], window)
            for gap in range(1, min(window, len(cut) - 1) + 1):
                near = np.flatnonzero(np.einsum("ij,ij->i", x[:-gap], x[gap:]) >= threshold)
                edges.append(np.stack([cut[near], cut[near + gap]]))
        a, b = np.concatenate(edges, 1) if edges else np.zeros((2, 0), int)
        a, b = spanned(a, b, len(ids))
        sure = np.arange(span, max(span, len(ids) - span))
        yield pa.RecordBatch.from_arrays(
            [pa.array([*ids[a], *ids[sure]], pa.string()), pa.array([*ids[b], *[None] * len(sure)], pa.string()),
             pa.array(np.concatenate([np.zeros(len(a)), missed[need[sure]]]))], names=["a", "b", "missed"])
        rest = whole.slice(max(0, len(ids) - 2 * span))


def crowd_links(crowd: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: stars that span all links among the rows of the staged ``crowd`` (``id, dim, v``), compared block against block."""
    blocks = max(1, math.ceil(crowd.count() / CROWD_BLOCK))
    rows = crowd.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def per_pair(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "id"], ignore_index=True)
        x, block, alone = unit(pa.array(rows["v"], pa.binary())), rows["block"].to_numpy(), rows["low"].iloc[0] == rows["high"].iloc[0]
        split = 0 if alone else int(np.searchsorted(block, block[-1]))
        edges = [np.zeros((2, 0), int)]
        for start in range(0, len(x) if alone else split, SLICE):
            end = min(start + SLICE, len(x) if alone else split)
            near = np.argwhere(x[start:end] @ x[split:].T >= threshold).T + np.array([[start], [split]])
            edges.append(np.stack(spanned(near[0], near[1], len(x))))
        a, b = spanned(*np.concatenate(edges, 1), len(x))
        ids = rows["id"].to_numpy()
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    return met.select("dim", "low", "high", "block", "id", "v").groupBy("dim", "low", "high").applyInPandas(per_pair, "a string, b string")


def counted(members: DataFrame, threshold: float) -> DataFrame:
    """``id, links``: for members of components (``root, id, n, v``), the rows of other vectors at the threshold or above.

    A component is cut into blocks of about BLOCK members; every pair of blocks is a group of its own, and gives one sum
    per member, so no group is compared in one task and no pair leaves it.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = members.join(staged(sizes, "blocks"), "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def per_pair(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        blocks = sorted(rows["block"].unique())
        sides = [(b, rows[rows["block"] == b]) for b in blocks]
        vectors = {b: unit(pa.array(s["v"], pa.binary())) for b, s in sides}
        low, high = int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        for b, own in sides:
            for c, their in sides:
                if (low == high) != (b == c):
                    continue
                near = (vectors[b] @ vectors[c].T) >= threshold
                if b == c:
                    np.fill_diagonal(near, False)
                out.append(pd.DataFrame({"id": own["id"], "links": near @ their["n"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"id": [], "links": []})

    sums = met.select("root", "low", "high", "block", "id", "n", "v").groupBy("root", "low", "high").applyInPandas(per_pair, "id string, links bigint")
    return sums.groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, seed: int = SEED
) -> DataFrame:
    """``key, n_links, component_id, kept`` of every row.

    Rows link at a cosine of at least ``threshold``, computed in double precision; equal vectors always. Null vectors, zero
    vectors, and those with null or non-finite components link with nothing, nor do vectors of different length.
    ``n_links`` counts the other rows linked, ``component_id`` is the smallest key reachable, ``kept`` marks the rows that
    have it. Repeated rows count as rows; a null key is never the smallest. An empty table gives no rows.
    """
    distinct, keys = usable(vectors, key, vector)
    rows = distinct.count()
    passes = passes_for(rows, threshold, window, recall)
    packed = as_bytes(distinct, "id", "dim")
    parts = max(1, math.ceil(rows * passes / PARTITION))
    ordered = sort_keys(packed, passes, seed).repartitionByRange(parts, "pass", "dim", "sort_key", "id").sortWithinPartitions("pass", "dim", "sort_key", "id")
    found = staged(ordered.mapInArrow(lambda batches: window_links(batches, window, threshold), "a string, b string, missed double"), "found")
    met = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("missed").alias("missed")).where(F.col("missed") <= math.log(1 - recall))
    crowd = staged(packed.join(met, "id", "left_anti"), "crowd")
    stars = found.where("b is not null").select("a", "b").unionByName(crowd_links(crowd, threshold))
    roots = staged(components(stars), "roots")
    linked = as_bytes(distinct.join(roots, distinct["id"] == roots["node"]), "root", "id", "n")
    links = staged(counted(linked, threshold), "links")
    placed = distinct.select("id", "least", "n").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = staged(placed, "placed")
    first = placed.groupBy("root").agg(F.min("least").alias("component"))
    info = placed.join(first, "root").join(links, "id", "left")
    info = staged(info.select("id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component"), "info")
    component = F.when(F.col("id").isNull(), F.col("key")).otherwise(F.col("component"))
    return keys.join(info, "id", "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )
