"""Whitening of embeddings by mixed-precision eigenvectors of their distributed covariance.

Each task multiplies its own centred vectors; the products are summed by matrix entry, so the driver sees one matrix of the
vectors' dimension, however many vectors there are. Its eigenvectors are found in single precision, which is cheap, and corrected
by the iteration of Ogita and Aishima, which needs matrix products only: the first rounds in double, the last in extended precision.
Where eigenvalues lie closer together than the iteration can tell, their vectors are turned by the eigenvectors of the small
matrix that they make of the covariance, shifted by the cluster's mean so that its gaps count, and then corrected further.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from corpusloom.sources.stage import staged

SCALE = 256
COMPONENTS = 4
#: Precision of each correction; extended where the machine has it.
ROUNDS = (np.float64,) * 4 + (np.longdouble,) * 4
HALF = 1 << 32


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``k, x``, key and vector, of the rows with a vector of finite entries; each as a whole number, floor(scale * entry)."""
    v = F.col(vector)
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return vectors.where(good).select(F.col(key).alias("k"), x.alias("x"))


def by_dimension(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The dimension, the places and the matrix of the vectors of each dimension in a column without nulls."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        rows = column if len(at) == len(sizes) else column.take(pa.array(at))
        yield int(dim), at, rows.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(dim))


def totals(fit: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """Of every dimension: the number of vectors, the exact sums by entry, and a bound of the entries."""

    def per_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for dim, at, x in by_dimension(part.column(0)):
                # Halves of the numbers, so that no sum of a task leaves 64 bits.
                columns = [
                    np.full(dim, dim, np.int32), np.arange(dim, dtype=np.int32), np.full(dim, len(at), np.int64),
                    (x // HALF).sum(0), (x % HALF).sum(0), x.min(0), x.max(0),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "pos", "n", "hi", "lo", "least", "most"])

    sums = fit.mapInArrow(per_task, "dim int, pos int, n bigint, hi bigint, lo bigint, least bigint, most bigint")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("hi", "lo")]
    rows = sums.groupBy("dim", "pos").agg(F.sum("n").alias("n"), *wide, F.min("least").alias("least"), F.max("most").alias("most")).collect()
    found = {}
    for dim in {r.dim for r in rows}:
        own = sorted((r for r in rows if r.dim == dim), key=lambda r: r.pos)
        bound = max(max(abs(r.least), abs(r.most)) for r in own)
        found[dim] = (own[0].n, [int(r.hi) * HALF + int(r.lo) for r in own], bound)
    return found


def covariances(fit: DataFrame, centres: dict[int, np.ndarray], turns: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Sums of products of the centred vectors (turned by ``turns``, if given), of every dimension."""

    def per_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for dim, _, x in by_dimension(part.column(0)):
                if dim in centres:
                    c = x - centres[dim]
                    c = c if turns is None else c @ turns[dim]
                    sums[dim] = sums.get(dim, 0.0) + c.T @ c
        for dim, total in sums.items():
            i, j = np.triu_indices(len(total))
            columns = [np.full(len(i), dim, np.int32), i.astype(np.int32), j.astype(np.int32), total[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["dim", "i", "j", "s"])

    entries = fit.mapInArrow(per_task, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s"))
    table = entries.toArrow()
    dims, i, j, s = (table.column(c).to_numpy() for c in ("dim", "i", "j", "s"))
    found = {}
    for dim in np.unique(dims):
        own = dims == dim
        size = int(i[own].max()) + 1
        matrix = np.zeros((size, size))
        matrix[i[own], j[own]] = matrix[j[own], i[own]] = s[own]
        found[int(dim)] = matrix
    return found


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One correction of eigenvectors ``x`` of the symmetric ``a``: better vectors, their eigenvalues, and the gap that it can tell."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ a @ x
    # Rounding that is not symmetric would be divided by gaps, and the vectors of a cluster would lose their right angles.
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    gap = 2 * (np.linalg.norm((s - np.diag(values)).astype(np.float64)) + float(np.abs(values).max()) * np.linalg.norm(r.astype(np.float64)))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return x + x @ e, values, gap


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """The places of eigenvalues (in rising order) that follow each other at no more than ``gap``; lone ones left out."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    size = float(np.abs(matrix).max()) if matrix.size else 0.0
    if not size:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    x = np.linalg.eigh((matrix / size).astype(np.float32))[1]
    for precision in ROUNDS:
        a = matrix.astype(precision) / precision(size)
        x, values, gap = corrected(a, x.astype(precision))
        for cluster in clusters(values, gap):
            own = x[:, cluster]
            small = own.T @ (a @ own) - values[cluster].mean() * (own.T @ own)
            top = np.abs(small).max()
            if top:
                x[:, cluster] = own @ np.linalg.eigh(((small + small.T) / (2 * top)).astype(np.float64))[1].astype(precision)
    x = x / np.sqrt((x * x).sum(0))
    values = (x * (a @ x)).sum(0)
    order = np.argsort(-values)
    return (values[order] * size).astype(np.float64), x[:, order].astype(np.float64)


@dataclass
class Space:
    """What whitening the vectors of one dimension needs."""

    n: int
    sums: list[int]
    bound: int
    centre: np.ndarray
    turn: np.ndarray
    explained: np.ndarray
    error: float = 0.0


def deviations(x: np.ndarray, space: Space) -> pa.Array:
    """The sum over entries of (n * x - S) squared, exactly; null where it does not fit in 64 bits."""
    if space.bound * space.n < 1 << 62 and (2 * space.bound * space.n) ** 2 * max(1, x.shape[1]) < 1 << 62:
        d = x * space.n - np.array(space.sums, np.int64)
        return pa.array((d * d).sum(1))
    exact = [sum((int(c) * space.n - s) ** 2 for c, s in zip(row, space.sums, strict=True)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def fit_spaces(fit: DataFrame, components: int) -> dict[int, Space]:
    """The whitening of every dimension among the staged distinct vectors ``x``."""
    counted = {dim: t for dim, t in totals(fit).items() if dim}
    # A quotient of whole numbers is rounded once.
    centres = {dim: np.array([s / n for s in sums]) for dim, (n, sums, _) in counted.items()}
    spaces = {}
    for dim, products in covariances(fit, centres).items():
        n, sums, bound = counted[dim]
        values, vectors = eigen(products / n)
        values, trace = np.maximum(values, 0.0), float(np.trace(products / n))
        # Variance that rounding alone could make is none.
        real = values > 1e-13 * max(trace, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            turn = np.where(real, vectors / np.sqrt(values), np.nan)[:, :components]
        explained = values[:components] / trace if trace else np.full(min(dim, components), np.nan)
        spaces[dim] = Space(n, sums, bound, centres[dim], turn, explained)
    turns = {dim: np.nan_to_num(s.turn) for dim, s in spaces.items()}
    for dim, products in covariances(fit, centres, turns).items():
        real = ~np.isnan(spaces[dim].turn[0])
        off = np.abs(products / spaces[dim].n - np.eye(len(products)))[np.ix_(real, real)]
        spaces[dim].error = float(off.max()) if off.size else 0.0
    return spaces


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: of each vector its first whitened components.

    Rows whose vector is null or holds null or non-finite entries are left out; repeated rows stay repeated, but distinct vectors are
    fitted once. Vectors of different dimensions are spaces of their own, each with its own ``n``; a vector without entries has
    no components, and one with fewer than ``components`` entries has as many as entries. A component without variance (equal
    vectors, a single one) is null in ``whitened``, with ``explained`` 0 or, without any variance at all, null; ``identity_error``
    is over the others. Equal eigenvalues keep any order. ``deviation`` is null beyond 64 bits. A null key stays null; other columns
    are not read, so that their names cannot clash. An empty table gives no rows.
    """
    rows = quantised(vectors, key, vector)
    spaces = fit_spaces(staged(rows.select("x").distinct(), "fit"), components)

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for dim, at, x in by_dimension(part.column(1)):
                if dim not in spaces:
                    continue
                space = spaces[dim]
                values, spread = (x - space.centre) @ space.turn, deviations(x, space)
                for c in range(values.shape[1]):
                    same = [np.full(len(at), v) for v in (np.int32(c + 1), np.int64(space.n))]
                    last = [np.full(len(at), v) for v in (space.explained[c], space.error)]
                    columns = [part.column(0).take(pa.array(at)), *map(pa.array, same), spread, pa.array(values[:, c], from_pandas=True)]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, from_pandas=True) for v in last)], schema=arrow)

    fields = {"component": IntegerType(), "n": LongType(), "deviation": LongType()}
    fields |= {name: DoubleType() for name in ("whitened", "explained", "identity_error")}
    schema = StructType([StructField(key, rows.schema["k"].dataType), *(StructField(name, kind) for name, kind in fields.items())])
    kinds = {IntegerType: pa.int32(), LongType: pa.int64(), DoubleType: pa.float64()}
    arrow = pa.schema([(key, to_arrow_type(rows.schema["k"].dataType)), *((name, kinds[type(kind)]) for name, kind in fields.items())])
    return rows.mapInArrow(per_batch, schema)
