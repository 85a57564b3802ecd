"""Swap target tokens for source pieces until a text holds the wanted share of source tokens."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from corpusloom.functions.draws import position_digests, position_orders, stem
from corpusloom.functions.tokens import PAD, fit_ids, fit_mask, replacements
from corpusloom.operators.lookup import as_lists, in_slices, lengths, lookup_elements

PERCENTS = (1, 5, 10, 25, 50, 75, 90, 95, 99)
ACCURACY = 10_000


def _flagged(encoded: DataFrame, ids: str, flags: DataFrame) -> DataFrame:
    """Add ``_source``, an array that says of each id whether it is a source token, and its ``_share``."""
    found = lookup_elements(encoded, encoded.columns, F.col(ids), flags, "idx", "is_source", "_found")
    found = found.withColumn("_source", F.transform("_found", lambda x: F.coalesce(x, F.lit(False)))).drop("_found")
    share = F.size(F.filter("_source", lambda x: x)) / F.size("_source").cast("double")
    return found.withColumn("_share", F.when(F.size("_source") > 0, share).otherwise(F.lit(0.0)))


def source_share(encoded: DataFrame, key: str, source_ids: DataFrame, ids: str = "input_ids") -> DataFrame:
    """``(key, n_tokens, source_ratio)``; 0 for a row without tokens."""
    flags = source_ids.select("idx", F.lit(True).alias("is_source"))
    found = _flagged(encoded.select(key, ids), ids, flags)
    return found.select(key, F.size("_source").cast("bigint").alias("n_tokens"), F.col("_share").alias("source_ratio"))


def share_summary(shares: DataFrame) -> DataFrame:
    ratio = F.col("source_ratio")
    return shares.agg(
        F.count("*").alias("texts"), F.avg(ratio).alias("mean"), F.min(ratio).alias("low"), F.max(ratio).alias("high")
    )


def share_histogram(shares: DataFrame, bars: int = 10) -> DataFrame:
    bar = F.least(F.floor(F.col("source_ratio") * bars), F.lit(bars - 1)).cast("int")
    return shares.groupBy(bar.alias("bar")).agg(F.count("*").alias("texts"))


def share_percentiles(shares: DataFrame, percents: Sequence[int] = PERCENTS, accuracy: int = ACCURACY) -> DataFrame:
    """``(percent, source_ratio)`` from a sketch that tasks build and merge: a rank is off by one in ``accuracy`` at most, so that
    tables of fewer rows get the exact ranks."""
    points = F.percentile_approx("source_ratio", [p / 100 for p in percents], accuracy)
    return shares.agg(points.alias("at")).select(
        F.explode(F.arrays_zip(F.array(*map(F.lit, percents)).alias("percent"), F.col("at").alias("source_ratio"))).alias("p")
    ).select("p.percent", "p.source_ratio")


def substitute_tokens(
    encoded: DataFrame, key: str, table: DataFrame, wanted: float | Column, seed: int, draw_by: str | Column | None = None
) -> DataFrame:
    """Replace randomly drawn target tokens of each row so that the source share reaches ``wanted``, which may differ by row.

    ``encoded`` is ``(key, input_ids, attention_mask, special_tokens_mask)`` and ``table`` is ``(idx, is_source,
    pieces)``. Positions are drawn by a seeded order, so a retry replaces the same ones; they go by ``draw_by``, the
    key if not given. All of it happens where the row lies, over arrays of an Arrow batch: a row that needs some of its target
    tokens swapped draws once for each of these and sorts the draws once.
    """
    columns = ["input_ids", "attention_mask", "special_tokens_mask"]
    found = _flagged(encoded.select(key, *columns), "input_ids", table.select("idx", "is_source"))

    times = replacements(F.size("_source"), F.col("_share"), wanted)
    draws = stem(seed, key if draw_by is None else draw_by)
    # Only swapped tokens are spelled.
    swapped = F.arrow_udf(_swapped, ArrayType(encoded.schema["input_ids"].dataType.elementType))(draws, "input_ids", "_source", times)
    marked = found.select(key, *columns, swapped.alias("_swapped"))
    spelled = lookup_elements(marked, [key, *columns], F.col("_swapped"), table, "idx", "pieces", "_new")

    # Pieces may be of a wider type than what they replace, and so may the masks of theirs.
    ids = spelled.select(F.concat("input_ids", F.flatten("_new"))).schema[0].dataType
    masks = {c: spelled.select(F.concat(c, F.array().cast("array<int>"))).schema[0].dataType for c in columns[1:]}
    made = StructType([StructField(c, t) for c, t in {"input_ids": ids, **masks, "n_swapped": LongType()}.items()])
    wide = [F.col("input_ids").cast(ids), *[F.col(c).cast(t) for c, t in masks.items()], F.col("_new").cast(ArrayType(ids))]
    return spelled.select(key, F.arrow_udf(_spelled, made)(*wide).alias("_made")).select(key, "_made.*")


def _swapped(stems: pa.Array, ids: pa.Array, source: pa.Array, times: pa.Array) -> pa.Array:
    """The ids to swap, at their places, NULL elsewhere: of each row as many target tokens as asked for, first draws first."""

    def one_slice(stems: pa.Array, ids: pa.Array, source: pa.Array, times: pa.Array) -> pa.Array:
        ends = np.cumsum(lengths(source))
        target = ~source.flatten().to_numpy(zero_copy_only=False).astype(bool)
        swap = np.zeros(len(target), bool)
        for begun, n, end, size in zip(stems.to_pylist(), times.to_pylist(), ends.tolist(), lengths(source).tolist(), strict=True):
            if not n:
                continue
            places = np.flatnonzero(target[end - size : end])
            if n < len(places):
                order = np.argsort(position_orders(position_digests(begun, places.tolist())), kind="stable")
                places = places[order[:n]]
            swap[end - size + places] = True
        values = ids.flatten()
        return as_lists(np.cumsum(lengths(ids)), pc.if_else(pa.array(swap), values, pa.scalar(None, values.type)), like=ids)

    return in_slices(one_slice, stems, ids, source, times, by=1)


def _spelled(ids: pa.Array, attention: pa.Array, special: pa.Array, new: pa.Array) -> pa.Array:
    """Rows with their new pieces in place, and how many tokens have some."""

    def one_slice(ids: pa.Array, attention: pa.Array, special: pa.Array, new: pa.Array) -> pa.Array:
        parts = new.flatten()
        # Without lists there may be no offsets either.
        pieces = parts.flatten() if len(parts) else pa.array([], parts.type.value_type)
        count = np.append(0, np.cumsum(parts.is_valid().to_numpy(zero_copy_only=False)))[np.append(0, np.cumsum(lengths(new)))]
        made = [
            _put(ids, new, pieces),
            _put(attention, new, pa.array(np.ones(len(pieces), np.int8)).cast(attention.type.value_type)),
            _put(special, new, pa.array(np.zeros(len(pieces), np.int8)).cast(special.type.value_type)),
            pa.array(np.diff(count), pa.int64()),
        ]
        return pa.StructArray.from_arrays(made, names=["input_ids", "attention_mask", "special_tokens_mask", "n_swapped"])

    return in_slices(one_slice, ids, attention, special, new, by=0)


def _put(lists: pa.ListArray, new: pa.ListArray, pieces: pa.Array) -> pa.ListArray:
    """Each element of the lists, or the pieces in its stead where ``new`` has some at its place."""
    size, known, parts = lengths(lists), lengths(new), new.flatten()
    row = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    # Where the row of new pieces ends before, a number beyond all of them stands for none.
    part = np.where(pos < known[row], (np.cumsum(known) - known)[row] + pos, len(parts))
    swapped = np.append(parts.is_valid().to_numpy(zero_copy_only=False), False)[part]
    many = lengths(parts)
    count = np.where(swapped, np.append(many, 0)[part], 1)
    first = np.where(swapped, len(row) + np.append(np.cumsum(many) - many, 0)[part], np.arange(len(row)))
    ends = np.cumsum(count)
    taken = np.repeat(first - (ends - count), count) + np.arange(count.sum())
    return as_lists(np.append(0, ends)[np.cumsum(size)], pa.concat_arrays([lists.flatten(), pieces]).take(pa.array(taken)), like=lists)


def fit_rows(encoded: DataFrame, length: int = 512) -> DataFrame:
    """Pad or truncate every row to ``length``, all three arrays alike."""
    return encoded.withColumns(
        {
            "input_ids": fit_ids(F.col("input_ids"), length, PAD),
            "attention_mask": fit_mask(F.col("attention_mask"), length, 0),
            "special_tokens_mask": fit_mask(F.col("special_tokens_mask"), length, 1),
        }
    )
