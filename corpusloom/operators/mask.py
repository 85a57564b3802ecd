"""Masked-LM rows: random masking, and splitting paired rows at their separator."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusloom.functions.draws import position_digests, position_parts, stem
from corpusloom.functions.tokens import IGNORE, SEPARATOR_ID, after_separator, before_separator, unmask
from corpusloom.operators.lookup import in_slices, lengths

# Of the chosen tokens 80 % become the mask token, 10 % a random token, and 10 % stay as they are.
MASKED, RANDOM = 0.8, 0.1


def mask_tokens(
    rows: DataFrame,
    key: str | Column,
    mask_id: int,
    vocab_size: int,
    probability: float = 0.15,
    seed: int = 0,
) -> DataFrame:
    """Replace ``input_ids`` by masked ids and add ``labels`` (-100 where nothing was chosen).

    Special tokens are never chosen. Every position draws once from the row key and its own index, inside Arrow
    batches: no shuffle, and a retry masks the same positions.
    """

    def one_slice(stems: pa.Array, ids: pa.Array, special: pa.Array) -> pa.Array:
        size, values = lengths(ids), ids.flatten()
        shown = _aligned(special, size)
        drawn = [position_digests(begun, range(n)) for begun, n in zip(stems.to_pylist(), size.tolist(), strict=True)]
        draws = np.concatenate([np.empty((0, 4), ">u4"), *drawn])
        picked = position_parts(draws, 0) < probability
        kind = position_parts(draws, 1)
        other = np.floor(position_parts(draws, 2) * vocab_size).astype(np.int32)
        # A position without a special-token mask is masked, but has no label.
        kept = ~picked | (kind >= MASKED + RANDOM) | pc.fill_null(pc.not_equal(shown, 0), False).to_numpy(zero_copy_only=False)
        chosen = picked & pc.fill_null(pc.equal(shown, 0), False).to_numpy(zero_copy_only=False)
        drawn_ids = pa.array(np.where(kind < MASKED, mask_id, other)).cast(values.type)
        written = pc.if_else(pa.array(kept), values, drawn_ids)
        label = pc.if_else(pa.array(chosen), values, pa.scalar(IGNORE, values.type))
        absent = pc.or_(ids.is_null(), special.is_null())
        lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), x, mask=absent) for x in (written, label)]
        return pa.StructArray.from_arrays(lists, names=["id", "label"])

    def masked(stems: pa.Array, ids: pa.Array, special: pa.Array) -> pa.Array:
        return in_slices(one_slice, stems, ids, special, by=1)

    kind = rows.select(F.concat("input_ids", F.array().cast("array<int>"))).schema[0].dataType
    udf = F.arrow_udf(masked, StructType([StructField("id", kind), StructField("label", kind)]))
    drawn = udf(stem(seed, key), F.col("input_ids").cast(kind), F.col("special_tokens_mask"))
    return rows.withColumn("_drawn", drawn).select(
        *[c for c in rows.columns if c != "input_ids"],
        F.col("_drawn.id").alias("input_ids"),
        F.col("_drawn.label").alias("labels"),
    )


def _aligned(lists: pa.ListArray, size: np.ndarray) -> pa.Array:
    """The elements of rows of the given sizes, NULL where the row's list is shorter."""
    own = lengths(lists)
    if np.array_equal(own, size):
        return lists.flatten()
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = at + np.repeat(np.cumsum(own) - own, size)
    return lists.flatten().take(pa.array(place, mask=at >= np.repeat(own, size)))


def split_pair(rows: DataFrame, separator: int = SEPARATOR_ID) -> DataFrame:
    """Split ids, mask and labels at each row's own separator; rows without one keep NULL halves.

    ``first_unmasked`` and ``second_unmasked`` are the halves with their labels put back.
    """
    ids = F.col("input_ids")
    halves = {}
    for side, part in (("first", before_separator), ("second", after_separator)):
        for column in ("input_ids", "attention_mask", "labels"):
            halves[f"{side}_{column}"] = part(F.col(column), ids, separator)
    split = rows.withColumns(halves)
    return split.withColumns(
        {f"{side}_unmasked": unmask(F.col(f"{side}_input_ids"), F.col(f"{side}_labels")) for side in ("first", "second")}
    )
