"""Look up a key column in a dimension table, whatever the table's size and however hot one key is."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

BROADCAST_VALUES = 4_000_000
#: A hot key is split so finely that a partition's share of rows takes so many pieces.
PIECES = 8
#: Rows of one key that no task minds.
FEW_ROWS = 1_000
#: Elements of arrays that are looked up at once.
SLICE = 250_000


def measured(table: DataFrame) -> int:
    """About how many 8-byte values the table holds: array elements, eighths of strings, and one for other cells."""
    sizes = []
    for field in table.schema:
        cell = F.lit(1)
        if isinstance(field.dataType, ArrayType):
            cell = F.greatest(F.size(field.name), F.lit(0)) + 1
        elif isinstance(field.dataType, StringType):
            cell = F.coalesce(F.octet_length(field.name), F.lit(0)) / 8 + 1
        sizes.append(F.coalesce(F.sum(cell), F.lit(0)).cast("bigint"))
    return sum(table.agg(*[s.alias(f"s{i}") for i, s in enumerate(sizes)]).first())


def fits_broadcast(table: DataFrame) -> bool:
    return measured(table) <= BROADCAST_VALUES


def hot_keys(facts: DataFrame, on: str) -> dict:
    """The keys (NULL too) that make up more than a shuffle partition's share of the rows, and how many pieces each is cut into.

    A mergeable sketch of frequent items finds them in one pass. Its error is below a quarter of that share, and there cannot be
    more such keys than partitions.
    """
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tracked = min(1_000_000, max(1_000, 16 * parts))
    top = F.expr(f"approx_top_k(`{on}`, {min(parts, tracked)}, {tracked})")
    seen = facts.agg(F.count(F.lit(1)).alias("rows"), top.alias("top")).first()
    hot = [k for k in seen["top"] if k["count"] > max(FEW_ROWS, seen["rows"] / parts)]
    return {k["item"]: -(-k["count"] * parts * PIECES // seen["rows"]) for k in hot}


def lookup(facts: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Left join ``facts`` with ``table`` (unique on ``on``). Both are read to be measured, so stage tables are best.

    The table is broadcast only after its content was measured. Beyond the limit both sides are shuffled. A word that makes up a
    third of a corpus must not land in one task then: the hot keys of ``facts`` are found first, and only those are cut into pieces,
    in proportion to their rows, by a hash of the other columns. Their few rows of ``table`` are copied for each piece; other keys pay nothing.
    """
    if fits_broadcast(table):
        return facts.join(F.broadcast(table), on, "left")
    hot = hot_keys(facts, on)
    if not hot:
        return facts.join(table, on, "left")
    schema = StructType([StructField("_hot", facts.schema[on].dataType), StructField("_pieces", IntegerType())])
    known = F.broadcast(facts.sparkSession.createDataFrame(list(hot.items()), schema))

    def with_pieces(df: DataFrame) -> DataFrame:
        return df.join(known, df[on].eqNullSafe(known["_hot"]), "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1))).drop("_hot")

    spread = with_pieces(table).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    others = [c for c in facts.columns if c != on]
    salt = F.pmod(F.xxhash64(*(others or [on])), F.col("_pieces")).cast("int")
    salted = with_pieces(facts).withColumn("_salt", salt).drop("_pieces")
    return salted.join(spread, [on, "_salt"], "left").drop("_salt")


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about SLICE elements of an array column, a longer row alone."""
    ends = batch.column(column).offsets.to_numpy()
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def in_slices(work: Callable[..., pa.Array], *columns: pa.Array, by: int) -> pa.Array:
    """``work`` of all columns, a slice of the array column ``by`` at a time."""
    batch = pa.RecordBatch.from_arrays(list(columns), names=[str(i) for i in range(len(columns))])
    return pa.concat_arrays([work(*part.columns) for part in sliced(batch, by)] or [work(*columns)])


def lengths(lists: pa.ListArray) -> np.ndarray:
    """Elements per row, none where it is NULL."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def as_lists(ends: np.ndarray, values: pa.Array, like: pa.ListArray) -> pa.ListArray:
    """Lists that end at ``ends`` of the values, NULL where ``like`` is."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values, mask=like.is_null())


def lookup_elements(
    df: DataFrame, keep: Sequence[str], elements: Column, table: DataFrame, on: str, value: str, name: str
) -> DataFrame:
    """``keep`` and ``name``: an array with the ``value`` of each element of an array, NULL where ``table`` lacks it.

    ``table (on, value)`` is unique on ``on``. After its content was measured it travels with the tasks, and arrays are
    looked up where they lie, a slice of an Arrow column at a time: no shuffle, and repeated rows stay rows. Beyond the limit
    elements are spread, joined as in ``lookup`` and put together again by row. A NULL array counts as an empty one.
    """
    pairs = table.select(on, value)
    rows = df.select(*keep, F.coalesce(elements, F.array().cast(ArrayType(table.schema[on].dataType))).alias(name))
    if fits_broadcast(pairs):
        known = pairs.toArrow()
        keys = known.column(on).to_pylist()
        values = pa.concat_arrays(known.column(value).chunks or [pa.array([], known.schema.field(value).type)])

        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            value_set = None
            for batch in batches:
                if value_set is None:
                    value_set = pa.array(keys, batch.type.value_type)
                yield in_slices(one_slice(value_set), batch, by=0)

        def one_slice(value_set: pa.Array) -> Callable[[pa.Array], pa.Array]:
            return lambda lists: as_lists(np.cumsum(lengths(lists)), values.take(pc.index_in(lists.flatten(), value_set=value_set)), like=lists)

        # Only the array itself goes through Python.
        return rows.select(*keep, F.arrow_udf(found, ArrayType(table.schema[value].dataType))(name).alias(name))
    of = F.struct(*[F.col(c) for c in keep]).alias("_of")
    # Numbered before the explosion, so that all elements of a row share its number.
    numbered = rows.select(of, name).withColumn("_row", F.monotonically_increasing_id())
    spread = numbered.select("_row", "_of", F.posexplode_outer(name).alias("_pos", on))
    # The row itself travels with its first element only.
    spread = spread.withColumn("_of", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_of")))
    entry = F.when(F.col("_pos").isNotNull(), F.struct("_pos", value))
    grouped = lookup(spread, pairs, on).groupBy("_row").agg(
        F.first("_of", ignorenulls=True).alias("_of"), F.array_sort(F.collect_list(entry)).alias("_all")
    )
    return grouped.select("_of.*", F.transform("_all", lambda e: e[value]).alias(name))
