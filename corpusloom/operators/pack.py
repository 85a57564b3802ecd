"""Pack token rows into fixed-length chunks, and pad rows per batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.tokens import PAD, fit_ids, fit_mask, round_up
from corpusloom.operators.index import batch_number, row_index
from corpusloom.operators.lookup import BROADCAST_VALUES

BATCH_ROWS = 1000


def _places(sizes: DataFrame, key: str, batch_rows: int, numbered: bool) -> DataFrame:
    """``(key, batch, start, total)``: where each row begins in its batch's concatenation. Works on two numbers a row."""
    numbers = sizes.withColumn("row_idx", F.col(key)) if numbered else row_index(sizes, key)
    batched = numbers.withColumn("batch", batch_number(F.col("row_idx"), batch_rows))
    before = Window.partitionBy("batch").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("batch")
    return batched.select(
        key,
        "batch",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(whole).alias("total"),
    )


def pack_chunks(
    rows: DataFrame,
    key: str,
    length: int,
    columns: Sequence[str] = ("input_ids",),
    batch_rows: int = BATCH_ROWS,
    size: str | None = None,
    numbered: bool = False,
) -> DataFrame:
    """Concatenate the rows of each batch of ``batch_rows`` in key order and cut the result into chunks of ``length``;
    a batch's remainder is dropped. Gives ``(batch, chunk, …columns)``.

    Positions come from row sizes alone. A row then sends one slice to each chunk that it touches, so the shuffle moves
    slices instead of single tokens and no task holds more than one chunk's ``length`` tokens per group. ``size`` names
    a column that already holds the row's length, which spares reading the arrays for the sizes. ``numbered`` says that the keys
    are the rows' numbers already, the first of a batch among them.

    The places of a bounded number of rows go to where the arrays lie; beyond, both move by key. The arrays themselves are never
    broadcast: files say little of their size, since masks take next to no room there.
    """
    n = F.size(columns[0]) if size is None else F.col(size)
    places = _places(rows.select(key, n.cast("bigint").alias("n")), key, batch_rows, numbered)
    few = rows.select(key).count() * len(places.columns) <= BROADCAST_VALUES
    ends = F.col("start") + F.size(columns[0])
    placed = (
        rows.select(key, *columns)
        .where(F.size(columns[0]) > 0)
        .join(F.broadcast(places) if few else places.hint("merge"), key)
        .withColumn("first", F.expr(f"start div {length}"))
        .withColumn("last", F.least(F.expr(f"(start + size({columns[0]}) - 1) div {length}"), F.expr(f"total div {length} - 1")))
        .where(F.col("last") >= F.col("first"))
        .withColumn("chunk", F.explode(F.sequence("first", "last")))
    )
    skip = F.greatest(F.col("chunk") * length - F.col("start"), F.lit(0))
    take = F.least((F.col("chunk") + 1) * length, ends) - F.col("start") - skip
    slices = placed.select(
        "batch",
        "chunk",
        "start",
        *[F.slice(F.col(c), (skip + 1).cast("int"), take.cast("int")).alias(c) for c in columns],
    )
    entry = F.sort_array(F.collect_list(F.struct("start", *columns)))
    grouped = slices.groupBy("batch", "chunk").agg(entry.alias("e"))
    return grouped.select(
        "batch",
        "chunk",
        *[_joined(c).alias(c) for c in columns],
    )


def _joined(column: str) -> Column:
    return F.flatten(F.transform("e", lambda e: e[column]))


def pad_batches(rows: DataFrame, row_idx: str, batch_rows: int, multiple: int = 8) -> DataFrame:
    """Pad ids (with the pad id) and attention mask (with 0) to the longest row of the batch, rounded up."""
    batched = rows.withColumn("batch", batch_number(F.col(row_idx), batch_rows))
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch"))
    width = F.col("width")
    return batched.withColumn("width", round_up(longest, multiple)).withColumns(
        {
            "input_ids": fit_ids(F.col("input_ids"), width, PAD),
            "attention_mask": fit_mask(F.col("attention_mask"), width, 0),
        }
    )
