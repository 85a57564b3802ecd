"""Weighted interleaving of corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.draws import uniform
from corpusloom.operators.index import row_index
from corpusloom.sources.stage import staged

SLOT_BLOCKS = 4096


def _drawn_source(slot: str, weights: Sequence[float], seed: int) -> Column:
    """The source that a slot draws from, by cumulative weight."""
    total = sum(weights)
    edges = [w / total for w in accumulate(weights)]
    u = uniform(seed, slot)
    choice = F.lit(len(weights) - 1)
    for number in reversed(range(len(weights) - 1)):
        choice = F.when(u < F.lit(edges[number]), number).otherwise(choice)
    return choice


def _slots(spark: SparkSession, start: int, end: int, block: int, weights: Sequence[float], seed: int) -> DataFrame:
    return spark.range(start, end).select(
        F.col("id").alias("slot"),
        F.expr(f"id div {block}L").alias("block"),
        _drawn_source("id", weights, seed).alias("source_no"),
    )


def _ranked(slots: DataFrame, before: pa.Table) -> DataFrame:
    """Number each source's slots; ``before`` holds the source's slots in earlier blocks (≤ blocks x sources rows)."""
    inside = Window.partitionBy("block", "source_no").orderBy("slot")
    rank = F.row_number().over(inside).cast("bigint") - 1
    offsets = slots.sparkSession.createDataFrame(before)
    joined = slots.join(F.broadcast(offsets), ["block", "source_no"])
    return joined.select("slot", "source_no", (F.col("before") + rank).alias("rank"))


def _blocks_until_exhausted(totals: list, sizes: Sequence[int]) -> tuple[pa.Table, int | None]:
    """Slots of each source before each block, up to the block in which a first source runs out."""
    seen = [0] * len(sizes)
    rows, stop = [], None
    for bar in totals:
        if stop is not None and bar["block"] > stop:
            break
        source = bar["source_no"]
        rows.append((bar["block"], source, seen[source]))
        seen[source] += bar["count"]
        if seen[source] >= sizes[source]:
            stop = bar["block"]
    types = {"block": pa.int64(), "source_no": pa.int32(), "before": pa.int64()}
    columns = [[row[i] for row in rows] for i in range(len(types))]
    return pa.table({name: pa.array(c, types[name]) for name, c in zip(types, columns, strict=True)}), stop


def draw_slots(spark: SparkSession, sizes: Sequence[int], weights: Sequence[float], seed: int) -> DataFrame:
    """The output slots ``(slot, source_no, rank)`` up to the one in which a first source gives its last row.

    A source that is empty from the start ends the output before its first draw. Draws are summed per block of slots;
    only those block totals (at most 4,096 per source) reach the driver, which finds the block where a source runs out.
    That one block is then numbered to find the exact slot, so the main plan holds no slot that is thrown away.
    """
    wanted = sum(sizes)
    block = max(1, -(-wanted // SLOT_BLOCKS))
    drawn = _slots(spark, 0, wanted, block, weights, seed).groupBy("block", "source_no").count()
    before, stop_block = _blocks_until_exhausted(drawn.orderBy("block", "source_no").collect(), sizes)
    if stop_block is None:
        return _ranked(_slots(spark, 0, wanted, block, weights, seed), before)
    last = F.array(*[F.lit(size).cast("bigint") for size in sizes])[F.col("source_no")] - 1
    start = stop_block * block
    edge = (
        _ranked(_slots(spark, start, min(start + block, wanted), block, weights, seed), before)
        .where(F.col("rank") >= last)
        # An exhausted source ends the output with its last row, an empty one before its first.
        .agg(F.min(F.when(last < 0, F.col("slot") - 1).otherwise(F.col("slot"))).alias("stop"))
        .first()["stop"]
    )
    end = wanted if edge is None else edge + 1
    return _ranked(_slots(spark, 0, end, block, weights, seed), before)


def interleave(
    sources: Sequence[DataFrame], weights: Sequence[float], seed: int, key: str, name: str = "row_idx"
) -> DataFrame:
    """Mix tables of one schema by weight, keeping each one's order by ``key``, until the first runs out.

    Every output slot draws a source and takes its next row. Ranks are computed on keys alone, which are staged because
    three jobs read them; wide rows beyond the keys that the mixture takes stay where they lie, and the others are
    shuffled once, in the last join.
    """
    if len(sources) != len(weights):
        raise ValueError("one weight per source")
    keys = staged(tagged(sources).select("source_no", key), "keys")
    picks = staged(pick_rows(keys, weights, seed, key, name), "picks")
    return tagged(within(sources, picks, key)).join(picks, ["source_no", key])


def within(sources: Sequence[DataFrame], picks: DataFrame, key: str) -> list[DataFrame]:
    """The sources, each cut to the range of keys that ``picks (source_no, key)`` takes from it: a filter with literals,
    which reaches the scan and keeps all other rows out of the join."""
    ends = picks.groupBy("source_no").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    spans = {end["source_no"]: F.col(key).between(end["lo"], end["hi"]) for end in ends}
    return [source.where(spans.get(n, F.lit(False))) for n, source in enumerate(sources)]


def tagged(parts: Sequence[DataFrame]) -> DataFrame:
    """The union of the parts, each row with the number of its part."""
    return reduce(DataFrame.unionByName, [part.withColumn("source_no", F.lit(n)) for n, part in enumerate(parts)])


def pick_rows(
    keys: DataFrame, weights: Sequence[float], seed: int, key: str, name: str = "row_idx"
) -> DataFrame:
    """Which rows the mixture takes and where they go, ``(source_no, key, name)``, from a table ``(source_no, key)``."""
    counts = {row["source_no"]: row["count"] for row in keys.groupBy("source_no").count().collect()}
    slots = draw_slots(keys.sparkSession, [counts.get(n, 0) for n in range(len(weights))], weights, seed)
    ranks = row_index(keys, key, "rank", by=["source_no"])
    return ranks.join(slots, ["source_no", "rank"]).select("source_no", key, F.col("slot").alias(name))
