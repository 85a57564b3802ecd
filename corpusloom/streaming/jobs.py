"""Encode and pack texts as their files arrive.

Encoding is stateless. Packing carries the rows of an unfilled batch from one arrival to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.encode import encode_with_merges
from corpusloom.operators.index import row_index
from corpusloom.operators.pack import BATCH_ROWS, pack_chunks
from corpusloom.sources.stage import staged


def encode_stream(
    stream: DataFrame,
    key: str,
    words_column: Column,
    merges: Sequence[tuple],
    tokens: dict[str, int],
    out: str,
    checkpoint: str,
    tasks: int | None = None,
) -> StreamingQuery:
    """Encode every arriving text once and append it to ``out``. ``tasks`` spreads arrivals of a few small files."""
    if tasks:
        stream = stream.repartition(tasks)
    encoded = encode_with_merges(stream, key, words_column, merges, tokens)
    return (
        encoded.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def pack_stream(
    stream: DataFrame,
    key: str,
    length: int,
    out: str,
    checkpoint: str,
    columns: Sequence[str] = ("input_ids",),
    batch_rows: int = BATCH_ROWS,
) -> StreamingQuery:
    """Pack rows in the order of their arrival (within one by key), in batches that go on where the last arrival stopped.

    Rows that do not fill a batch yet wait beside ``out``, under the number of the arrival that left them; the next one starts
    from there. An arrival reads what the one before it left and overwrites only its own folders, so a replay after a failure
    gives the same chunks once. :func:`finish_packing` packs the last batch, which is not full, when no more will come.
    """

    def pack(rows: DataFrame, arrival: int) -> None:
        end, held = _waiting(rows.sparkSession, out, arrival - 1)
        new = row_index(rows.select(key, *columns), key, name="_row").select((F.col("_row") + end).alias("_row"), *columns)
        whole = staged(new if held is None else held.unionByName(new), "arrived")
        # Read from the narrow numbers of the stage table: the arrival itself would be decoded once more.
        last = whole.agg(F.max("_row")).first()[0]
        end = end if last is None else last + 1
        full = end // batch_rows * batch_rows
        _packed(whole.where(F.col("_row") < full), length, columns, batch_rows).write.mode("overwrite").parquet(f"{out}/arrival={arrival}")
        rest = whole.where(F.col("_row") >= full).withColumn("_held", F.lit(True))
        # A row that holds nothing tells the number to go on from, also where no row waits.
        number = rest.sparkSession.range(1).select(F.lit(end).cast("bigint").alias("_row"), F.lit(False).alias("_held"))
        rest.unionByName(number, allowMissingColumns=True).write.mode("overwrite").parquet(f"{out}_waiting/arrival={arrival}")

    return (
        stream.writeStream.foreachBatch(pack)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finish_packing(
    spark: SparkSession, out: str, length: int, columns: Sequence[str] = ("input_ids",), batch_rows: int = BATCH_ROWS
) -> None:
    """Pack the rows that still wait, as the last batch. Should more arrive after all, the next arrival takes its place."""
    last = spark.read.parquet(f"{out}_waiting").agg(F.max("arrival")).first()[0]
    _, held = _waiting(spark, out, last)
    _packed(held, length, columns, batch_rows).write.mode("overwrite").parquet(f"{out}/arrival={last + 1}")


def _waiting(spark: SparkSession, out: str, arrival: int) -> tuple[int, DataFrame | None]:
    """The number of the next row, and the rows that the arrival left."""
    if arrival < 0:
        return 0, None
    rows = spark.read.parquet(f"{out}_waiting/arrival={arrival}")
    return rows.where("not _held").first()["_row"], rows.where("_held").drop("_held")


def _packed(rows: DataFrame, length: int, columns: Sequence[str], batch_rows: int) -> DataFrame:
    """The chunks of numbered rows that begin with a batch, under the numbers of their batches."""
    return pack_chunks(rows, "_row", length, columns, batch_rows, numbered=True)
