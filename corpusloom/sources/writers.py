"""Sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Named splits as one table with a ``split`` column."""
    tagged = [df.withColumn("split", F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


def without_split(df: DataFrame, name: str = "test") -> DataFrame:
    return df.where(F.col("split") != name)


def save(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per split, so a reader of one split opens only its files."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def save_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def save_vocabulary(vocab: DataFrame, path: str, mode: str = "errorifexists") -> None:
    vocab.select("token", "idx").write.mode(mode).json(path)


def save_ids(ids: DataFrame, path: str, mode: str = "errorifexists") -> None:
    ids.select("idx").write.mode(mode).parquet(path)


def load_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("idx int").parquet(path)


# The name list of the search step is a set, encoded to a string and then encoded once more.
_SET = "`py/set` array<string>"


def name_list(names: DataFrame, name: str = "repo", part_rows: int = 10_000) -> DataFrame:
    """Names as twice-encoded sets, ``(value)``. The list is cut into hash parts of about ``part_rows`` names, so that
    no task collects it whole; the reader takes any number of parts."""
    parts = -(-names.count() // part_rows) or 1
    part = F.pmod(F.xxhash64(name), F.lit(parts))
    packed = names.groupBy(part.alias("part")).agg(F.array_sort(F.collect_set(name)).alias("py/set"))
    inner = F.to_json(F.struct(F.col("`py/set`")))
    wrapped = F.to_json(F.struct(inner.alias("s")))
    # {"s":"…"} without its frame is the inner text as a JSON string.
    return packed.select(F.substr(wrapped, F.lit(6), F.length(wrapped) - 6).alias("value"))


def read_name_list(lines: DataFrame, name: str = "repo") -> DataFrame:
    """Decode ``(value)`` twice and list the names."""
    wrapped = F.concat(F.lit('{"s":'), F.col("value"), F.lit("}"))
    text = F.from_json(wrapped, "s string")["s"]
    return lines.select(F.explode(F.from_json(text, _SET)["py/set"]).alias(name)).distinct()
