"""Scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.functions.text import has_ink
from corpusloom.sources import schemas


def corpus(spark: SparkSession, root: str, name: str, config: str | None = None, schema: str | None = None) -> DataFrame:
    """A named corpus below ``root``, in one of its configurations."""
    path = "/".join(p for p in (root.rstrip("/"), name, config) if p)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def saved(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A saved dataset; ``split`` prunes to that partition."""
    df = spark.read.parquet(path)
    return df if split is None else df.where(F.col("split") == split)


def text_files(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """csv, json or txt by extension; a txt file gives one row per line.

    Columns go by name. ``multi_line`` allows line ends inside quoted csv cells, at the price of unsplittable files.
    """
    extension = path.rsplit(".", 1)[-1]
    if extension == "txt":
        return spark.read.text(path).withColumnRenamed("value", "text")
    if extension not in ("csv", "json"):
        raise ValueError(f"a csv, a json or a txt file is needed, not {extension}")
    if extension == "json":
        return _named(spark.read.json(path), schema)
    # The header names the columns; inference is off, so it reads one line and every column is a string.
    return _named(spark.read.csv(path, header=True, multiLine=multi_line, escape='"'), schema)


def _named(df: DataFrame, schema: str | StructType | None) -> DataFrame:
    """The columns that ``schema`` names, by name and in its types, NULL where the file has none; all without a schema."""
    if schema is None:
        return df
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def arriving(
    spark: SparkSession,
    folder: str,
    schema: str | StructType,
    only: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files as a stream. ``only`` is a file-name pattern."""
    reader = spark.readStream.schema(schema)
    if only:
        reader = reader.option("pathGlobFilter", only)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


ONE_SPLIT = 128 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of less than one split over all task slots.

    A small table often is one row group, which a single task would have to read and process. The check looks at file
    sizes only; larger tables keep their own splits and are not shuffled.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    if not files or len(files) >= spark.sparkContext.defaultParallelism:
        return df
    size = spark.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return df.repartition(spark.sparkContext.defaultParallelism) if size < ONE_SPLIT else df


def text_column(df: DataFrame) -> Column:
    """The column to read text from: ``text``, else the first."""
    return F.col("text" if "text" in df.columns else df.columns[0])


def with_text(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the text column (as ``text``) and the columns to keep."""
    return df.select(*keep, text_column(df).alias("text"))


def non_empty(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(F.col(text).isNotNull() & has_ink(F.col(text)))
