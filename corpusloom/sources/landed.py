"""Scans of landed responses: JSON lines whose nested schemas are declared once, with a reason for each record that is of no use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from corpusloom.sources import schemas

#: Reasons: the line is no such record; the server did not answer with it; a field is missing.
MALFORMED, REFUSED, INCOMPLETE = "malformed", "refused", "incomplete"
#: Statuses of an answer and of "there is none".
FOUND, ABSENT = 200, 404

KINDS = {"hits": schemas.SEARCH_PAGE, "metadata": schemas.METADATA, "trees": schemas.TREE, "blobs": schemas.BLOB}


def landed(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """``(…, status, error)`` of every line below ``root/kind``; ``error`` is NULL where the record can be used.

    A line without ``status`` counts as answered. The reason reads every declared field, so that what counts as malformed does
    not change with the columns that a caller goes on to select.
    """
    declared = StructType.fromDDL(KINDS[kind])
    read = StructType([*declared, StructField("status", IntegerType()), StructField("_line", StringType())])
    rows = spark.read.schema(read).option("columnNameOfCorruptRecord", "_line").json(f"{root.rstrip('/')}/{kind}")
    missing = reduce(Column.__or__, [F.col(f.name).isNull() for f in declared])
    reason = (
        F.when(F.col("_line").isNotNull(), MALFORMED)
        .when(F.coalesce("status", F.lit(FOUND)) != FOUND, REFUSED)
        .when(missing, INCOMPLETE)
    )
    return rows.select(*declared.names, "status", reason.alias("error"))


def usable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNull()).drop("error", "status")


def failures(parts: dict[str, DataFrame]) -> DataFrame:
    """``(kind, error, n)``: how many records of each kind failed, by reason."""
    counted = [
        rows.where(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "error", "n")
        for kind, rows in parts.items()
    ]
    return reduce(DataFrame.unionByName, counted)
