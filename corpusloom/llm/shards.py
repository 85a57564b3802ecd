"""Shards of bounded size by extendible hashing.

A directory is indexed by the first bits of a row's hash. A bucket that holds more bytes than the limit is split on one
more bit, and only such a bucket; the others keep their shorter prefix. Sizes are summed over the finest prefixes of a
round and rolled up, so one round settles ``STEP`` levels with two small aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import unused
from corpusloom.sources.stage import staged

BITS = 60
STEP = 15
LIMIT = 1 << 20


def hash_bits(key: str, text: str) -> Column:
    """60 bits of a row as a long: of its key and its text, so that rows that share one of them still part."""
    whole = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def directory(sizes: DataFrame, limit: int, done: int) -> DataFrame:
    """``cell, depth, shard_bytes, shard_docs`` of the cells that fit at some depth of this round.

    ``sizes`` holds ``cell`` (the first ``done + STEP`` bits), ``n_bytes`` and ``n_docs``. A bucket fits if it is within
    the limit or holds one row only.
    """
    first = done if done == 0 else done + 1
    deep = sizes.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(done + STEP))))
    deep = deep.withColumn("prefix", F.expr(f"shiftright(cell, {done + STEP} - depth)"))
    buckets = deep.groupBy("depth", "prefix").agg(
        F.sum("n_bytes").alias("shard_bytes"), F.sum("n_docs").alias("shard_docs")
    )
    fits = buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    shallow = F.min(F.struct("depth", "shard_bytes", "shard_docs")).alias("d")
    return deep.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"]).groupBy("cell").agg(shallow).select("cell", "d.*")


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` with ``n_bytes``, ``shard`` (its bits), ``depth``, ``shard_bytes`` and ``shard_docs``.

    The size of a row is that of its text in UTF-8, 0 if null. No shard is above the limit, but for one that holds a
    single larger row. Rows that agree in key and text share all bits; where such copies alone exceed the limit they are
    numbered and cut into shards ``bits-0``, ``bits-1`` and so on. An empty table gives no rows. Columns of ``docs`` with
    the names of new ones are replaced. The directory of the first round has at most 2^15 cells and is broadcast; the rows
    never move. Deeper rounds join on the cell, which a hash spreads evenly.
    """
    bits, own, at = (unused(name, docs) for name in ("_hash", "_cell", "_at"))
    wide = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"), bits: hash_bits(key, text)})
    narrow = staged(wide.select(F.col(bits).alias("_hash"), "n_bytes"), "sizes")
    rows, sizes, parts = wide.drop("shard", "depth", "shard_bytes", "shard_docs"), narrow, []
    for done in range(0, BITS, STEP):
        cell = F.expr(f"shiftright(_hash, {BITS - done - STEP})")
        cells = staged(
            sizes.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_docs")), "cells"
        )
        found = staged(directory(cells, limit, done), "directory")
        found = F.broadcast(found) if done == 0 else found
        placed = rows.withColumn(own, F.expr(f"shiftright(`{bits}`, {BITS - done - STEP})"))
        shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(
            F.expr(f"lpad(bin(shiftright(`{bits}`, {BITS} - depth)), depth, '0')")
        )
        parts.append(placed.join(found.withColumnRenamed("cell", own), own).withColumn("shard", shard).drop(own, bits))
        left = cells.join(found, "cell", "left_anti").select("cell")
        if left.isEmpty():
            break
        left = staged(left, "oversized")
        left = F.broadcast(left) if done == 0 else left
        rows = placed.join(left.withColumnRenamed("cell", own), own, "left_semi").drop(own)
        sizes = staged(sizes.withColumn("cell", cell).join(left, "cell", "left_semi").drop("cell"), "sizes")
    else:
        fit = F.greatest(F.floor(F.lit(limit) / F.col("n_bytes")), F.lit(1))
        order = Window.partitionBy(bits).orderBy(bits)
        numbered = rows.withColumn(at, F.floor((F.row_number().over(order) - 1) / fit))
        total = Window.partitionBy(bits, at)
        parts.append(
            numbered.withColumns(
                {
                    "shard": F.concat_ws("-", F.lpad(F.bin(bits), BITS, "0"), F.col(at).cast("string")),
                    "depth": F.lit(BITS),
                    "shard_bytes": F.sum("n_bytes").over(total),
                    "shard_docs": F.count(F.lit(1)).over(total),
                }
            ).drop(at, bits)
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def oracle(limit: int = LIMIT) -> str:
    """DuckDB SQL for doc_id, n_bytes, shard, depth, shard_bytes and shard_docs of ``documents``."""
    return f"""
    WITH d AS (
      SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
             lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15)
                           AS BIGINT)), {BITS}, '0') AS bits
      FROM documents),
    e AS (SELECT d.*, k AS depth, left(bits, k) AS shard FROM d, (SELECT unnest(range(0, {BITS + 1})) AS k)),
    b AS (SELECT shard, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs FROM e GROUP BY shard)
    SELECT doc_id, n_bytes, shard, CAST(depth AS INTEGER) AS depth, shard_bytes, shard_docs
    FROM e JOIN b USING (shard)
    WHERE shard_bytes <= {limit} OR shard_docs = 1
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1"""
