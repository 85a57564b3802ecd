"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a null key counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: str) -> Column:
    """The text with A-Z lowered and every other character as it is.

    ``lower`` also lowers other scripts, so it only sees texts whose every character is one byte.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower))


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores behind it as no column of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a staged table of narrow rows is small enough to broadcast."""
    return table.count() <= rows


def matched(docs: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join on keys that may be null; the narrow (staged) keys are broadcast only when they were counted."""
    same = [docs[c].eqNullSafe(keys[c]) for c in on]
    return docs.join(F.broadcast(keys) if small(keys) else keys, same, how)


def batches(schema: pa.Schema, columns: Iterable[Iterable]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def pieces(data: bytes, size: int, overlap: int) -> Iterator[bytes]:
    """The bytes in pieces of ``size`` that share ``overlap`` bytes, so that a long text needs bounded memory."""
    for start in range(0, max(1, len(data) - overlap), size):
        yield data[start : start + size + overlap]
