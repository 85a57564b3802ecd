"""Seeded draws that depend only on the row's own key.

A draw is a slice of ``md5(seed:key…)``, so a row gets the same draw in every run, on every executor and after a retry,
which ``rand()`` cannot promise.
"""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ORDER_BITS = 60
#: Positions whose digits a task keeps at hand.
WRITTEN = 1 << 16


def _joined(seed: int | str, keys: tuple[str | Column, ...]) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])


def _digest(seed: int | str, keys: tuple[str | Column, ...]) -> Column:
    return F.md5(_joined(seed, keys))


def digest(seed: int | str, *keys: str | Column) -> Column:
    """The whole draw, for callers that need several independent numbers from one hash (see ``part``)."""
    return _digest(seed, keys)


def part(draw: Column, number: int) -> Column:
    """The ``number``-th (0 to 3) double in [0, 1) of a digest."""
    return F.conv(F.substring(draw, 8 * number + 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def order_key(seed: int | str, *keys: str | Column) -> Column:
    """A 60-bit integer that orders rows at random (ties are broken by the row key)."""
    return F.conv(F.substring(_digest(seed, keys), 1, 15), 16, 10).cast("bigint")


def uniform(seed: int | str, *keys: str | Column) -> Column:
    """A double in [0, 1)."""
    return part(_digest(seed, keys), 0)


# ---------------------------------------------------------------------------------------------------------------------
# Draws for the positions of a row, in Arrow batches

_digits = [b"%d" % i for i in range(WRITTEN)]


def stem(seed: int | str, *keys: str | Column) -> Column:
    """What the draws of a row's positions have in common, as bytes: see ``position_digests``."""
    return _joined(seed, keys).cast("binary")


def position_digests(stem: bytes, positions: Iterable[int]) -> np.ndarray:
    """``digest(seed, *keys, position)`` for many positions of one row, as four 32-bit numbers each."""
    begun = md5(stem + b":")
    drawn = []
    for pos in positions:
        one = begun.copy()
        one.update(_digits[pos] if pos < WRITTEN else b"%d" % pos)
        drawn.append(one.digest())
    return np.frombuffer(b"".join(drawn), ">u4").reshape(-1, 4)


def position_parts(digests: np.ndarray, number: int) -> np.ndarray:
    """``part`` of each digest."""
    return digests[:, number] / 4294967296.0


def position_orders(digests: np.ndarray) -> np.ndarray:
    """The ``order_key`` of each digest."""
    return (digests[:, 0].astype(np.uint64) << np.uint64(32) | digests[:, 1]) >> np.uint64(64 - ORDER_BITS)
