"""Expressions over token-id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the RoBERTa convention and the "ignore" label.
START, PAD, END, SEPARATOR_ID = 0, 1, 2, 3
IGNORE = -100


def _int(value: int) -> Column:
    return F.lit(value).cast("int")


def _fill(value: int, times: Column) -> Column:
    return F.array_repeat(_int(value), times.cast("int"))


def fit_ids(ids: Column, length: int | Column, pad: int = PAD, end: int | None = END) -> Column:
    """Exactly ``length`` ids: longer rows are cut (and closed with ``end``), shorter ones padded."""
    size = F.lit(length) if isinstance(length, int) else length
    cut = F.slice(ids, F.lit(1), size) if end is None else F.concat(F.slice(ids, F.lit(1), size - 1), F.array(_int(end)))
    return (
        F.when(F.size(ids) > size, cut)
        .when(F.size(ids) < size, F.concat(ids, _fill(pad, size - F.size(ids))))
        .otherwise(ids)
    )


def fit_mask(mask: Column, length: int | Column, pad: int) -> Column:
    return fit_ids(mask, length, pad=pad, end=None)


def keep_last(values: Column, length: int) -> Column:
    """The first ``length - 1`` elements and the last one."""
    return F.when(
        F.size(values) > length, F.concat(F.slice(values, 1, length - 1), F.slice(values, -1, 1))
    ).otherwise(values)


def ones_like(ids: Column) -> Column:
    return F.when(ids.isNotNull(), _fill(1, F.size(ids)))


def zeros_like(ids: Column) -> Column:
    return F.when(ids.isNotNull(), _fill(0, F.size(ids)))


def before_separator(values: Column, ids: Column, separator: int = SEPARATOR_ID) -> Column:
    """``values`` left of the first separator in ``ids``; NULL without one."""
    at = F.array_position(ids, _int(separator)).cast("int")
    return F.when(at > 0, F.slice(values, F.lit(1), at - 1))


def after_separator(values: Column, ids: Column, separator: int = SEPARATOR_ID) -> Column:
    at = F.array_position(ids, _int(separator)).cast("int")
    return F.when(at > 0, F.slice(values, at + 1, F.size(values)))


def unmask(ids: Column, labels: Column) -> Column:
    """Put the labels back over the masked ids."""
    return F.zip_with(ids, labels, lambda i, label: F.when(label != IGNORE, label).otherwise(i))


def argmax(scores: Column) -> Column:
    """0-based position of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def round_up(size: Column, multiple: int) -> Column:
    return (F.ceil(size / F.lit(float(multiple))) * multiple).cast("int")


def replacements(length: Column, share: Column, wanted: float | Column) -> Column:
    """How many tokens to replace to lift ``share`` to ``wanted``; truncated like Python's ``int``."""
    return F.greatest((length * ((wanted if isinstance(wanted, Column) else F.lit(wanted)) - share)).cast("int"), F.lit(0))
