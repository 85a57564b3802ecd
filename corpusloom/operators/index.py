"""Row order without a one-partition sort: global row numbers, exact rank cuts, splits and sized samples.

Two tools carry everything that the order of rows decides:

* ``keys_at_ranks`` finds the keys of the rows with given ranks by narrowing a histogram over the key. Splitting, "first n"
  and sized samples then are a comparison with a literal: the texts are filtered where they lie and never shuffled.
* ``row_index`` numbers all rows. Rows go to cells of the key, as many as the rows need, every cell is numbered on its own, and the cell
  totals (a small table) supply the offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.draws import ORDER_BITS, order_key

GRID = 4096
LEAF_ROWS = 200_000
#: How many times the parts of a cell are smaller than LEAF_ROWS, were its keys spread evenly.
SPARE = 4


def order_at_random(df: DataFrame, key: str, seed: int, name: str = "_order") -> DataFrame:
    """Add the seeded order key that stands for a shuffle."""
    return df.withColumn(name, order_key(seed, key))


# ---------------------------------------------------------------------------------------------------------------------
# Rank cuts


def key_range(df: DataFrame, key: str) -> tuple[int, int, int]:
    """(rows, smallest, largest key). Parquet answers this from its footers."""
    row = df.agg(F.count(key).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    return row["n"], row["lo"], row["hi"]


def key_at_rank(df: DataFrame, key: str, rank: int, tie: str | None = None, within: tuple | None = None) -> tuple:
    """The ``(key, tie)`` of the row with 0-based ``rank`` in ascending order; ``key`` is an integer column."""
    return keys_at_ranks(df, key, [rank], tie, within)[rank]


def keys_at_ranks(
    df: DataFrame, key: str, ranks: Sequence[int], tie: str | None = None, within: tuple | None = None
) -> dict[int, tuple]:
    """The ``(key, tie)`` of each of a few ranks, all found in one descent.

    Each round counts the rows of at most 4,096 equal cells of every key range that still holds a rank and too many rows, and goes
    on inside the cells that hold the ranks: six rounds for 64-bit keys at worst, whatever their distribution, one for dense ids,
    none for small tables. Only histograms reach the driver. What is left of a range is sorted on its own.
    """
    columns = [key] if tie is None else [key, tie]
    narrow = df.select(*columns)
    rows, lo, hi = within or key_range(narrow, key)
    places = {}
    for rank in ranks:
        if not 0 <= rank < rows:
            raise ValueError(f"rank {rank} is outside 0..{rows - 1}")
        places[rank] = (lo, hi, rows, rank)
    while spans := sorted({(lo, hi) for lo, hi, n, _ in places.values() if n > LEAF_ROWS and hi > lo}):
        cell = F.coalesce(*[F.when(F.col(key).between(*s), F.struct(F.lit(i).alias("span"), _grid(key, *s).alias("cell"))) for i, s in enumerate(spans)])
        # No range but the first holds the whole table; the condition reaches the scan.
        inside = reduce(or_, [F.col(key).between(*s) for s in spans])
        bars = narrow.where(inside).groupBy(cell.alias("at")).count().orderBy("at").collect()
        for rank, (lo, hi, n, before) in places.items():
            if n <= LEAF_ROWS or hi == lo:
                continue
            width = (hi - lo) // GRID + 1
            for bar in bars:
                if bar["at"]["span"] != spans.index((lo, hi)):
                    continue
                if before < bar["count"]:
                    first = lo + bar["at"]["cell"] * width
                    places[rank] = (first, min(hi, first + width - 1), bar["count"], before)
                    break
                before -= bar["count"]
    found = {rank: (lo,) for rank, (lo, hi, _, _) in places.items() if lo == hi and tie is None}
    leaves: dict[tuple, dict[int, int]] = {}
    for rank, (lo, hi, _, before) in places.items():
        if rank not in found:
            leaves.setdefault((lo, hi), {})[before] = rank
    for span, wanted in leaves.items():
        first, last = min(wanted), max(wanted)
        near = narrow.where(F.col(key).between(*span)).orderBy(*columns).offset(first).limit(last - first + 1)
        if len(wanted) == 1:
            found[wanted[first]] = tuple(near.first())
            continue
        # Ranks of one leaf: a leaf is bounded, and so is what lies between them.
        order = F.row_number().over(Window.orderBy(*columns)) - 1 + first
        picked = near.withColumn("_at", order).where(F.col("_at").isin(list(wanted)))
        found |= {wanted[r["_at"]]: tuple(r)[:-1] for r in picked.collect()}
    return found


def at_or_after(key: str, cut: tuple, tie: str | None = None) -> Column:
    """True for rows at the cut row or after it."""
    if tie is None:
        return F.col(key) >= F.lit(cut[0])
    return (F.col(key) > F.lit(cut[0])) | ((F.col(key) == F.lit(cut[0])) & (F.col(tie) >= F.lit(cut[1])))


def rank_labels(
    df: DataFrame,
    key: str,
    cuts: Sequence[int],
    labels: Sequence[str],
    name: str = "split",
    tie: str | None = None,
    span: tuple | None = None,
) -> DataFrame:
    """Label rows by rank: ``labels[i]`` for ranks below ``cuts[i]``, the last label for the rest.

    The only jobs are key-only scans; the frame itself gets one narrow CASE expression.
    """
    return df.withColumn(name, rank_label(df, key, cuts, labels, tie, span))


def rank_label(
    keys: DataFrame,
    key: str,
    cuts: Sequence[int],
    labels: Sequence[str],
    tie: str | None = None,
    span: tuple | None = None,
) -> Column:
    """The CASE expression of ``rank_labels``, its cuts taken from ``keys``: for frames whose rows are costly to make."""
    rows, lo, hi = span or key_range(keys.select(key), key)
    label = F.lit(labels[-1])
    edges = keys_at_ranks(keys, key, sorted({c for c in cuts if 0 < c < rows}), tie, within=(rows, lo, hi))
    for cut, text in reversed(list(zip(cuts, labels, strict=False))):
        if cut >= rows:
            label = F.lit(text)
        elif cut > 0:
            label = F.when(~at_or_after(key, edges[cut], tie), text).otherwise(label)
    return label


def first_n(df: DataFrame, key: str, n: int, tie: str | None = None) -> DataFrame:
    """The first ``min(n, rows)`` rows by key, as a filter that reaches the scan. Rows without a key have no rank."""
    rows, lo, hi = key_range(df.select(key), key)
    if n >= rows:
        return df.where(F.col(key).isNotNull())
    if n <= 0:
        return df.where(F.lit(False))
    edge = key_at_rank(df, key, n, tie, within=(rows, lo, hi))
    return df.where(~at_or_after(key, edge, tie))


def percent_cut(rows: int, percent: float) -> int:
    """How many rows ``percent`` of ``rows`` is: the closest integer, halves to even."""
    return round(rows * percent / 100)


def percent_label(keys: DataFrame, key: str, percent: float = 5) -> Column:
    span = key_range(keys.select(key), key)
    return rank_label(keys, key, [percent_cut(span[0], percent)], ["validation", "train"], span=span)


def percent_split(df: DataFrame, key: str, percent: float = 5, name: str = "split") -> DataFrame:
    """The first ``percent`` % of the rows become ``validation``, the rest ``train``."""
    return df.withColumn(name, percent_label(df, key, percent))


def sized_sample(df: DataFrame, key: str, train_rows: int, valid_rows: int, seed: int) -> DataFrame:
    """Shuffle, then take ``train_rows + 1`` rows for training and the next ``valid_rows + 1`` for validation."""
    return sampled(df, df.select(key), key, train_rows, valid_rows, seed)


def sampled(df: DataFrame, keys: DataFrame, key: str, train_rows: int, valid_rows: int, seed: int) -> DataFrame:
    """:func:`sized_sample`, its cuts taken from ``keys``: wide rows only meet a comparison with literals."""
    ends = [train_rows + 1, train_rows + 1 + valid_rows + 1]
    label = rank_label(order_at_random(keys, key, seed), "_order", ends, ["train", "validation", "rest"], tie=key)
    labelled = order_at_random(df, key, seed).withColumn("split", label)
    return labelled.where("split <> 'rest'").drop("_order")


def random_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` random rows for inspection (a top-n by the seeded order, not a full sort)."""
    return order_at_random(df, key, seed).orderBy("_order", key).limit(n).drop("_order")


# ---------------------------------------------------------------------------------------------------------------------
# Row numbers


def _grid(key: str, lo: int, hi: int) -> Column:
    return F.expr(f"({key} - {lo}L) div {(hi - lo) // GRID + 1}L")


def _placed(cell: Column) -> Column:
    """Rows without a key come first, as in an ascending sort."""
    return F.coalesce(cell.cast("bigint"), F.lit(-1).cast("bigint"))


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions)


def _finer(bars: list, names: list[str]) -> dict:
    """The cells where a group has too many rows for one task, each with its smallest key and the width of its parts."""
    most, lo, hi = {}, {}, {}
    for bar in bars:
        cell = tuple(bar[c] for c in names)
        if cell[0] >= 0:
            most[cell] = max(bar["count"], most.get(cell, 0))
            lo[cell], hi[cell] = min(bar["lo"], lo.get(cell, bar["lo"])), max(bar["hi"], hi.get(cell, bar["hi"]))
    parts = {cell: min(GRID, -(-n * SPARE // LEAF_ROWS)) for cell, n in most.items() if n > LEAF_ROWS and hi[cell] > lo[cell]}
    return {cell: (lo[cell], (hi[cell] - lo[cell]) // n + 1) for cell, n in parts.items()}


def _cells(df: DataFrame, key: str, by: Sequence[str], span: tuple) -> tuple[Callable[[DataFrame], DataFrame], list[str], list]:
    """How to place rows in cells in key order, the cell's columns, and the number of rows per group and cell.

    Equal-width cells do for dense ids. Where ids cluster, or rows are many, cells of more than LEAF_ROWS rows are cut again in
    levels, from their smallest to their largest key and by their own count; so the number of cells follows the rows, and a cell
    ends small or as a single key. All edges are literals or small tables, hence the same after a retry.
    """
    _, lo, hi = span
    levels: list[DataFrame] = []
    names = ["_cell"]

    def place(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_cell", _placed(F.lit(None) if lo is None else _grid(key, lo, hi)))
        for n, table in enumerate(levels):
            known = names[: n + 1]
            at = _all(rows[c] == table[f"_of_{c}"] for c in known)
            rows = rows.join(F.broadcast(table), at, "left").withColumn(names[n + 1], F.coalesce(F.expr(f"({key} - _first) div _width"), F.lit(0).cast("bigint")))
            rows = rows.drop("_first", "_width", *[f"_of_{c}" for c in known])
        return rows

    totals = [F.count(F.lit(1)).alias("count"), F.min(key).alias("lo"), F.max(key).alias("hi")]
    while True:
        bars = place(df).groupBy(*by, *names).agg(*totals).orderBy(*by, *names).collect()
        finer = _finer(bars, names)
        if not finer:
            return place, names, bars
        fields = ", ".join(f"{c} bigint" for c in [*(f"_of_{c}" for c in names), "_first", "_width"])
        levels.append(df.sparkSession.createDataFrame([(*cell, *cut) for cell, cut in finer.items()], fields))
        names.append(f"_cell{len(levels)}")


def _offsets(bars: list, by: Sequence[str], cells: Sequence[str]) -> pa.Table:
    """Rows before each cell, per group. ``bars`` comes ordered by group and cell."""
    before, seen = [], {}
    for bar in bars:
        group = tuple(bar[c] for c in by)
        before.append(seen.get(group, 0))
        seen[group] = before[-1] + bar["count"]
    columns = {c: [bar[c] for bar in bars] for c in [*by, *cells]}
    return pa.table({**columns, "_offset": pa.array(before, pa.int64())})


def row_index(
    df: DataFrame,
    key: str,
    name: str = "row_idx",
    by: Sequence[str] = (),
    tie: str | None = None,
    hashed: bool = False,
) -> DataFrame:
    """Number the rows 0, 1, … by an integer ``key`` (per group of ``by``), as one global sort would.

    ``hashed=True`` says that the key is a seeded order key, whose top bits are even cells already. Keys must be
    (nearly) unique, which keeps a cell at about rows / cells even when one group of ``by`` holds most rows; ``by`` is
    for a few groups, such as the sources of a mixture; a NULL group is a group like any other, and rows with a NULL key
    come first in theirs. The driver sees 4,096 totals per group and a few for every 200,000 rows beyond. The key is
    scanned for the totals, so pass narrow frames and join the number back where rows are wide.
    """
    order = [F.col(key)] if tie is None else [F.col(key), F.col(tie)]
    narrow = df.select(*by, key)
    span = (None, 0, (1 << ORDER_BITS) - 1) if hashed else key_range(narrow, key)
    place, cells, bars = _cells(narrow, key, by, span)
    if not bars:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    names = [*by, *cells]
    offsets = df.sparkSession.createDataFrame(_offsets(bars, by, cells)).select(
        *[F.col(c).alias(f"_of_{i}") for i, c in enumerate(names)], "_offset"
    )
    inside = Window.partitionBy(*names).orderBy(*order)
    return (
        place(df)
        .join(F.broadcast(offsets), _all(F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(names)))
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop(*cells, "_offset", *[f"_of_{i}" for i in range(len(names))])
    )


def batch_number(row_idx: Column, rows: int = 1000) -> Column:
    return F.floor(row_idx / F.lit(rows)).cast("bigint")
