"""Hard negatives of anchors, found in R-trees that are packed sort-tile-recursively.

All rows are dealt into tiles: borders of the first coordinate make slabs, borders of the next cut each slab, and so on; a tile
that equal values keep too large is split by a hash of its keys. A task packs a tile the same way into leaves of LEAF rows and
boxes of FANOUT leaves, up to a root. A box bounds each coordinate, so each product with an anchor's coordinate lies in an
interval, and their sum bounds the inner products of all rows inside.

A search takes blocks of anchors to tiles. An anchor first visits the tile that it lies in itself, which tells how good its k-th
row is at least; then every other tile whose box can hold better ones. Inside a tile a queue opens boxes by falling upper bound.
A box is passed over if no score window reaches it, or if it lies strictly below the k-th score of each window that does: at an
equal score a smaller key could still come first.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.stage import staged

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)
#: Rows of a tile, and the number of tiles beyond which tiles grow instead: their boxes go to every task.
TILE = 8_192
MAX_TILES = 8_192
LEVELS = 3
LEAF = 256
FANOUT = 8
#: Anchors that meet a tile at once.
BLOCK = 16_384
NO_KEY = 2**63 - 1
ANY = 2**62


def quantised(vectors: DataFrame, key: str, vector: str, label: str, anchors: Column, scale: int) -> DataFrame:
    """``id, label, x, dim, anchor`` of the rows that take part: a label, and a vector of finite entries, floor(scale * entry)."""
    v = F.col(vector)
    good = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    rows = vectors.where(good & F.col(label).isNotNull())
    return rows.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(NO_KEY)).alias("id"),
        F.col(label).cast("bigint").alias("label"),
        x.alias("x"),
        F.size(x).alias("dim"),
        F.coalesce(anchors & F.col(key).isNotNull(), F.lit(False)).alias("anchor"),
    )


def tiled(rows: DataFrame, tile_rows: int) -> tuple[DataFrame, int]:
    """The staged rows with the ``tile`` that each belongs to, and a number of tiles to plan for."""
    total = rows.count()
    size = max(tile_rows, math.ceil(total / MAX_TILES))
    tiles = max(1, math.ceil(total / size))
    slabs = math.ceil(tiles ** (1 / LEVELS))
    rows = rows.withColumn("path", F.lit(0).cast("bigint"))
    if slabs > 1:
        shares = [i / slabs for i in range(1, slabs)]
        for level in range(LEVELS):
            at = F.get("x", F.lit(level))
            borders = staged(rows.groupBy("dim", "path").agg(F.percentile_approx(at, shares).alias("borders")), "borders")
            above = F.size(F.filter("borders", lambda b: b < F.get("x", F.lit(level))))
            rows = rows.join(borders, ["dim", "path"]).withColumn("path", F.col("path") * slabs + F.greatest(above, F.lit(0)))
            rows = rows.drop("borders")
    parts = staged(rows.groupBy("dim", "path").count().select("dim", "path", F.ceil(F.col("count") / size).alias("parts")), "parts")
    tile = F.concat_ws("/", "dim", "path", F.pmod(F.xxhash64("id", "label"), F.col("parts")))
    return rows.join(parts, ["dim", "path"]).select("id", "label", "x", "dim", "anchor", tile.alias("tile")), tiles


def packed_order(x: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The rows in the order of their leaves: slabs of the widest coordinate, cut again until a piece is one leaf."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= leaf or not x.shape[1]:
            done.append(at)
            continue
        own = x[at]
        widest = np.argmax(own.max(0).astype(np.float64) - own.min(0))
        at = at[np.argsort(own[:, widest], kind="stable")]
        leaves = math.ceil(len(at) / leaf)
        # Whole leaves to each slab, the last takes the rest.
        step = math.ceil(leaves / max(2, math.ceil(math.sqrt(leaves)))) * leaf
        todo += [at[i : i + step] for i in range(0, len(at), step)][::-1]
    return np.concatenate(done)


def packer(leaf: int):
    """The function that packs one tile: its distinct rows in the order of their leaves, and its box."""

    def pack(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, dim)
        whole = np.unique(np.column_stack([rows.column("id").to_numpy(), rows.column("label").to_numpy(), x]), axis=0)
        whole = whole[packed_order(whole[:, 2:], leaf)]
        x = np.ascontiguousarray(whole[:, 2:])
        narrow = next(t for t in (np.int16, np.int32, np.int64) if not x.size or max(x.max(), -int(x.min())) <= np.iinfo(t).max)
        cells = {
            "tile": rows.column("tile")[0].as_py(),
            "dim": dim,
            "width": np.dtype(narrow).itemsize,
            "low": x.min(0).tolist(),
            "high": x.max(0).tolist(),
            "ids": np.ascontiguousarray(whole[:, 0]).tobytes(),
            "labels": np.ascontiguousarray(whole[:, 1]).tobytes(),
            "x": x.astype(narrow).tobytes(),
        }
        return pa.Table.from_pylist([cells], PACKED)

    return pack


PACKED = pa.schema(
    {
        "tile": pa.string(), "dim": pa.int32(), "width": pa.int32(), "low": pa.list_(pa.int64()), "high": pa.list_(pa.int64()),
        "ids": pa.binary(), "labels": pa.binary(), "x": pa.binary(),
    }
)
PACKED_SQL = "tile string, dim int, width int, low array<bigint>, high array<bigint>, ids binary, labels binary, x binary"


def exact_type(x: np.ndarray, anchors: np.ndarray) -> type:
    """A type in which no inner product is rounded: double for products below 2^53, then 64-bit numbers, then Python's."""
    most = [max(int(v.max()), -int(v.min())) if v.size else 0 for v in (x, anchors)]
    bound = most[0] * most[1] * max(1, x.shape[1])
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every anchor (rows) and box (columns) the least and the greatest inner product that fits the box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


@dataclass
class Tree:
    """The boxes of a tile: the leaves first, then each level above, the root last."""

    low: np.ndarray
    high: np.ndarray
    children: list[range]

    @classmethod
    def over(cls, x: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> Tree:
        starts = np.arange(0, len(x), leaf)
        low, high = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
        lows, highs, children, first = [low], [high], [range(0)] * len(starts), 0
        while len(low) > 1:
            starts = np.arange(0, len(low), fanout)
            children += [range(first + s, first + min(s + fanout, len(low))) for s in starts.tolist()]
            first += len(low)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            lows.append(low)
            highs.append(high)
        return cls(np.concatenate(lows), np.concatenate(highs), children)


def best_rows(tree: Tree, least: np.ndarray, most: np.ndarray, windows: list[tuple[int, int, int]], k: int, scores_of) -> list[list]:
    """The first ``k`` rows, as (-score, key), of each window ``(low, high, known k-th score)`` of one anchor.

    ``scores_of(leaf)`` gives scores and keys of the rows that count. ``least`` and ``most`` bound the boxes.
    """
    best: list[list] = [[] for _ in windows]
    floor = [max(low, known) for low, _, known in windows]
    queue = [(-most[-1], len(most) - 1)]
    while queue:
        bound, box = heapq.heappop(queue)
        if -bound < min(floor):
            break
        if not any(-bound >= floor[w] and least[box] <= high for w, (_, high, _) in enumerate(windows)):
            continue
        if tree.children[box]:
            for child in tree.children[box]:
                heapq.heappush(queue, (-most[child], child))
            continue
        scores, keys = scores_of(box)
        for w, (_, high, _) in enumerate(windows):
            at = np.flatnonzero((scores >= floor[w]) & (scores <= high))
            if not len(at):
                continue
            found = at[np.lexsort((keys[at], -scores[at]))[:k]]
            best[w] = sorted(best[w] + list(zip((-scores[found]).tolist(), keys[found].tolist(), strict=True)))[:k]
            if len(best[w]) == k:
                floor[w] = max(floor[w], -best[w][-1][0])
    return best


def searched(same: bool, k: int, leaf: int, fanout: int):
    """The function that searches one tile for one block of anchors."""

    def per_tile(tile: pa.Table, block: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        if tile.num_rows and block.num_rows:
            row = {name: tile.column(name)[0].as_py() for name in ("dim", "width", "ids", "labels", "x")}
            ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
            x = np.frombuffer(row["x"], f"i{row['width']}").reshape(len(ids), row["dim"])
            a = block.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, row["dim"])
            exact = exact_type(x, a)
            x, a = x.astype(exact), a.astype(exact)
            tree = Tree.over(x, leaf, fanout)
            least, most = bounds(a, tree.low, tree.high)
            own = zip(*(block.column(c).to_pylist() for c in ("anchor", "id", "label", "windows")), strict=True)
            for n, (anchor, key, label, windows) in enumerate(own):

                def scores_of(box: int, n=n, key=key, label=label) -> tuple[np.ndarray, np.ndarray]:
                    at = slice(box * leaf, (box + 1) * leaf)
                    counts = labels[at] == label if same else labels[at] != label
                    if same:
                        itself = counts & (ids[at] == key)
                        counts = counts & ~(itself & (x[at] == a[n]).all(1))
                    return (x[at] @ a[n])[counts], ids[at][counts]

                asked = [(w["low"], w["high"], w["known"]) for w in windows]
                for w, rows in zip(windows, best_rows(tree, least[n], most[n], asked, k, scores_of), strict=True):
                    for score, found in rows:
                        for column, value in zip(columns, (anchor, w["rank"], -int(score), found), strict=True):
                            column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor", "rank", "score", "key"])

    return per_tile


def routed(queries: DataFrame, directory: list) -> DataFrame:
    """Every query once per tile, other than its own, that may hold rows of one of its windows."""
    boxes = {}
    for dim in {r.dim for r in directory}:
        own = [r for r in directory if r.dim == dim]
        low, high = (np.array([r[c] for r in own], np.int64).reshape(len(own), dim) for c in ("low", "high"))
        boxes[dim] = np.array([r.tile for r in own], object), low, high

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for n, (x, home, windows) in enumerate(zip(*(part.column(c).to_pylist() for c in ("x", "tile", "windows")), strict=True)):
                names, low, high = boxes[len(x)]
                a = np.array([x], np.int64)
                exact = exact_type(np.concatenate([low, high]), a)
                least, most = (b[0] for b in bounds(a.astype(exact), low.astype(exact), high.astype(exact)))
                may = np.zeros(len(names), bool)
                for w in windows:
                    may |= (most >= max(w["low"], w["known"])) & (least <= w["high"])
                goes = names[may & (names != home)]
                if len(goes):
                    same = part.slice(n, 1).take(pa.array(np.zeros(len(goes), np.int64)))
                    at = same.schema.get_field_index("tile")
                    yield pa.RecordBatch.from_arrays(
                        [*same.columns[:at], pa.array(goes, pa.string()), *same.columns[at + 1 :]], schema=part.schema
                    )

    return queries.mapInArrow(per_batch, queries.schema)


def first_rows(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each anchor and window, numbered in ``place``."""
    order = Window.partitionBy("anchor", "rank").orderBy(F.desc("score"), "key")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


@dataclass
class Tiles:
    """The packed tiles (staged), their boxes, and how many blocks the anchors make."""

    rows: DataFrame
    directory: list
    blocks: int
    leaf: int
    fanout: int

    def visited(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """What the queries find in the tiles that they name."""
        tasks = min(2_000, max(1, len(self.directory) * self.blocks))
        block = F.pmod(F.xxhash64("anchor"), F.lit(self.blocks)).cast("int").alias("block")
        asked = queries.select("*", block).repartition(tasks, "tile", "block")
        tiles = self.rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1))).alias("block"))
        tiles = tiles.repartition(tasks, "tile", "block").groupBy("tile", "block")
        return tiles.cogroup(asked.groupBy("tile", "block")).applyInArrow(
            searched(same, k, self.leaf, self.fanout), "anchor bigint, rank int, score bigint, key bigint"
        )

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """The first ``k`` rows of every window of the staged ``queries``: at home, then wherever better ones may be."""
        home = staged(self.visited(queries, same, k), "home")
        known = home.groupBy("anchor", "rank").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        known = known.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("rank", "least"))).alias("known"))
        better = F.transform(
            "windows",
            lambda w: F.struct(
                w["rank"].alias("rank"), w["low"].alias("low"), w["high"].alias("high"),
                F.coalesce(F.get(F.map_values(F.map_filter("known", lambda r, _: r == w["rank"])), F.lit(0)), w["known"]).alias("known"),
            ),
        )
        queries = queries.join(known, "anchor", "left").withColumn("windows", better).drop("known")
        away = self.visited(routed(queries, self.directory), same, k) if len(self.directory) > 1 else home.limit(0)
        return first_rows(home.unionByName(away), k)


def window(rank: Column, low: Column, high: Column) -> Column:
    known = F.lit(-ANY).cast("bigint").alias("known")
    return F.struct(rank.cast("int").alias("rank"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"), known)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    shares: tuple[int, int] = WINDOW,
    scale: int = SCALE,
    tile_rows: int = TILE,
    leaf: int = LEAF,
    fanout: int = FANOUT,
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are inner products of floor(scale * entry) with the anchor's. Of each row that ``anchors`` picks, its positives are the
    first other rows of its label, its negatives to a positive the first rows of other labels whose score is between
    ``shares`` per cent of the positive's; higher scores first, ties by the smaller key, a null key last. All rows are searched,
    and every row is found that belongs there.

    Rows with a null label, a null vector or one with a null or non-finite entry take no part; nor do null keys as anchors. Rows that
    repeat as a whole count once; other rows that share a key are rows of their own, also as anchors. Vectors of different
    lengths never meet. Anchors without positives, and positives without negatives in their window (all with a negative score),
    give no rows; so does an empty table. Other columns are read by ``anchors`` only, so that their names cannot clash.
    """
    rows = staged(quantised(vectors, key, vector, label, anchors, scale), "quantised")
    dealt, planned = tiled(rows, tile_rows)
    dealt = staged(dealt, "dealt")
    packed = dealt.drop("anchor").repartition(min(2_000, 2 * planned), "tile").groupBy("tile").applyInArrow(packer(leaf), PACKED_SQL)
    packed = staged(packed, "tiles")
    own = dealt.where("anchor").drop("anchor", "dim").distinct()
    own = own.select(F.xxhash64("id", "label", "x").alias("anchor"), "*")
    everything = F.array(window(F.lit(0), F.lit(-ANY), F.lit(ANY)))
    own = staged(own.withColumn("windows", everything), "anchors")
    directory = packed.select("tile", "dim", "low", "high").collect()
    tiles = Tiles(packed, directory, max(1, math.ceil(own.count() / block)), leaf, fanout)

    close = staged(tiles.search(own, True, positives), "positives").select("anchor", "place", "key", "score")
    hundred = F.lit(100).cast("bigint")
    least, most = (F.col("score") * F.lit(s).cast("bigint") for s in shares)
    # Whole quotients, the lower one rounded up and the upper one down.
    low = (least + F.pmod(-least, hundred)) / hundred
    high = (most - F.pmod(most, hundred)) / hundred
    asked = close.select("anchor", window(F.col("place"), low, high).alias("w")).where("w.low <= w.high")
    asked = own.drop("windows").join(asked.groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("windows")), "anchor")
    far = tiles.search(staged(asked, "asked"), False, negatives)
    far = far.select("anchor", F.col("rank").alias("nth"), F.col("place").alias("rank"), F.col("key").alias("negative"), F.col("score").alias("far"))
    pairs = far.join(close.withColumnRenamed("place", "nth"), ["anchor", "nth"]).join(own.select("anchor", "id"), "anchor")
    named = lambda c: F.when(F.col(c) != NO_KEY, F.col(c))
    return pairs.select(
        F.col("id").alias("anchor_id"),
        named("key").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        named("negative").alias("negative_id"),
        F.col("score").alias("positive_score"),
        F.col("far").alias("negative_score"),
    )


def oracle() -> str:
    """All scores of all anchors, in SQL; keys are taken to be unique."""
    return f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(CAST(c AS DOUBLE) * {SCALE})) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place
  FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  WHERE p.place <= {POSITIVES}
    AND {WINDOW[0]} * p.positive_score <= 100 * s.score AND 100 * s.score <= {WINDOW[1]} * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
