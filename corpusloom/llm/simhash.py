"""SimHash fingerprints, and the links between those that differ in few bits, by vantage points.

A vantage-point tree halves a set of fingerprints by their Hamming distance to one of them. Fingerprints within two bits
of each other differ by at most two in that distance (triangle inequality), so a pair can only be torn apart when the outer
one lies at most two beyond the border. Such boundary rows also go to the inner side, and every pair meets in some leaf.
The upper levels of the tree deal fingerprints out to tasks; each task goes on splitting its own share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import matched, unused
from corpusloom.llm.graph import components
from corpusloom.sources.stage import staged

SHINGLE = 3
SEED = 42
RADIUS = 2
LEAF = 2_000
#: Fingerprints that shape the upper levels; they decide where rows meet, never which rows do.
SAMPLE = 16_384
LEVELS = 12
BLOCK = 512
CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """64 bits, each set where more than half of the shingles' XXH64 have it; zero for a text without words.

    Words are runs without ASCII blanks, A-Z lowered; shingles are three words joined by a blank, repeats included, or
    the whole sequence when it is shorter. The text is hashed in chunks, so its length costs no memory.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    shingles, counts = len(words) - size + 1, np.zeros(64, np.int64)
    for at in range(0, shingles, CHUNK):
        part = words[at : at + CHUNK + size - 1]
        line = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        begins = [0, *(ends[:-1] + 1).tolist()]
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(line[i:j], SEED) for i, j in zip(begins, ends[size - 1 :].tolist(), strict=False)), np.uint64
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > shingles, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed long. A null text has no words."""
    rows = docs.select(*keep, F.col(text).cast("binary").alias("fp"))

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = np.array([fingerprint(t.as_py()) for t in part.column(len(keep))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(values)], names=[*keep, "fp"])

    return rows.mapInArrow(per_batch, rows.withColumn("fp", F.lit(0).cast("bigint")).schema)


def distances(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def border(away: np.ndarray) -> int:
    """The distance up to which rows count as inner, so that both sides, boundary rows included, are about equal."""
    upto = np.cumsum(np.bincount(away, minlength=66 + RADIUS))
    inner, outer = upto[RADIUS:66 + RADIUS], len(away) - upto[:66]
    return int(np.argmin(np.maximum(inner[:66], outer)))


def best_vantage(points: np.ndarray, tries: int = 8) -> tuple[int, int]:
    """Of a few evenly spaced points, the one that leaves the least in its larger side."""

    def larger(vantage: int) -> tuple[int, int]:
        away = distances(points, vantage)
        at = border(away)
        return max(int((away <= at + RADIUS).sum()), int((away > at).sum())), at

    found = [(*larger(v), v) for v in points[:: max(1, len(points) // tries)][:tries].tolist()]
    _, at, vantage = min(found)
    return vantage, at


def upper_levels(sample: np.ndarray, levels: int) -> dict[int, tuple[int, int]]:
    """Vantage point and border by node; node k has the children 2k (inner) and 2k + 1 (outer), the root is 1."""
    tree: dict[int, tuple[int, int]] = {}
    todo = [(1, sample)]
    while todo:
        node, points = todo.pop()
        if node >= 1 << levels or len(points) < 2:
            continue
        tree[node] = best_vantage(points)
        away = distances(points, tree[node][0])
        todo += [(2 * node, points[away <= tree[node][1] + RADIUS]), (2 * node + 1, points[away > tree[node][1]])]
    return tree


def routed(points: np.ndarray, tree: dict[int, tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """The leaves, and which points each gets; boundary points get to more than one."""
    todo = [(1, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node not in tree:
            yield node, rows
            continue
        away = distances(points[rows], tree[node][0])
        todo += [(2 * node, rows[away <= tree[node][1] + RADIUS]), (2 * node + 1, rows[away > tree[node][1]])]


def stars(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each point of a small set that has a neighbour, with the first point that it reaches inside the set."""
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= RADIUS
    label = np.arange(len(points))
    while True:
        least = np.where(near, label[None, :], len(points)).min(1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    linked = label != np.arange(len(points))
    return [(points[linked], points[label[linked]])]


def links_within(points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect exactly what distances of at most RADIUS connect: a star per connected part of each leaf.

    A set that no vantage point divides (all fingerprints close together) is compared block against block.
    """
    found, todo = [], [points]
    while todo:
        rows = todo.pop()
        if len(rows) <= BLOCK:
            found += stars(rows)
            continue
        vantage, at = best_vantage(rows)
        away = distances(rows, vantage)
        inner, outer = rows[away <= at + RADIUS], rows[away > at]
        if max(len(inner), len(outer)) > 0.9 * len(rows):
            blocks = [rows[i : i + BLOCK] for i in range(0, len(rows), BLOCK)]
            found += [x for i, p in enumerate(blocks) for q in blocks[i + 1 :] for x in stars(np.concatenate([p, q]))]
        else:
            todo += [inner, outer]
    return found


def linked_fingerprints(distinct: DataFrame, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """``a, b``: links between the rows of ``distinct`` (staged, one column ``fp``) that span their near pairs."""
    rows = distinct.count()
    levels = min(LEVELS, max(0, int(np.ceil(np.log2(max(1, rows / leaf))))))
    share = F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < int(min(1.0, sample / max(1, rows)) * (1 << 20))
    shape = np.array([r.fp for r in distinct.where(share).select("fp").collect()], np.int64).view(np.uint64)
    tree = upper_levels(np.sort(shape), levels)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            points = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for node, at in routed(points, tree):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), node, np.int64)), pa.array(points[at].view(np.int64))], names=["leaf", "fp"]
                )

    def per_leaf(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = links_within(np.sort(rows["fp"].to_numpy().astype(np.int64).view(np.uint64)))
        a, b = (np.concatenate([p[i] for p in pairs] or [np.zeros(0, np.uint64)]) for i in (0, 1))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "leaf bigint, fp bigint")
    return dealt.groupBy("leaf").applyInPandas(per_leaf, "a bigint, b bigint")


def grouped(prints: DataFrame, key: str) -> DataFrame:
    """``fp, root, component_id``: of every fingerprint in the staged ``prints``, the group it belongs to.

    ``root`` names the group by one of its fingerprints, ``component_id`` by its smallest key (null if all are null).
    """
    classes = staged(prints.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    roots = staged(components(linked_fingerprints(classes)), "roots")
    placed = staged(
        classes.join(roots, classes["fp"] == roots["node"], "left").select(
            "fp", F.coalesce("root", "fp").alias("root"), "first"
        ),
        "placed",
    )
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.drop("first").join(least, "root")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint, component_id`` of every document.

    Fingerprints of at most two differing bits link, copies of one fingerprint always; component_id is the smallest key
    reachable. Null texts and texts without words have the fingerprint zero and link like any other. Repeated rows stay
    repeated; a null key is never the smallest. Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    prints = staged(fingerprints(docs, [key], text), "prints")
    groups = staged(grouped(prints, key).select("fp", "component_id"), "groups")
    return prints.join(groups, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, only the first of each near-duplicate group: that with the smallest key, then text hash.

    Exactly one row of a group stays, also where rows repeat as a whole or keys are null (they come last).
    """
    mark = unused("_text", docs)
    docs = docs.withColumn(mark, F.xxhash64(F.coalesce(text, F.lit(""))))
    narrow = docs.select(F.col(key).alias("key"), F.col(mark).alias("mark"), F.col(text).alias("text"))
    prints = staged(fingerprints(narrow, ["key", "mark"], "text"), "prints")
    prints = prints.join(staged(grouped(prints, "key").select("fp", "root"), "groups"), "fp")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "mark")
    first = staged(prints.groupBy("root").agg(F.min(order).alias("first")).select("first.key", "first.mark"), "first")
    same = (prints["key"].eqNullSafe(first["key"])) & (prints["mark"] == first["mark"])
    copies = prints.join(first, same, "left_semi").groupBy("key", "mark").count().where("count > 1")
    named = {"key": key, "mark": mark}
    first, copies = first.withColumnsRenamed(named), staged(copies.drop("count"), "copies").withColumnsRenamed(named)
    kept = matched(docs, first, [key, mark], "left_semi")
    if copies.isEmpty():
        return kept.drop(mark)
    once = matched(kept, copies, [key, mark], "left_semi").dropDuplicates([key, mark])
    return matched(kept, copies, [key, mark], "left_anti").unionByName(once).drop(mark)
