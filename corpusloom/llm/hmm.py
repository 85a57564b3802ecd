"""A hidden Markov language model over words.

Words are symbols of their own as far as they are frequent; the rest share the symbols of a few spelling classes, within
which a word has its smoothed share of the counts. So the probability of a text is that of its symbols under the model,
times factors of its rare words that no state changes: the states need a bounded table, and the counts of all words stay a
table of Spark's. Baum-Welch sums expected counts per partition, adds them up by symbol, and repeats; a text is scored by
the forward recursion, scaled at every word, over its whole length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.stage import staged

STATES = 6
#: Most words with a symbol of their own, and the number of spelling classes for the others.
FREQUENT = 60_000
CLASSES = 64
#: The shares of the training texts that the passes take, one after the other: they grow with the corpus. Where a share has
#: fewer than LEAST_TEXTS texts, that many are taken.
SHARES = (1 / 64, 1 / 64, 1 / 64, 1 / 32, 1 / 32, 1 / 32, 1 / 16, 1 / 16, 1 / 8, 1, 1)
LEAST_TEXTS = 500
#: Words counted in memory before they are handed on; words whose texts go forward side by side.
FLUSH = 200_000
SIDE_BY_SIDE = 400_000
END = b""
SMOOTH = 0.1
PRIOR = 100.0
GRID = 16


def spelling(word: bytes) -> int:
    """The class of a rare word, of its length and last two bytes; that of the end is the first."""
    if len(word) > 1:
        return (min(len(word), 12) // 4 + 7 * word[-2] + 14 * word[-1]) % CLASSES
    return (min(len(word), 12) // 4 + sum(7 * i * c for i, c in enumerate(word[-2:], 1))) % CLASSES


def tokens(text: bytes | None) -> list[bytes]:
    """The words between ASCII blanks, A-Z lowered, and one end."""
    return [*(text or b"").lower().split(), END]


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``word, c``: how often each token comes."""

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "c"])
        for part in parts:
            for t in part.column(0):
                seen.update(tokens(t.as_py()))
                if len(seen) > FLUSH:
                    yield batch()
                    seen.clear()
        if seen:
            yield batch()

    return docs.select(F.col(text).cast("binary")).mapInArrow(per_batch, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Words with their counts, at most ``most``: all above the lowest step of a logarithmic scale that keeps to that."""
    step = F.floor(F.log2("c") * GRID).alias("step")
    total, least = 0, None
    for r in sorted(counts.groupBy(step).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return {}
    return {bytes(r.word): r.c for r in counts.where(F.floor(F.log2("c") * GRID) >= least).collect()}


@dataclass
class Vocabulary:
    """Symbols 0..CLASSES-1 are the spelling classes; then come the frequent words in the order of their bytes."""

    words: list[bytes]
    counts: np.ndarray
    train_tokens: int
    distinct: int
    class_totals: np.ndarray

    @property
    def symbols(self) -> int:
        return CLASSES + len(self.words)


def vocabulary(counts: DataFrame, most: int) -> Vocabulary:
    top = frequent_words(counts, most)
    words = sorted(top)
    totals = counts.agg(F.sum("c"), F.count(F.lit(1))).first()

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(CLASSES, np.int64)
        for part in parts:
            for w, c in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if w not in top:
                    sums[spelling(w)] += c + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(sums)], names=["k", "n"])

    rows = counts.mapInArrow(per_batch, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    class_totals = np.ones(CLASSES)
    for r in rows:
        class_totals[r.k] += r.n
    return Vocabulary(words, np.array([top[w] for w in words], float), totals[0] or 0, totals[1] or 0, class_totals)


def encoded(docs: DataFrame, keep: list[str], text: str, vocab: Vocabulary) -> DataFrame:
    """``keep``, ``row``, ``n_tokens``, ``n_frequent``, ``ids`` (two bytes a token), ``rare`` (words), and sums of logs.

    ``base_log`` is that of count + 1 over the frequent tokens, ``class_log`` that of the classes' totals over the others.
    """
    if vocab.symbols > 1 << 16:
        raise ValueError(f"a symbol is two bytes: {vocab.symbols} are too many")
    ids = {w: CLASSES + i for i, w in enumerate(vocab.words)}
    log_counts = np.concatenate([np.zeros(CLASSES), np.log10(vocab.counts + 1)]) if vocab.words else np.zeros(CLASSES)
    log_totals = np.log10(vocab.class_totals)
    rows = docs.select(*keep, F.monotonically_increasing_id().alias("row"), F.col(text).cast("binary").alias("t"))
    names = [*keep, "row", "n_tokens", "n_frequent", "base_log", "class_log", "ids", "rare"]
    schema = rows.drop("t").selectExpr(
        "*", "0L AS n_tokens", "0L AS n_frequent", "0d AS base_log", "0d AS class_log", "cast('' AS binary) AS ids", "cast(array() AS array<binary>) AS rare"
    ).schema

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for start in range(0, whole.num_rows, 512):
                part = whole.slice(start, 512)
                out: list[tuple] = []
                for t in part.column(len(keep) + 1):
                    words = tokens(t.as_py())
                    line = np.fromiter(map(ids.get, words, repeat(-1)), np.int32, len(words))
                    rare = [words[i] for i in np.flatnonzero(line < 0).tolist()]
                    classes = np.array([spelling(w) for w in rare], np.int32)
                    line[line < 0] = classes
                    out.append((len(words), len(words) - len(rare), log_counts[line].sum(), log_totals[classes].sum(), line.astype(np.uint16).tobytes(), rare))
                types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
                made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=names)

    return rows.mapInArrow(per_batch, schema)


@dataclass
class Model:
    """Probabilities of the first state, of the next one, and of a symbol by state (symbols by rows)."""

    first: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def started(symbols: int, states: int, totals: np.ndarray) -> Model:
    """A guess near the symbols' shares, with states that tend to stay."""
    rng = np.random.default_rng(0)
    emit = (totals[:, None] + SMOOTH) * rng.uniform(0.5, 1.5, (symbols, states))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def groups(lines: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which texts go side by side, longest first, and how many of them last beyond each place."""
    lengths = np.array([len(x) for x in lines])
    order = np.argsort(-lengths, kind="stable")
    start = 0
    while start < len(order):
        most = max(1, SIDE_BY_SIDE // max(1, lengths[order[start]]))
        rows = order[start : start + most]
        start += most
        alive = np.searchsorted(-lengths[rows], -np.arange(lengths[rows[0]]), side="left")
        yield rows, alive


def laid(lines: list[np.ndarray], rows: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols place by place (the longest texts first at each), and where each place begins."""
    begin = np.concatenate([[0], np.cumsum(alive)])
    flat = np.empty(begin[-1], np.int64)
    for j, r in enumerate(rows):
        flat[begin[: len(lines[r])] + j] = lines[r]
    return flat, begin


def forward(model: Model, lines: list[np.ndarray]) -> np.ndarray:
    """The log10 likelihood of each sequence: the recursion over its whole length, scaled to a sum of one at each place."""
    out = np.zeros(len(lines))
    for rows, alive in groups(lines):
        flat, begin = laid(lines, rows, alive)
        total, a = np.zeros(len(rows)), None
        for t, n in enumerate(alive):
            e = model.emit[flat[begin[t] : begin[t + 1]]]
            a = (model.first if a is None else a[:n] @ model.move) * e
            s = a.sum(1)
            a /= s[:, None]
            total[:n] += np.log10(s)
        out[rows] = total
    return out


def expected(model: Model, lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of first states, moves and symbols by state, and the log10 likelihood."""
    first, move, emit, likelihood = np.zeros_like(model.first), np.zeros_like(model.move), np.zeros_like(model.emit), 0.0
    states = len(model.first)
    for rows, alive in groups(lines):
        flat, begin = laid(lines, rows, alive)
        e = model.emit[flat]
        a, scale = np.empty_like(e), np.empty(len(flat))
        for t, n in enumerate(alive):
            at = slice(begin[t], begin[t + 1])
            now = (model.first if t == 0 else a[begin[t - 1] : begin[t - 1] + n] @ model.move) * e[at]
            scale[at] = now.sum(1)
            a[at] = now / scale[at][:, None]
        likelihood += np.log10(scale).sum()
        e /= scale[:, None]
        b = np.ones((alive[-1], states))
        gamma = np.empty_like(a)
        for t in range(len(alive) - 1, -1, -1):
            at, n = slice(begin[t], begin[t + 1]), alive[t]
            if len(b) < n:
                b = np.concatenate([b, np.ones((n - len(b), states))])
            gamma[at] = a[at] * b
            if t:
                back = e[at] * b
                move += a[begin[t - 1] : begin[t - 1] + n].T @ back
                b = back @ model.move.T
        first += gamma[: alive[0]].sum(0)
        for s in range(states):
            emit[:, s] += np.bincount(flat, gamma[:, s], len(emit))
    return first, move * model.move, emit, likelihood


def improved(first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """The model of the expected counts; each state also gets PRIOR counts in the symbols' overall shares."""
    share = (emit.sum(1, keepdims=True) + 1e-3) / (emit.sum() + 1e-3 * len(emit))
    emit, first, move = emit + PRIOR * share, first + SMOOTH, move + SMOOTH
    return Model(first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def unpacked(parts: pa.RecordBatch, column: int = 0) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for x in parts.column(column)]


def counts_of(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all rows: per partition in numpy, then added up by symbol.

    A partition gives a row of state counts for each symbol it holds, one for the first states (-1) and one for the moves
    into each state (-2 - state); the sums are one row per symbol, a bounded number.
    """
    symbols, states = model.emit.shape

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, move, emit = np.zeros_like(model.first), np.zeros_like(model.move), np.zeros_like(model.emit)
        for part in parts:
            for start in range(0, part.num_rows, 1024):
                found = expected(model, unpacked(part.slice(start, 1024)))
                first, move, emit = first + found[0], move + found[1], emit + found[2]
        held = np.flatnonzero(emit.sum(1))
        keys = np.concatenate([held, [-1], -2 - np.arange(states)])
        values = np.concatenate([emit[held], first[None, :], move])
        yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(values[:, s]) for s in range(states)]], names=["k", *[f"s{s}" for s in range(states)]])

    schema = "k bigint, " + ", ".join(f"s{s} double" for s in range(states))
    sums = rows.select("ids").mapInArrow(per_batch, schema).groupBy("k").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)])
    first, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
    for r in sums.collect():
        if r[0] >= 0:
            emit[r[0]] = r[1:]
        elif r[0] == -1:
            first[:] = r[1:]
        else:
            move[-2 - r[0]] = r[1:]
    return first, move, emit


def fit(rows: DataFrame, vocab: Vocabulary, states: int = STATES, shares: tuple[float, ...] = SHARES) -> Model:
    """Baum-Welch over the encoded training rows, every pass by partial counts of all tasks.

    The passes take growing shares of the texts, the last ones all rows. A share is drawn by what a text says, each text
    once, and lies within the next one: so neither the cut into files and tasks nor copies change the model.
    """
    totals = np.concatenate([vocab.class_totals, vocab.counts])
    model = started(vocab.symbols, states, totals)
    all_rows = rows.count()
    if not all_rows:
        return model
    taken = [min(1.0, max(share, LEAST_TEXTS / all_rows)) for share in shares]
    parts = [share for share in taken if share < 1]
    draw = F.shiftright(F.xxhash64("ids", "rare"), 24) + F.lit(1 << 39)
    drawn = rows.select(draw.alias("draw"), "ids", "rare").where(F.col("draw") < int(max(parts, default=0) * (1 << 40)))
    some = staged(drawn.distinct().select("draw", "ids"), "shares") if parts else rows
    for share in taken:
        model = improved(*counts_of(some.where(F.col("draw") < int(share * (1 << 40))) if share < 1 else rows, model))
        if share < 1:
            # Symbols outside the share keep their part of the corpus.
            model.emit = 0.9 * model.emit + 0.1 * (totals / totals.sum())[:, None]
    return model


def scores(docs: DataFrame, learn: Column, keep: list[str], text: str = "text", states: int = STATES, frequent: int = FREQUENT) -> DataFrame:
    """``keep``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    ``learn`` is a boolean expression of the rows to learn from. Null and blank texts are one end. Both scores are log10
    probabilities: of the smoothed counts alone, and of the model. Repeated rows are scored each; an empty table gives no
    rows. Without training rows every token is unknown, and the model is its first guess.

    The texts are read twice: to count words, and to turn them into symbols, which are kept as a table of two bytes a
    token. Rare words meet their counts in a shuffle; a word that comes often has a symbol and never does.
    """
    kept = [f"k{i}" for i in range(len(keep))]
    same = [F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)]
    marked = docs.select(*same, F.coalesce(learn, F.lit(False)).alias("_learn"), F.col(text).alias("text"))
    counts = staged(word_counts(marked.where("_learn"), "text"), "words")
    vocab = vocabulary(counts, frequent)
    rows = staged(encoded(marked, [*kept, "_learn"], "text", vocab), "symbols")
    model = fit(rows.where("_learn"), vocab, states)
    rare = rows.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("m"))
    found = rare.join(counts, "word").groupBy("row").agg(
        F.sum("m").alias("rare_known"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("rare_log")
    )

    names = ["row", "symbol_log"]

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, 1024):
                some = part.slice(start, 1024)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(forward(model, unpacked(some, 1)))], names=names)

    symbol_logs = rows.select("row", "ids").mapInArrow(per_batch, "row bigint, symbol_log double")
    narrow = rows.drop("ids", "rare", "_learn").join(symbol_logs, "row").join(found, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    norm = float(np.log10(vocab.train_tokens + vocab.distinct + 1))
    return narrow.select(
        *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)],
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.train_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_log") + rare_log - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("symbol_log") + rare_log - F.col("class_log")).alias("score"),
    )
