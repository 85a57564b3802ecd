"""Which language a text is in: naive Bayes over character trigrams, learned from labelled texts."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.operators.lookup import fits_broadcast, lookup
from corpusloom.sources.stage import staged

# Scores are whole micro-nats, so sums do not depend on the order of addition.
_MICRO = 1_000_000
#: Text that is counted or scored at once, and the letters up to which their trigrams are cells of a table.
BLOCK_BYTES = 4 << 20
DENSE = 200


def _letters(text: Column) -> Column:
    """The letters of a text, words being divided by one blank."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def trigrams(text: Column) -> Column:
    """All overlapping trigrams of the text's letters.

    The lookahead matches at every position and captures three characters: one linear pass over the whole text.
    """
    return F.regexp_extract_all(_letters(text), F.lit("(?=(...))"), F.lit(1))


def _readable(texts: DataFrame, text: str, *keep: Column) -> DataFrame:
    """``keep``, ``_letters`` and ``_odd``: trigrams only where letters beyond 16 bits are, which the engine cuts by halves."""
    letters = texts.select(*keep, _letters(F.col(text)).alias("_letters"), F.col(text).alias("_text"))
    odd = F.col("_letters").rlike(r"[\x{10000}-\x{10ffff}]")
    plain = F.when(~odd, F.col("_letters")).alias("_letters")
    return letters.select(*letters.columns[:-2], plain, F.when(odd, trigrams(F.col("_text"))).alias("_odd"))


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of rows with about BLOCK_BYTES of text, a longer one alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_letters")), 0).to_numpy(zero_copy_only=False))
    start, before = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start, before = end, ends[end - 1]


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams of a column as numbers, which of them comes at each place of each text in turn, and how many
    places each text has."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(pc.fill_null(texts, "").to_pylist()).encode("utf-32-le"), np.uint32)
    within = np.ones(len(points), bool)
    ends = np.cumsum(lengths)
    for back in (1, 2):
        within[(ends - back)[lengths >= back]] = False
    start = np.flatnonzero(within)
    times = np.maximum(lengths - 2, 0)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    size = len(alphabet)
    rank = np.zeros(0x110000, np.int32)
    rank[alphabet] = np.arange(size)
    ranks = rank[points]
    if size <= DENSE:
        cells = (ranks[start] * size + ranks[start + 1]) * size + ranks[start + 2]
        found = np.zeros(size**3, bool)
        found[cells] = True
        distinct = np.flatnonzero(found)
        place = np.zeros(size**3, np.int32)
        place[distinct] = np.arange(len(distinct))
        places = place[cells]
    else:
        wide = ranks.astype(np.int64)
        distinct, places = np.unique((wide[start] * size + wide[start + 1]) * size + wide[start + 2], return_inverse=True)
    letters = [alphabet[distinct // size**power % size] for power in (2, 1, 0)] if size else [distinct] * 3
    return letters[0] << 42 | letters[1] << 21 | letters[2], places, times


def _number(gram: str) -> int:
    one, two, three = map(ord, gram)
    return one << 42 | two << 21 | three


def _text(number: int) -> str:
    return chr(number >> 42) + chr(number >> 21 & 0x1FFFFF) + chr(number & 0x1FFFFF)


def _counted(texts: DataFrame, text: str, lang: str) -> DataFrame:
    """``(gram, lang, n)`` of all texts; blocks of rows are counted before anything is shuffled."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                langs = block.column(0).dictionary_encode(null_encoding="encode")
                numbers, places, times = _grams(block.column(1))
                of = np.repeat(langs.indices.to_numpy(), times)
                n = np.bincount(of.astype(np.int64) * len(numbers) + places, minlength=len(langs.dictionary) * len(numbers))
                held = np.flatnonzero(n)
                names = pa.array([_text(i) for i in numbers.tolist()], pa.string())
                grams = names.take(pa.array(held % max(1, len(numbers))))
                yield made(grams, langs.dictionary.take(pa.array(held // max(1, len(numbers)))), n[held])
                odd = Counter((lg, gram) for lg, row in zip(block.column(0).to_pylist(), block.column(2).to_pylist(), strict=True) for gram in row or ())
                if odd:
                    yield made([gram for _, gram in odd], [lg for lg, _ in odd], list(odd.values()))

    def made(grams, langs, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(langs, pa.string()), pa.array(n, pa.int64())], names=["gram", "lang", "n"])

    rows = _readable(texts, text, F.col(lang).alias("lang")).mapInArrow(per_task, "gram string, lang string, n bigint")
    return rows.groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def train_profile(texts: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[str]]:
    """``(gram, s0, s1, …)`` with one smoothed log-probability per language, and the languages in column order."""
    counts = staged(_counted(texts, text, lang), "trigrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    grams = counts.select("gram").distinct().count()
    languages = sorted(totals)
    # One pass over the counts; languages are a handful of columns.
    seen = {lg: F.coalesce(F.sum(F.when(F.col("lang") == lg, F.col("n"))), F.lit(0)) for lg in languages}
    scores = [
        F.round((F.log(seen[lg] + 1.0) - F.lit(math.log(totals[lg] + grams))) * _MICRO).cast("bigint").alias(f"s{i}")
        for i, lg in enumerate(languages)
    ]
    return staged(counts.groupBy("gram").agg(*scores), "profile"), languages


def detect(texts: DataFrame, key: str, profile: DataFrame, languages: list[str], text: str = "text") -> DataFrame:
    """``(key, detected)`` of every row: the language with the highest score (ties by name); NULL for a text without known trigrams.

    Texts that share a key, or have none, are told apart by a digest; equal texts of a key get the same verdict.

    A profile of checked size travels with the tasks, and texts are scored where they lie, a block of rows at a time: no row a
    trigram, and no shuffle. A larger profile is joined by a shuffle, after equal trigrams of a text were counted together.
    """
    if fits_broadcast(profile):
        return _scored(texts, key, profile, languages, text)
    digest = F.md5(F.col(text).cast("binary")).alias("_digest")
    own = [key, "_digest"]
    grams = texts.select(key, digest, F.explode(trigrams(F.col(text))).alias("gram"))
    names = [f"s{i}" for i in range(len(languages))]
    scored = staged(grams.groupBy(*own, "gram").agg(F.count("*").alias("times")), "grams")
    scored = lookup(scored, profile, "gram").where(F.col(names[0]).isNotNull())
    sums = [F.sum(F.col(c) * F.col("times")).alias(c) for c in names]
    best = F.greatest(*[F.struct(F.col(c).alias("score"), F.lit(-i).alias("rank")) for i, c in enumerate(names)])
    label = F.array(*[F.lit(lg) for lg in languages])
    found = scored.groupBy(*own).agg(*sums).select(
        F.col(key).alias("_key"), F.col("_digest").alias("_of"), F.get(label, -best["rank"]).alias("detected")
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_digest") == F.col("_of"))
    return texts.select(key, digest).join(found, same, "left").select(key, "detected")


def _scored(texts: DataFrame, key: str, profile: DataFrame, languages: list[str], text: str) -> DataFrame:
    known = profile.toArrow()
    grams = known.column("gram").to_pylist()
    scores = np.array([known.column(f"s{i}").to_numpy() for i in range(len(languages))], np.int64).reshape(len(languages), len(grams))
    numbers = np.array([_number(gram) for gram in grams], np.int64)
    order = np.argsort(numbers)
    numbers, scores, place_of = numbers[order], scores[:, order], {grams[i]: place for place, i in enumerate(order.tolist())}

    def best(block: pa.RecordBatch) -> list[str | None]:
        found, places, times = _grams(block.column(1))
        at = np.minimum(np.searchsorted(numbers, found), max(0, len(numbers) - 1))
        hit = numbers[at] == found if len(numbers) else np.zeros(len(found), bool)
        ends = np.cumsum(times)
        summed = lambda values: np.diff(np.append(0, np.cumsum(values[places]))[np.append(0, ends)])
        hits = summed(hit.astype(np.int64))
        # Whole numbers, so the order of addition does not matter; of equal scores the first language's counts.
        sums = np.array([summed(np.where(hit, row[at], 0) if len(numbers) else row[:0]) for row in scores])
        told = [languages[i] if n else None for i, n in zip(sums.argmax(0).tolist(), hits.tolist(), strict=True)] if languages else [None] * len(times)
        for row, odd in enumerate(block.column(2).to_pylist()):
            places_of_row = [place_of[gram] for gram in odd or () if gram in place_of]
            if places_of_row:
                told[row] = languages[scores[:, places_of_row].sum(1).argmax()]
        return told

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(best(block), pa.string())], names=[key, "detected"])

    schema = StructType([texts.schema[key], StructField("detected", StringType())])
    return _readable(texts, text, F.col(key)).mapInArrow(per_task, schema)


def is_language(detected: Column, wanted: str) -> Column:
    return detected == F.lit(wanted)
