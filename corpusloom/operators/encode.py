"""Encode texts to token ids: by whole words or by learned merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from corpusloom.functions.text import byte_level_words, words
from corpusloom.functions.tokens import END, START, ones_like, zeros_like
from corpusloom.operators.lookup import lookup_elements

UNKNOWN = 3
MAX_MERGES = 1_000_000


def word_ids(
    df: DataFrame, key: str, text: str, vocab: DataFrame, name: str = "ids", unknown: int = UNKNOWN
) -> DataFrame:
    """``(key, ids)`` of each text's words under ``vocab (token, idx)``; unknown words get the ``unknown`` id.

    One row a text, also where keys repeat; a NULL text has no words. Texts are encoded where they lie.
    """
    found = lookup_elements(df, [key], words(F.col(text)), vocab, "token", "idx", "_found")
    return found.select(key, F.transform("_found", lambda i: F.coalesce(i, F.lit(unknown)).cast("int")).alias(name))


def with_specials(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Turn raw ids into an encoded row: start and end ids, attention mask, special-token mask."""
    start, end, zero, one = (F.array(F.lit(v).cast("int")) for v in (START, END, 0, 1))
    return df.select(
        *[c for c in df.columns if c != ids],
        F.concat(start, F.col(ids), end).alias("input_ids"),
        F.concat(one, ones_like(F.col(ids)), one).alias("attention_mask"),
        F.concat(one, zeros_like(F.col(ids)), one).alias("special_tokens_mask"),
    )


def encode(df: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """``(key, input_ids, attention_mask, special_tokens_mask)``."""
    return with_specials(word_ids(df, key, text, vocab))


# ---------------------------------------------------------------------------------------------------------------------
# Merges


def _segment(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the lowest-ranked merge that fits, leftmost first, until none does.

    Pairs wait in a heap by rank and place, and pieces are linked by place, so a word of n letters costs n log n whatever
    the number of merges. An entry whose pieces have changed meanwhile is passed over.
    """
    pieces: list[str | None] = list(word)
    after = list(range(1, len(pieces) + 1))
    before = list(range(-1, len(pieces) - 1))
    heap: list[tuple[int, int, str, str]] = []

    def offer(at: int) -> None:
        if at >= 0 and after[at] < len(pieces):
            pair = (pieces[at], pieces[after[at]])
            if pair in ranks:
                heappush(heap, (ranks[pair], at, *pair))

    for at in range(len(pieces) - 1):
        offer(at)
    while heap:
        _, at, left, right = heappop(heap)
        if pieces[at] != left or after[at] >= len(pieces) or pieces[after[at]] != right:
            continue
        gone = after[at]
        pieces[at], pieces[gone] = left + right, None
        after[at] = after[gone]
        if after[at] < len(pieces):
            before[after[at]] = at
        offer(before[at])
        offer(at)
    return [piece for piece in pieces if piece is not None]


def _cached(work):
    seen: dict = {}

    def once(word):
        if word not in seen:
            if len(seen) > 500_000:
                seen.clear()
            seen[word] = work(word)
        return seen[word]

    return once


def segment_words(words_column: Column, merges: Sequence[tuple]) -> Column:
    """Pieces of every word of an array column, in order. The merge list travels with the function, so its size is
    checked; it is as long as the vocabulary, not as the corpus."""
    if len(merges) > MAX_MERGES:
        raise ValueError(f"more than {MAX_MERGES} merges")
    ranks = {(m[0], m[1]): rank for rank, m in enumerate(merges)}

    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        segment = _cached(lambda word: _segment(word, ranks))
        for batch in batches:
            yield _spelled(batch, segment, pa.string())

    return F.arrow_udf(pieces, ArrayType(StringType()))(words_column)


def _spelled(rows: pa.ListArray, spell: Callable[[str], list], kind: pa.DataType) -> pa.ListArray:
    """What each row's words are spelled as, in order. A batch spells each distinct word once; NULL rows stay."""
    words = rows.flatten().dictionary_encode()
    each = pa.array([spell(word) for word in words.dictionary.to_pylist()], pa.list_(kind)).take(words.indices)
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)))
    return pa.ListArray.from_arrays(each.offsets.take(pa.array(ends)), each.flatten(), mask=rows.is_null())


def encode_with_merges(
    texts: DataFrame, key: str, words_column: Column, merges: Sequence[tuple], tokens: dict[str, int]
) -> DataFrame:
    """``(key, ids)`` under learned merges. Rows stay where they are: there is no shuffle at all."""
    if len(tokens) > MAX_MERGES:
        raise ValueError(f"more than {MAX_MERGES} tokens")
    ranks = {(m[0], m[1]): rank for rank, m in enumerate(merges)}

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoded = _cached(lambda word: [tokens.get(piece, UNKNOWN) for piece in _segment(word, ranks)])
        for batch in batches:
            yield _spelled(batch, encoded, pa.int32())

    udf = F.arrow_udf(ids, ArrayType(IntegerType()))
    return texts.select(key, udf(words_column).alias("ids"))


def encode_byte_level(
    df: DataFrame, key: str, text: str, merges: Sequence[tuple], tokens: dict[str, int], specials: bool = True
) -> DataFrame:
    """Encode as byte-level tokenizers do: words with their leading blank, written as byte letters, under the merges.

    ``(key, input_ids, attention_mask, special_tokens_mask)``, or ``(key, ids)`` without specials. A NULL text has no words.
    """
    letters = F.coalesce(byte_level_words(F.col(text)), F.array().cast("array<string>"))
    rows = encode_with_merges(df, key, letters, merges, tokens)
    return with_specials(rows) if specials else rows


def substitutes(target: DataFrame, source: DataFrame, merges: Sequence[tuple] | None = None) -> DataFrame:
    """``(idx, pieces)``: each target token as the source tokenizer writes it.

    A token that the source knows is its own piece. The text of any other is cut by the source's ``merges``; a piece that the
    source has no id for is spelled by letters, letters that it lacks being unknown. Without merges all of it is spelled by
    letters. Made once per vocabulary, so the corpus only ever joins by token id.
    """
    known = source.select(F.col("token").alias("piece"), F.col("idx").alias("piece_idx"))
    whole = target.join(known.select(F.col("piece").alias("token"), "piece_idx"), "token", "left")
    letters = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    cut = letters(F.col("token")) if merges is None else segment_words(F.array("token"), merges)
    parts = whole.withColumn("cut", cut).select(
        "idx", F.posexplode(F.when(F.col("piece_idx").isNotNull(), F.array("token")).otherwise(F.col("cut"))).alias("pos", "piece")
    )
    found = parts.join(known, "piece", "left")
    spelled = F.when(F.col("piece_idx").isNotNull(), F.array("piece")).otherwise(letters(F.col("piece")))
    each = found.select("idx", "pos", F.posexplode(spelled).alias("at", "piece")).join(known, "piece", "left")
    entry = F.struct("pos", "at", F.coalesce("piece_idx", F.lit(UNKNOWN)).alias("idx"))
    ordered = F.sort_array(F.collect_list(entry))
    return each.groupBy("idx").agg(F.transform(ordered, lambda e: e["idx"]).alias("pieces"))
