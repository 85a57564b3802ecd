"""Prepare a split dataset for masked-language-model training: encode, pack or cut, limit, mask."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.tokens import keep_last
from corpusloom.operators.encode import encode
from corpusloom.operators.index import first_n
from corpusloom.operators.mask import mask_tokens
from corpusloom.operators.pack import BATCH_ROWS, pack_chunks
from corpusloom.sources.readers import non_empty
from corpusloom.sources.stage import staged
from corpusloom.sources.writers import with_splits

ARRAYS = ("input_ids", "attention_mask", "special_tokens_mask")


def masked_lm_rows(
    parts: Mapping[str, DataFrame],
    key: str,
    vocab: DataFrame,
    mask_id: int,
    vocab_size: int,
    length: int = 512,
    line_by_line: bool = False,
    most: Mapping[str, int] | None = None,
    batch_rows: int = BATCH_ROWS,
    seed: int = 0,
) -> DataFrame:
    """``(split, row_no, input_ids, attention_mask, special_tokens_mask, labels)`` of every split of ``(key, text)``.

    Packed (the default), the texts of ``batch_rows`` rows in key order are concatenated and cut to ``length``; a batch's
    remainder goes, and ``row_no`` numbers batch and chunk. Line by line, blank texts go, each other one is cut to
    ``length`` tokens with its last one kept, and ``row_no`` is its key. ``most`` limits the rows of a split, the first
    ones by ``row_no``. Masking comes last and draws from the split and ``row_no``.
    """
    made = {}
    for split, texts in parts.items():
        made[split] = _lines(texts, key, vocab, length) if line_by_line else _packed(texts, key, vocab, length, batch_rows)
        if most and split in most:
            made[split] = first_n(staged(made[split], "rows"), "row_no", most[split])
    rows = with_splits(made).withColumn("_of", F.concat_ws("/", "split", F.col("row_no").cast("string")))
    return mask_tokens(rows, "_of", mask_id, vocab_size, seed=seed).drop("_of")


def _lines(texts: DataFrame, key: str, vocab: DataFrame, length: int) -> DataFrame:
    rows = encode(non_empty(texts), key, "text", vocab)
    return rows.select(F.col(key).alias("row_no"), *[keep_last(F.col(c), length).alias(c) for c in ARRAYS])


def _packed(texts: DataFrame, key: str, vocab: DataFrame, length: int, batch_rows: int) -> DataFrame:
    rows = encode(texts, key, "text", vocab).withColumn("n_tokens", F.size("input_ids"))
    chunks = pack_chunks(staged(rows, "encoded"), key, length, ARRAYS, batch_rows, size="n_tokens")
    # A batch has fewer than 2^31 chunks, since its tokens lie in arrays.
    return chunks.select((F.col("batch") * (1 << 31) + F.col("chunk")).alias("row_no"), *ARRAYS)
