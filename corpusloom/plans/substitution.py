"""Substitute the tokens of a saved dataset, split by split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.encode import encode
from corpusloom.operators.substitute import fit_rows, substitute_tokens
from corpusloom.sources.writers import without_split

TRAIN, TEST = "train", "test"


def substitution_job(
    texts: DataFrame, key: str, text: str, vocab: DataFrame, table: DataFrame, wanted: float, seed: int, length: int = 512
) -> DataFrame:
    """``(split, key, input_ids, attention_mask, special_tokens_mask, n_swapped)``, every row ``length`` tokens long.

    Rows of ``test`` go. Those of ``train`` are substituted until ``wanted`` of their tokens come from the source
    (``table`` as in :func:`substitute_tokens`); other splits, validation for one, are encoded as they are. A table
    without ``split`` is all train. One scan, one encoding, no shuffle: the wanted share of a row is chosen by its split,
    and a share of 0 swaps nothing.
    """
    rows = texts if "split" in texts.columns else texts.withColumn("split", F.lit(TRAIN))
    of = F.struct(F.col("split"), F.col(key)).alias("_of")
    encoded = encode(without_split(rows, TEST).select(of, text), "_of", text, vocab)
    share: Column = F.when(F.col("_of.split") == TRAIN, wanted).otherwise(0.0)
    swapped = substitute_tokens(encoded, "_of", table, share, seed, draw_by=F.col(f"_of.{key}"))
    return fit_rows(swapped, length).select("_of.*", "input_ids", "attention_mask", "special_tokens_mask", "n_swapped")
