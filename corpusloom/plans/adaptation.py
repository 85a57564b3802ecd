"""Adapt a vocabulary to a second language."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.vectors import he_normal
from corpusloom.operators import learn
from corpusloom.operators import vocab as v
from corpusloom.operators.encode import substitutes
from corpusloom.sources.stage import staged


def base_vocabulary(top: DataFrame, letters_of: DataFrame, first_id: int = 4) -> DataFrame:
    """``(token, idx, string)``: the letters of ``letters_of (token)`` in text order, then the tokens of ``top (token,
    idx)``, whose ids start from ``first_id`` too. With letters in it a vocabulary can spell every token."""
    letters = letters_of.select(F.explode(F.split("token", "")).alias("token")).where("token <> ''").distinct()
    # An alphabet: its size has nothing to do with the size of the corpus.
    rank = F.row_number().over(Window.orderBy("token"))
    alphabet = letters.select("token", (rank - 1 + first_id).cast("int").alias("idx"))
    moved = top.select("token", (F.col("idx") + letters.count()).cast("int").alias("idx"))
    return alphabet.unionByName(moved).withColumn("string", F.col("token"))


def adapt(source: DataFrame, target: DataFrame, learned: DataFrame) -> DataFrame:
    """Merge two vocabularies and fit the result to the learned tokens.

    Source tokens keep their ids. Target tokens move to free ids where they clash, tokens that were not learned go, and
    learned tokens without a row get the ids left over.
    """
    merged = staged(v.merge_vocabularies(source, target), "merged")
    slotted = staged(v.reassign_slots(merged), "slotted")
    kept, _, missing = v.match_learned(slotted, learned)
    size = learned.count()
    filled = staged(v.add_helpers(kept, missing, size), "filled")
    return v.pull_in_overflow(filled, size)


def adapted_tokenizer(
    source: DataFrame, target: DataFrame, source_size: int, n_new: int, n_merges: int, n_special: int = 10
) -> tuple[DataFrame, list[tuple[str, str, int]]]:
    """The adapted vocabulary and its merges, from two vocabularies ``(token, idx, string[, embedding])`` alone.

    The strings of the first ``source_size + n_new + n_special`` tokens of the merged vocabulary are the texts that the
    new merges are learned from; the learned tokens then decide which tokens stay, and which need a helper.
    """
    slotted = v.reassign_slots(staged(v.merge_vocabularies(source, target), "merged"))
    counts = staged(v.word_counts(v.training_strings(slotted, source_size, n_new, n_special), "string"), "strings")
    merges, _ = learn.learn_merges(counts, n_merges)
    return adapt(source, target, staged(learn.learned_tokens(counts, merges), "learned")), merges


def embedding_table(
    base: DataFrame, adapted: DataFrame, source: DataFrame, dim: int, seed: int, use_target: bool = True
) -> DataFrame:
    """``(idx, embedding)`` for every token of the adapted vocabulary.

    Source tokens keep their row of ``base (idx, embedding)``. Target tokens bring their own vector, or with
    ``use_target=False`` a seeded random one. Helpers get the mean of the rows of the source tokens that spell them.
    Any other token gets a random vector, and rows of ``base`` beyond the vocabulary go.
    """
    drawn = he_normal(dim, seed, F.col("idx"))
    helpers = adapted.where(F.col("origin") == v.HELPER).select("token", "idx")
    pieces = substitutes(helpers, source.select("token", "idx")).withColumnRenamed("idx", "token")
    means = v.piece_mean(pieces, base).select(F.col("token").alias("idx"), F.col("embedding").cast("array<float>").alias("mean"))
    own = F.col("embedding") if use_target and "embedding" in adapted.columns else F.lit(None).cast("array<float>")
    given = adapted.select("idx", "origin", own.alias("own")).join(means, "idx", "left")
    vector = F.when(F.col("origin") == v.TARGET, F.col("own")).otherwise(F.col("mean"))
    placed = v.overlay(base, given.select("idx", "origin", F.coalesce(vector, drawn).alias("embedding")))
    return adapted.select("idx").join(placed, "idx", "left").select("idx", F.coalesce("embedding", drawn).alias("embedding"))


def substitution_table(adapted: DataFrame, source: DataFrame, merges: list[tuple] | None = None) -> DataFrame:
    """``(idx, is_source, pieces)`` for every token of the adapted vocabulary, its pieces as the source tokenizer cuts them."""
    pieces = substitutes(adapted.select("token", "idx"), source.select("token", "idx"), merges)
    return adapted.select("idx", (F.col("origin") == v.SOURCE).alias("is_source")).join(pieces, "idx", "left")
