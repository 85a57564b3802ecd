"""Token vocabularies: building, merging, renumbering, and the embedding tables that go with them.

A vocabulary is a table ``(token, idx, string, origin[, embedding])``. Every numbering goes by an integer id, so ranks
come from ``row_index`` and no step sorts a vocabulary in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import surface, words
from corpusloom.functions.vectors import he_normal
from corpusloom.operators.index import row_index
from corpusloom.operators.lookup import lookup

SOURCE, TARGET, HELPER = "source_lang", "target_lang", "helper"
UNDECODABLE = "�"


def word_counts(df: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """``(…by, word, n)``. Counts are combined before the shuffle, so a hot word costs one row per task."""
    return (
        df.select(*by, F.explode(words(F.col(text))).alias("word"))
        .groupBy(*by, "word")
        .agg(F.count("*").alias("n"))
    )


def word_vocab(counts: DataFrame, size: int, first_id: int = 4) -> DataFrame:
    """The ``size`` most frequent words with ids from ``first_id`` on (ties by text)."""
    top = counts.orderBy(F.desc("n"), "word").limit(size)
    # The limit leaves at most `size` rows, which is the requested vocabulary, not a share of the corpus.
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "word"))
    return top.select(F.col("word").alias("token"), (rank - 1 + first_id).cast("int").alias("idx"), "n")


def with_surface(vocab: DataFrame) -> DataFrame:
    """Add the readable string of byte-level tokens."""
    return vocab.withColumn("string", surface(F.col("token")))


def merge_vocabularies(source: DataFrame, target: DataFrame) -> DataFrame:
    """One table of both vocabularies; a token in both keeps the source's id, string and embedding.

    Tokens whose string holds an undecodable character are dropped.
    """
    fields = [c for c in source.columns if c != "token"]
    s = source.select("token", F.struct(*fields).alias("s"))
    t = target.select("token", F.struct(*fields).alias("t"))
    return (
        s.join(t, "token", "full_outer")
        .select(
            "token",
            F.coalesce("s", "t").alias("kept"),
            F.when(F.col("s").isNotNull(), SOURCE).otherwise(TARGET).alias("origin"),
        )
        .select("token", "kept.*", "origin")
        .where(~F.col("string").contains(UNDECODABLE))
    )


def duplicate_ids(vocab: DataFrame) -> DataFrame:
    """Ids that more than one token claims."""
    return vocab.groupBy("idx").agg(F.count("*").alias("n")).where("n > 1").select("idx")


def free_ids(vocab: DataFrame, size: int) -> DataFrame:
    """Ids of ``range(size)`` that no token has."""
    ids = vocab.sparkSession.range(size).select(F.col("id").cast("int").alias("idx"))
    return ids.join(vocab.select("idx"), "idx", "left_anti")


def _paired(left: DataFrame, right: DataFrame, reverse: bool = False) -> DataFrame:
    """Zip two id tables by rank: ``(idx, new_idx)``; the longer one's tail has no partner."""
    taken = row_index(left.select("idx"), "idx", "rank")
    given = right.select(F.col("idx").alias("new_idx"), (-F.col("idx")).alias("_down"))
    given = row_index(given, "_down" if reverse else "new_idx", "rank").drop("_down")
    return taken.join(given, "rank").drop("rank")


def reassign_slots(vocab: DataFrame) -> DataFrame:
    """Give target tokens whose id a source token also has a free id: n-th duplicate id to n-th free id."""
    size = vocab.count()
    moves = _paired(duplicate_ids(vocab), free_ids(vocab, size))
    moved = F.when(F.col("origin") == TARGET, F.col("new_idx"))
    return (
        vocab.join(moves, "idx", "left").withColumn("idx", F.coalesce(moved, F.col("idx"))).select(*vocab.columns)
    )


def training_strings(vocab: DataFrame, source_size: int, n_new: int, n_special: int = 10) -> DataFrame:
    """The strings of the first ``source_size + n_new + n_special`` tokens by id: the corpus of the new tokenizer."""
    size = source_size + n_new + n_special
    # Ids are unique and dense here, so "the first n by id" is a top-n of the requested vocabulary size.
    return vocab.orderBy("idx").limit(size).select("idx", "string")


def match_learned(vocab: DataFrame, learned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(kept, dropped, missing)``: vocabulary tokens that were learned, those that were not, and learned tokens
    without a vocabulary row."""
    tokens = learned.select("token")
    kept = vocab.join(tokens, "token", "left_semi")
    dropped = vocab.join(tokens, "token", "left_anti")
    missing = learned.join(vocab.select("token"), "token", "left_anti")
    return kept, dropped, missing


def add_helpers(kept: DataFrame, missing: DataFrame, size: int) -> DataFrame:
    """Give the learned tokens without a row the smallest free ids of ``range(size)``, in learned order; ``size`` is the
    number of learned tokens."""
    free = _paired(missing, free_ids(kept, size))
    helpers = missing.select("token", "idx").join(free, "idx").select("token", F.col("new_idx").alias("idx"))
    rows = helpers.withColumn("origin", F.lit(HELPER))
    return kept.unionByName(rows, allowMissingColumns=True)


def pull_in_overflow(vocab: DataFrame, size: int) -> DataFrame:
    """Move ids at or beyond ``size`` to free ids: the smallest such id takes the largest free one."""
    beyond = vocab.where(F.col("idx") >= size)
    moves = _paired(beyond, free_ids(vocab, size), reverse=True)
    return vocab.join(moves, "idx", "left").withColumn("idx", F.coalesce("new_idx", "idx")).select(*vocab.columns)


def origin_counts(vocab: DataFrame) -> DataFrame:
    return vocab.groupBy("origin").agg(F.count("*").alias("n"))


def source_ids(vocab: DataFrame) -> DataFrame:
    return vocab.where(F.col("origin") == SOURCE).select("idx")


# ---------------------------------------------------------------------------------------------------------------------
# Embeddings


def vector_mean(rows: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """Mean vector per key, weighted if asked, as ``(key, vector)``.

    Dimensions are summed as rows of a partial aggregation: tasks send one row per key and dimension, however many
    vectors a key has, and no group is collected.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    cells = rows.select(key, w.alias("w"), F.posexplode(vector).alias("dim", "x"))
    means = cells.groupBy(key, "dim").agg(
        (F.sum(F.col("x").cast("double") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("x")
    )
    ordered = F.sort_array(F.collect_list(F.struct("dim", "x")))
    return means.groupBy(key).agg(F.transform(ordered, lambda e: e["x"]).alias(vector))


def piece_mean(pieces: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Embed each token of ``(token, pieces)`` as the mean of its pieces' rows in ``(idx, embedding)``."""
    parts = pieces.select("token", F.explode("pieces").alias("idx"))
    return vector_mean(lookup(parts, embeddings.select("idx", "embedding"), "idx"), "token", "embedding")


def overlay(base: DataFrame, vocab: DataFrame) -> DataFrame:
    """Write the vectors of all tokens that do not come from the source over the base matrix ``(idx, embedding)``.

    Tokens whose id lies beyond the base matrix enlarge it.
    """
    new = vocab.where(F.col("origin") != SOURCE).select("idx", F.col("embedding").alias("new"))
    return base.join(new, "idx", "full").select("idx", F.coalesce("new", "embedding").alias("embedding"))


def with_random_vectors(vocab: DataFrame, dim: int, seed: int) -> DataFrame:
    """A seeded He-normal vector for every token that has none from the source."""
    drawn = he_normal(dim, seed, F.col("idx"))
    return vocab.withColumn("embedding", F.when(F.col("origin") == SOURCE, F.col("embedding")).otherwise(drawn))
