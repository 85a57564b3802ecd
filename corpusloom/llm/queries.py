"""The registered queries of the operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    bpe,
    chat,
    decontaminate,
    hmm,
    language,
    mixture,
    negatives,
    quality,
    shards,
    simhash,
    vectors,
    warc,
    whitening,
)
from corpusloom.llm.common import remainder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each document, learned from three quarters of them."""
    docs = table(spark, folder, "documents")
    held_out = remainder("doc_id", 4) == 2
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language.predicted(rows, language.fit(docs, ~held_out)).drop("text")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality of each document, learned from four fifths of the labels."""
    docs = table(spark, folder, "documents")
    held_out = remainder("doc_id", 5) == 0
    net = quality.fit(docs, table(spark, folder, "labels"), ~held_out)
    return quality.scored(docs.withColumn("held_out", held_out), net, ["doc_id", "held_out"])


def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one that says control strings, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(turns.unionByName(spark.sql(chat.PLANTED))))


def op4_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixture.taken(table(spark, folder, "documents"))


def op5_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Links and group of each vector at a cosine of 0.9."""
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


def op6_hmm(spark: SparkSession, folder: str) -> DataFrame:
    """The log10 probability of each document, learned from six sevenths of them."""
    docs = table(spark, folder, "documents")
    held_out = remainder("doc_id", 7) == 2
    return hmm.scores(docs.withColumn("held_out", held_out), ~held_out, ["doc_id", "held_out"])


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Which words of each document lie in a passage of the benchmark."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as ARC, converted to WARC, and what the WARC files hold."""
    return warc.round_trip(table(spark, folder, "pages"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of each document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of each document, none above 1 MiB."""
    rows = shards.sharded(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first four whitened components of each vector."""
    return whitening.whitened(table(spark, folder, "embeddings"))


def op12_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens of each document, and the text that they decode to."""
    import public_tokenizers

    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the label of every seventh is moved on by one first."""
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language, op2_quality, op3_chat, op4_mix, op5_vectors, op6_hmm, op7_decontaminate, op8_warc, op9_simhash, op10_shards,
        op11_whitening, op12_bpe, op13_negatives,
    )
}
ORACLES = {
    "op3_chat": chat.oracle(),
    "op7_decontaminate": decontaminate.oracle(),
    "op8_warc": warc.oracle(),
    "op10_shards": shards.oracle(),
    "op13_negatives": negatives.oracle(),
}
