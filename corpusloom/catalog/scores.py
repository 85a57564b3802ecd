"""Accuracy, loss, perplexity, pooling, normalising and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.common import SEED, documents, table, uniform_sql
from corpusloom.catalog.vocabularies import in_long_form
from corpusloom.functions.draws import uniform
from corpusloom.functions.tokens import argmax
from corpusloom.functions.vectors import normalise
from corpusloom.operators import metrics


def _rounded(*columns: str) -> list[Column]:
    return [(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) for c in columns]


def masked_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Both labels as two positions of a row; a draw decides which count and which predictions are right."""
    rows = table(spark, folder, "labels").select(
        "doc_id",
        F.array("quality", "toxic").alias("truth"),
    )
    flat = metrics.positions(rows, "doc_id", "truth")
    scored = flat.select(
        (F.col("doc_id") % 5).cast("int").alias("fold"),
        F.when(uniform(f"{SEED}p", "doc_id", "pos") < 0.8, F.col("truth")).otherwise(1 - F.col("truth")).alias("pred"),
        F.when(uniform(f"{SEED}m", "doc_id", "pos") < 0.5, F.col("truth")).otherwise(-100).alias("label"),
    )
    return metrics.token_accuracy(scored, by=["fold"]).select("fold", "tokens", *_rounded("accuracy"))


def argmax_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return rows.select("vec_id", argmax(F.col("embedding")).alias("best"))


def _losses(spark: SparkSession, folder: str) -> DataFrame:
    """One batch per document: epoch by language, loss and size from its length."""
    return documents(spark, folder).select(
        F.col("lang").alias("epoch"),
        F.col("doc_id").alias("step"),
        (F.col("n_chars") % 9 + 1).alias("n"),
        (F.ln(F.lit(1.0) + F.col("n_chars")) / 4.0).alias("loss"),
    )


def perplexity(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.mean_loss(_losses(spark, folder)).select(*_rounded("loss", "perplexity"))


def perplexity_overflow(spark: SparkSession, folder: str) -> DataFrame:
    huge = _losses(spark, folder).withColumn("loss", F.col("loss") * 10000)
    result = metrics.mean_loss(huge, weight="n")
    return result.select((F.col("perplexity") == float("inf")).alias("is_infinite"), F.round("loss", 3).alias("loss"))


def epoch_metrics(spark: SparkSession, folder: str) -> DataFrame:
    losses = _losses(spark, folder)
    scored = losses.withColumn("loss", F.col("loss") / 2)
    result = metrics.epoch_metrics(losses, scored)
    return result.select("epoch", "step", *_rounded("train_loss", "eval_loss", "perplexity"))


def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Ten vectors make a row; every third position is padding, and the first row is padding only."""
    states = table(spark, folder, "embeddings").select(
        F.expr("vec_id div 10").alias("row_id"),
        F.when((F.col("vec_id") < 10) | (F.col("vec_id") % 3 == 0), 0).otherwise(1).alias("att"),
        F.col("embedding").alias("vec"),
    )
    return in_long_form(metrics.mean_pool(states, "row_id"), "row_id", "vec")


def normalised(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", normalise(F.col("embedding")).alias("vec"))
    return in_long_form(rows, "vec_id", "vec")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring vectors as the two sides of a pair."""
    rows = table(spark, folder, "embeddings").withColumn("pair", F.expr("vec_id div 2"))
    side = lambda n: rows.where(F.col("vec_id") % 2 == n).select("pair", F.col("embedding").alias(f"v{n}"))
    return metrics.pair_losses(side(0).join(side(1), "pair"), "v0", "v1")


def pair_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("pair", *_rounded("alignment_loss"))


def blended_loss(spark: SparkSession, folder: str) -> DataFrame:
    rows = _pairs(spark, folder).withColumn("token_loss", F.ln(F.col("pair") + 2.0))
    blended = metrics.blended_loss(rows, "token_loss", "alignment_loss", 0.9)
    return blended.agg(F.avg("loss").alias("loss"), F.avg("alignment_loss").alias("alignment_loss")).select(*_rounded("loss", "alignment_loss"))


QUERIES = {
    "masked_accuracy": masked_accuracy,
    "argmax_scores": argmax_scores,
    "perplexity": perplexity,
    "perplexity_overflow": perplexity_overflow,
    "epoch_metrics": epoch_metrics,
    "mean_pool": mean_pool,
    "normalise": normalised,
    "pair_alignment": pair_alignment,
    "blended_loss": blended_loss,
}

_LOSS = "SELECT lang AS epoch, doc_id AS step, n_chars % 9 + 1 AS n, ln(1.0::DOUBLE + n_chars) / 4 AS loss FROM documents"
_CELLS = "cells AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"
_PAIRS = f"""{_CELLS},
p AS (SELECT a.vec_id // 2 AS pair, 1 - sum(a.x * b.x) / (greatest(sqrt(sum(a.x * a.x)), 1e-12) * greatest(sqrt(sum(b.x * b.x)), 1e-12)) AS l
      FROM cells a JOIN cells b ON b.vec_id = a.vec_id + 1 AND a.dim = b.dim WHERE a.vec_id % 2 = 0 GROUP BY a.vec_id)"""

ORACLES = {
    "masked_accuracy": f"""WITH f AS (SELECT doc_id, unnest([quality, toxic]) AS truth, unnest([0, 1]) AS pos FROM labels),
s AS (SELECT doc_id % 5 AS fold, CASE WHEN {uniform_sql(f'{SEED}p', 'doc_id', 'pos')} < 0.8 THEN truth ELSE 1 - truth END AS pred,
             CASE WHEN {uniform_sql(f'{SEED}m', 'doc_id', 'pos')} < 0.5 THEN truth ELSE -100 END AS label FROM f)
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS tokens, round(avg(CASE WHEN pred = label THEN 1.0::DOUBLE ELSE 0 END), 6) + 0.0 AS accuracy FROM s WHERE label <> -100 GROUP BY 1""",
    "argmax_scores": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings",
    "perplexity": f"SELECT round(avg(loss), 6) + 0.0 AS loss, round(exp(avg(loss)), 6) + 0.0 AS perplexity FROM ({_LOSS})",
    "perplexity_overflow": f"SELECT round(sum(loss * 10000 * n) / sum(n), 3) AS loss, sum(loss * 10000 * n) / sum(n) > 709.8 AS is_infinite FROM ({_LOSS})",
    "epoch_metrics": f"""WITH t AS ({_LOSS})
SELECT epoch, max(step) AS step, round(avg(loss), 6) + 0.0 AS train_loss, round(sum(loss / 2 * n) / sum(n), 6) + 0.0 AS eval_loss,
       round(exp(sum(loss / 2 * n) / sum(n)), 6) + 0.0 AS perplexity FROM t GROUP BY epoch""",
    "mean_pool": f"""WITH {_CELLS},
m AS (SELECT vec_id // 10 AS row_id, dim, x, CASE WHEN vec_id < 10 OR vec_id % 3 = 0 THEN 0 ELSE 1 END AS att FROM cells)
SELECT row_id, dim, round(sum(x * att) / greatest(sum(att), 1e-9), 6) + 0.0 AS x FROM m GROUP BY row_id, dim""",
    "normalise": f"""WITH {_CELLS}
SELECT vec_id, dim, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12), 6) + 0.0 AS x FROM cells""",
    "pair_alignment": f"WITH {_PAIRS} SELECT pair, round(l, 6) + 0.0 AS alignment_loss FROM p",
    "blended_loss": f"WITH {_PAIRS} SELECT round(avg(0.9::DOUBLE * ln(pair + 2.0::DOUBLE) + 0.1::DOUBLE * l), 6) + 0.0 AS loss, round(avg(l), 6) + 0.0 AS alignment_loss FROM p",
}
