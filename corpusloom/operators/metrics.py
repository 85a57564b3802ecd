"""Scores: accuracy, loss, perplexity, pooling and alignment. All are partial aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.tokens import IGNORE
from corpusloom.functions.vectors import alignment_loss, blend
from corpusloom.operators.vocab import vector_mean


def token_accuracy(rows: DataFrame, predicted: str = "pred", label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Share of right predictions over the positions whose label is not ignored."""
    scored = rows.where(F.col(label) != IGNORE)
    right = (F.col(predicted) == F.col(label)).cast("double")
    return scored.groupBy(*by).agg(F.avg(right).alias("accuracy"), F.count("*").alias("tokens"))


def positions(rows: DataFrame, key: str, *arrays: str) -> DataFrame:
    """Parallel arrays as one row per position."""
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("pos", "t")
    return rows.select(key, zipped).select(key, "pos", *[F.col(f"t.{a}").alias(a) for a in arrays])


def perplexity(loss: Column) -> Column:
    """``exp(loss)``; Spark answers an overflow with infinity."""
    return F.exp(loss)


def mean_loss(rows: DataFrame, loss: str = "loss", weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean loss (weighted by batch size if asked) and its perplexity."""
    if weight is None:
        mean = F.avg(loss)
    else:
        mean = F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)
    return rows.groupBy(*by).agg(mean.alias("loss")).withColumn("perplexity", perplexity(F.col("loss")))


def epoch_metrics(training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """One row per epoch: step, mean training loss per step, evaluation loss weighted by batch size, perplexity."""
    trained = training.groupBy("epoch").agg(F.avg("loss").alias("train_loss"), F.max("step").alias("step"))
    scored = mean_loss(evaluation, weight="n", by=["epoch"]).withColumnRenamed("loss", "eval_loss")
    return scored.join(trained, "epoch").select("epoch", "step", "train_loss", "eval_loss", "perplexity")


def mean_pool(states: DataFrame, row: str, vector: str = "vec", mask: str = "att") -> DataFrame:
    """Mask-weighted mean of a row's position vectors, the divisor floored at 1e-9."""
    return vector_mean(states, row, vector, F.col(mask))


def pair_losses(pairs: DataFrame, first: str, second: str) -> DataFrame:
    return pairs.withColumn("alignment_loss", alignment_loss(F.col(first), F.col(second)))


def blended_loss(rows: DataFrame, token_loss: str, pair_loss: str, alpha: float) -> DataFrame:
    """``alpha`` x token loss + (1 - ``alpha``) x alignment loss."""
    return rows.withColumn("loss", blend(F.col(token_loss), F.col(pair_loss), alpha))
