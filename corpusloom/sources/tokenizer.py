"""Tokenizer files: a vocabulary as one JSON object, merges as a text file, or both in one JSON document."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TOKENS = 4_000_000
#: Fixed: the first line of a merges file.
HEADER = "#version: 0.2"


def save_tokenizer(vocab: DataFrame, merges: Sequence[tuple], folder: str, mode: str = "errorifexists") -> None:
    """``folder/vocab``, one object from token to id in the order of the ids, and ``folder/merges``, a merge a line.

    A vocabulary is as long as it was asked to be, so it is one value; its length is checked.
    """
    if vocab.count() > MAX_TOKENS:
        raise ValueError(f"more than {MAX_TOKENS} tokens")
    by_id = F.array_sort(F.collect_list(F.struct("idx", "token")))
    entries = F.transform(by_id, lambda e: F.struct(e["token"].alias("key"), e["idx"].alias("value")))
    vocab.agg(F.to_json(F.map_from_entries(entries)).alias("value")).write.mode(mode).text(f"{folder}/vocab")
    text = "\n".join([HEADER, *(f"{m[0]} {m[1]}" for m in merges)])
    vocab.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{folder}/merges")


def _whole(spark: SparkSession, path: str) -> DataFrame:
    # An empty part is a file without text.
    return spark.read.text(path, wholetext=True).where("value <> ''")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``(token, idx)`` of a file, or a folder of one, that holds one object from token to id."""
    return _whole(spark, path).select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "idx"))


def read_merges(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """The merges of a file in order, as many as a vocabulary has; header and empty lines are no merges."""
    lines = _whole(spark, path).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    rows = lines.where("line <> '' AND NOT (at = 0 AND startswith(line, '#version'))").collect()
    return [tuple(row["line"].split(" ", 1)) for row in sorted(rows)]


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Vocabulary and merges of one JSON document ``{"model": {"vocab": {…}, "merges": […]}}``.

    A merge is either a text of two tokens with a blank between, or an array of the two.
    """
    model = F.from_json("value", "model struct<vocab: map<string,int>, merges: array<string>>")["model"]
    found = _whole(spark, path).select(model.alias("m"))
    vocab = found.select(F.explode("m.vocab").alias("token", "idx"))
    merges = found.select(F.posexplode("m.merges").alias("at", "merge")).collect()
    return vocab, [_merge(row["merge"]) for row in sorted(merges)]


def _merge(written: str) -> tuple[str, str]:
    # An array inside an array of strings is read as its JSON text.
    sides = json.loads(written) if written.startswith('["') and written.endswith('"]') else written.split(" ", 1)
    return sides[0], sides[1]
