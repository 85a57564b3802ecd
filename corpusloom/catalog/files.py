"""Sinks and the scans that read them back: every query writes a whole table into the stage folder and reads it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.common import documents, one_line, ONE_LINE_SQL, words_cte, top_words_sql
from corpusloom.catalog.vocabularies import TARGET_WORDS, VOCAB_CTE, merged
from corpusloom.operators import metrics
from corpusloom.operators import vocab as v
from corpusloom.sources import readers, schemas, writers
from corpusloom.sources.stage import new_folder


def csv_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents from csv files whose columns come in another order than the schema names them."""
    path = new_folder(spark, "texts") + ".csv"
    # An empty text is written in quotes, so that it does not come back as NULL.
    rows = documents(spark, folder).select(one_line().alias("text"), "source", "doc_id")
    rows.write.csv(path, header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found = readers.text_files(spark, path, "doc_id bigint, text string")
    return found.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


def json_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents from JSON lines, which is also what the JSON-lines sink writes: one row a line, line ends escaped."""
    path = new_folder(spark, "texts") + ".json"
    writers.save_json_lines(documents(spark, folder).select("doc_id", "text", "lang"), path)
    return readers.text_files(spark, path, "doc_id bigint, text string, lang string")


def txt_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of a txt file is a row."""
    path = new_folder(spark, "texts") + ".txt"
    documents(spark, folder).where("text IS NOT NULL").select("text").write.text(path)
    return readers.text_files(spark, path).groupBy("text").agg(F.count("*").alias("n"))


def saved_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Three splits, one of them dropped, saved one folder a split, and each read back on its own."""
    path = new_folder(spark, "saved")
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    parts = {name: docs.where(F.pmod("doc_id", F.lit(3)) == n) for n, name in enumerate(("train", "validation", "test"))}
    writers.save(writers.without_split(writers.with_splits(parts)), path)
    train, validation = (readers.saved(spark, path, name) for name in ("train", "validation"))
    return train.unionByName(validation).select("split", "doc_id", "text", "lang")


def vocabulary_file(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "vocabulary")
    writers.save_vocabulary(v.word_vocab(v.word_counts(documents(spark, folder, walk=True)), TARGET_WORDS), path)
    return spark.read.schema(schemas.VOCAB).json(path)


def source_id_file(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "source-ids")
    writers.save_ids(v.source_ids(v.reassign_slots(merged(spark, folder))), path)
    return writers.load_ids(spark, path)


def metrics_file(spark: SparkSession, folder: str) -> DataFrame:
    """Mean loss and perplexity over the documents, as JSON lines. The loss of a document stands for a model's."""
    path = new_folder(spark, "metrics")
    losses = documents(spark, folder).select((F.col("n_chars") % 7 / F.lit(2.0)).alias("loss"))
    writers.save_json_lines(metrics.mean_loss(losses), path)
    found = spark.read.schema("loss double, perplexity double").json(path)
    return found.select(*[F.round(c, 6).alias(c) for c in ("loss", "perplexity")])


QUERIES = {
    "csv_scan": csv_scan,
    "json_scan": json_scan,
    "txt_scan": txt_scan,
    "saved_splits": saved_splits,
    "vocabulary_file": vocabulary_file,
    "source_id_file": source_id_file,
    "metrics_file": metrics_file,
}

ORACLES = {
    "csv_scan": f"SELECT doc_id, length(coalesce(t, '')) AS n, md5(coalesce(t, '')) AS digest FROM (SELECT doc_id, {ONE_LINE_SQL} AS t FROM documents)",
    "json_scan": "SELECT doc_id, text, lang FROM documents",
    "txt_scan": r"""SELECT text, count(*) AS n FROM (
  SELECT unnest(string_split_regex(CASE WHEN regexp_matches(text, '(\r\n|\r|\n)$') THEN regexp_replace(text, '(\r\n|\r|\n)$', '') ELSE text END, '\r\n|\r|\n')) AS text
  FROM documents WHERE text IS NOT NULL) GROUP BY text""",
    "saved_splits": "SELECT CASE doc_id % 3 WHEN 0 THEN 'train' ELSE 'validation' END AS split, doc_id, text, lang FROM documents WHERE doc_id % 3 <> 2",
    "vocabulary_file": f"WITH {words_cte()} SELECT token, idx FROM ({top_words_sql('w', TARGET_WORDS)})",
    "source_id_file": f"WITH {VOCAB_CTE} SELECT idx FROM slotted WHERE origin = 'source_lang'",
    "metrics_file": "SELECT round(avg(n_chars % 7 / 2.0), 6) AS loss, round(exp(avg(n_chars % 7 / 2.0)), 6) AS perplexity FROM documents",
}
