"""Streaming encode and pack over the documents as arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.common import documents, joined
from corpusloom.catalog.tokens import BATCH, CHUNK, ORACLES as _TOKEN_SQL, encoded
from corpusloom.catalog.vocabularies import MERGES, learn_cte
from corpusloom.functions.text import words
from corpusloom.operators import learn
from corpusloom.operators import vocab as v
from corpusloom.sources import readers, schemas
from corpusloom.sources.stage import new_folder, staged
from corpusloom.streaming.jobs import encode_stream, finish_packing, pack_stream


ARRIVALS = 5


def stream_encode(spark: SparkSession, folder: str) -> DataFrame:
    counts = staged(v.word_counts(documents(spark, folder, walk=True)), "counts")
    merges, _ = learn.learn_merges(counts, MERGES)
    tokens = {row["token"]: row["idx"] for row in learn.learned_tokens(counts, merges).collect()}
    # A pattern, since only patterns stand for one file as well as for a folder of files.
    stream = readers.arriving(spark, f"{folder}/documents.parque[t]", schemas.DOCUMENTS)
    out, checkpoint = new_folder(spark, "stream-encoded"), new_folder(spark, "stream-state")
    tasks = spark.sparkContext.defaultParallelism
    encode_stream(stream, "doc_id", words(F.col("text")), merges, tokens, out, checkpoint, tasks).awaitTermination()
    return spark.read.schema("doc_id bigint, ids array<int>").parquet(out).select("doc_id", joined(F.col("ids")).alias("ids"))


def stream_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of texts that arrive five times, by ranges of their ids; batches go on across the arrivals.

    An arrival is as many files as tasks write at once, and is packed before the next one lands.
    """
    rows = staged(encoded(spark, folder), "encoded")
    landed = new_folder(spark, "stream-landed")
    least, most = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    step = (most - least) // ARRIVALS + 1
    columns = ("input_ids", "attention_mask", "special_tokens_mask")
    out, checkpoint = new_folder(spark, "stream-packed"), new_folder(spark, "stream-state")
    for first in range(least, most + 1, step):
        arrival = rows.where(F.col("doc_id").between(first, first + step - 1))
        arrival.repartition(spark.sparkContext.defaultParallelism).write.mode("append").parquet(landed)
        stream = readers.arriving(spark, landed, rows.schema)
        pack_stream(stream, "doc_id", CHUNK, out, checkpoint, columns, BATCH).awaitTermination()
    finish_packing(spark, out, CHUNK, columns, BATCH)
    return spark.read.parquet(out).select("batch", "chunk", *[joined(F.col(c)).alias(c) for c in columns])


QUERIES = {"stream_encode": stream_encode, "stream_pack": stream_pack}

ORACLES = {
    "stream_encode": f"""WITH {learn_cte()},
letters AS (SELECT DISTINCT unnest(string_split(word, '')) AS token FROM w),
alphabet AS (SELECT token, 3 + row_number() OVER (ORDER BY token) AS idx FROM letters WHERE token <> ''),
made AS ({" UNION ALL ".join(f"SELECT l || r AS token, {i} + (SELECT count(*) FROM alphabet) + 3 AS idx FROM t{i}" for i in range(1, MERGES + 1))}),
tokens AS (SELECT * FROM alphabet UNION ALL SELECT * FROM made),
parts AS (SELECT word, unnest(p) AS piece, generate_subscripts(p, 1) AS at_piece FROM (SELECT word, string_split(s[2:length(s) - 1], '><') AS p FROM w{MERGES})),
ids AS (SELECT replace(replace(word, chr(4), '<'), chr(5), '>') AS word, string_agg(coalesce(idx, 3), ',' ORDER BY at_piece) AS ids
        FROM parts LEFT JOIN tokens ON token = replace(replace(piece, chr(4), '<'), chr(5), '>') GROUP BY 1)
SELECT doc_id, coalesce(string_agg(ids, ',' ORDER BY pos), '') AS ids FROM documents LEFT JOIN w USING (doc_id) LEFT JOIN ids USING (word) GROUP BY doc_id""",
    "stream_pack": _TOKEN_SQL["pack_chunks"],
}
