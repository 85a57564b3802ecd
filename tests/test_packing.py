"""Packing: what moves, and how arrivals land."""

from pyspark.sql import functions as F

from corpusloom.catalog import streams
from corpusloom.operators import pack


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def encoded(spark, lists):
    rows = spark.createDataFrame(list(enumerate(lists)), "id long, input_ids array<int>")
    masks = {"attention_mask": F.transform("input_ids", lambda _: F.lit(1)), "special_tokens_mask": F.transform("input_ids", lambda i: (i < 3).cast("int"))}
    return rows.withColumns(masks)


def test_arrays_are_never_broadcast_for_packing(spark, tmp_path, monkeypatch):
    encoded(spark, [[i] * 50 for i in range(40)]).repartition(4).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    want = None
    for limit, join in ((4_000_000, "BroadcastHashJoin"), (0, "SortMergeJoin")):
        monkeypatch.setattr(pack, "BROADCAST_VALUES", limit)
        chunks = pack.pack_chunks(rows, "id", 8, ("input_ids", "special_tokens_mask"), 10)
        assert join in plan(chunks) and "BuildLeft" not in plan(chunks)
        got = sorted(chunks.collect())
        assert len(got) == 4 * (500 // 8) and want in (None, got)
        want = got


def test_an_arrival_is_written_and_packed_by_many_tasks(spark, tmp_path, monkeypatch):
    texts = [(i, " ".join(["a", "b"] * (1 + i % 7)), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    folders, new_folder = {}, streams.new_folder
    monkeypatch.setattr(streams, "new_folder", lambda s, name: folders.setdefault(name, new_folder(s, name)))
    packed = streams.stream_pack(spark, str(tmp_path))
    files = spark.read.parquet(folders["stream-landed"]).select(F.floor(F.col("doc_id") / 60).alias("arrival"), F.input_file_name().alias("file"))
    landed = files.distinct().groupBy("arrival").agg(F.count("*").alias("n"))
    assert [r.n > 1 for r in landed.collect()] == [True] * 5
    arrivals = {r.arrival for r in spark.read.parquet(folders["stream-packed"]).select("arrival").distinct().collect()}
    tokens = [2 + len(t[1].split()) for t in texts]
    assert arrivals >= {1, 3, 4} and packed.count() == sum(sum(tokens[b : b + 100]) // streams.CHUNK for b in range(0, 300, 100))
