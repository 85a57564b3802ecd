import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions.text import words
from corpusloom.operators.encode import encode_with_merges
from corpusloom.operators.pack import pack_chunks
from corpusloom.sources import readers, schemas, stage, writers
from corpusloom.streaming.jobs import encode_stream, finish_packing, pack_stream


def test_file_types(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\nthree\n")
    (tmp_path / "a.json").write_text('{"text": "j", "x": 1}\n')
    (tmp_path / "a.csv").write_text('text\n"c, ""q"""\n')
    read = lambda name: [r.text for r in readers.text_files(spark, str(tmp_path / name)).collect()]
    assert read("a.txt") == ["one", "", "three"] and read("a.json") == ["j"] and read("a.csv") == ['c, "q"']
    with pytest.raises(ValueError):
        readers.text_files(spark, "a.xml")


def test_corpus_by_name_and_configuration(spark, tmp_path):
    spark.createDataFrame([(1, "a")], schemas.WEB_TEXT).write.parquet(str(tmp_path / "web" / "de"))
    assert readers.corpus(spark, str(tmp_path), "web", "de", schemas.WEB_TEXT).collect() == [(1, "a")]


def test_splits_round_trip_and_prune(spark, tmp_path):
    part = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    both = writers.with_splits({"train": part(1, 2), "validation": part(3), "test": part(4)})
    writers.save(writers.without_split(both), str(tmp_path / "d"))
    assert {r.split: r.n for r in readers.saved(spark, str(tmp_path / "d")).groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 2, "validation": 1}
    only = readers.saved(spark, str(tmp_path / "d"), "validation")
    assert [r.id for r in only.collect()] == [3]
    assert "PartitionFilters: [isnotnull(split" in only._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a", "x")], "id long, text string, other string").write.parquet(str(tmp_path / "t"))
    plan = readers.non_empty(readers.with_text(spark.read.parquet(str(tmp_path / "t"))))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(text)]" in plan and "ReadSchema: struct<text:string>" in plan


def test_exports(spark, tmp_path):
    vocab = spark.createDataFrame([("a", 1, "x")], "token string, idx int, origin string")
    writers.save_vocabulary(vocab, str(tmp_path / "v"))
    assert spark.read.schema(schemas.VOCAB).json(str(tmp_path / "v")).collect() == [("a", 1)]
    writers.save_ids(vocab, str(tmp_path / "i"))
    assert writers.load_ids(spark, str(tmp_path / "i")).collect() == [(1,)]
    writers.save_json_lines(vocab, str(tmp_path / "j"))
    lines = [json.loads(line) for f in (tmp_path / "j").glob("*.json") for line in f.read_text().splitlines()]
    assert lines == [{"token": "a", "idx": 1, "origin": "x"}]


def test_name_list_is_a_set_encoded_twice(spark):
    names = ["a/b", 'q"uo\\te', "ü/日本"]
    df = spark.createDataFrame([(n,) for n in names], "repo string")
    for part_rows in (100, 1):
        lines = writers.name_list(df, part_rows=part_rows)
        decoded = [json.loads(json.loads(r.value)) for r in lines.collect()]
        assert sorted(n for d in decoded for n in d["py/set"]) == sorted(names)
        assert sorted(r.repo for r in writers.read_name_list(lines).collect()) == sorted(names)


def test_text_column_choice(spark):
    a = spark.createDataFrame([("x", "t")], "first string, text string")
    assert readers.with_text(a).collect() == [("t",)]
    assert readers.with_text(a.select("first")).collect() == [("x",)]


def test_stages_go_to_the_named_folder(spark):
    folder = spark.conf.get(stage.CHECKPOINT_DIR)
    table = stage.staged(spark.range(3).toDF("id"), "x")
    assert all(folder in f for f in table.inputFiles()) and table.count() == 3


def test_small_tables_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    assert readers.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("sizes", [(13, 1, 7, 19), (14, 7, 7, 12), (3, 2, 1, 34)])
def test_streamed_batches_go_on_across_arrivals(spark, tmp_path, sizes):
    """Arrivals that leave rows, leave none, and do not fill a batch; later ones have smaller keys."""
    rows = spark.range(40).select("id", F.transform(F.sequence(F.lit(0), F.col("id") % 5), lambda i: i.cast("int")).alias("input_ids"))
    end = 40
    for size in sizes:
        rows.where((F.col("id") < end) & (F.col("id") >= end - size)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        end -= size
    out = str(tmp_path / "out")
    for run in (1, 2):  # a second run finds nothing new
        stream = readers.arriving(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=1)
        pack_stream(stream, "id", 4, out, str(tmp_path / "state"), batch_rows=7).awaitTermination()
        finish_packing(spark, out, 4, batch_rows=7)
    starts = [40 - sum(sizes[: n + 1]) for n in range(len(sizes))]
    place = F.coalesce(*[F.when(F.col("id") >= s, F.col("id") - s + sum(sizes[:n])) for n, s in enumerate(starts)])
    want = pack_chunks(rows.withColumn("place", place), "place", 4, batch_rows=7)
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select("batch", "chunk", "input_ids").collect())
    assert key(spark.read.parquet(out)) == key(want) and want.count() > 20


def test_streamed_encoding_equals_batch_encoding(spark, tmp_path):
    texts = spark.createDataFrame([(1, "ab ba"), (2, ""), (3, "abab")], "id long, text string")
    texts.write.parquet(str(tmp_path / "in"))
    merges, tokens = [("a", "b", 1)], {"a": 4, "b": 5, "ab": 6}
    stream = readers.arriving(spark, str(tmp_path / "in"), texts.schema)
    encode_stream(stream, "id", words(F.col("text")), merges, tokens, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = encode_with_merges(texts, "id", words(F.col("text")), merges, tokens)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(batch.collect()) == [(1, [6, 5, 4]), (2, []), (3, [6, 6])]


def test_csv_and_json_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\n1,one\n2,two\n")
    (tmp_path / "a.json").write_text('{"body": "one"}\n')
    csv = readers.text_files(spark, str(tmp_path / "a.csv"), "text string, id bigint")
    assert csv.orderBy("id").collect() == [("one", 1), ("two", 2)]
    assert [r.text for r in readers.with_text(readers.text_files(spark, str(tmp_path / "a.json"))).collect()] == ["one"]


def test_a_table_of_one_file_or_of_many_is_encoded_as_one_stream(spark, tmp_path):
    """The table may be a single file, or a folder of several as Spark writes it, or an empty one."""
    from corpusloom.catalog import streams

    rows = [(i, text, "en", "s", 5) for i, text in enumerate(["ab ab", "abc", "", None, "ab c", "c"])]
    for name, some in (("full", rows), ("empty", [])):
        docs = spark.createDataFrame(some, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        docs.repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
    docs = spark.createDataFrame(rows, docs.schema).coalesce(1)
    docs.write.parquet(str(tmp_path / "written"))
    (tmp_path / "file").mkdir()
    (tmp_path / "file/documents.parquet").write_bytes(next((tmp_path / "written").glob("*.parquet")).read_bytes())
    for name in ("full", "file"):
        got = {r.doc_id: r.ids for r in streams.stream_encode(spark, str(tmp_path / name)).collect()}
        # Letters a, b, c from 4 on, then ab and abc.
        assert got.keys() == set(range(6)) and got[0] == "7,7" and got[4] == "7,6" and got[2] == ""
    assert streams.stream_encode(spark, str(tmp_path / "empty")).collect() == []
