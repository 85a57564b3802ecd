from statistics import median

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lookup


@pytest.fixture
def by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_VALUES", 0)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def rows(spark, hot, null):
    """Words of which one makes up a share of the rows, and NULL another."""
    draw = F.col("id") % 100
    word = F.when(draw < hot, "the").when(draw < hot + null, None).otherwise(F.concat(F.lit("w"), (F.xxhash64("id") % 997).cast("string")))
    return spark.range(60_000).select("id", word.alias("word"))


@pytest.mark.parametrize("hot, null", [(0, 0), (34, 0), (20, 33)])
def test_hot_keys_are_cut_by_their_share(spark, tmp_path, by_shuffle, hot, null):
    rows(spark, hot, null).write.parquet(f"{tmp_path}/facts")
    facts = spark.read.parquet(f"{tmp_path}/facts")
    table = facts.select("word").distinct().withColumn("n", F.length("word"))
    found = lookup.lookup(facts, table, "word")
    assert found.columns == ["word", "id", "n"] and found.count() == 60_000
    assert found.where("n IS DISTINCT FROM length(word)").count() == 0
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) <= 2 * median(tasks) and len(tasks) == 8
    pieces = lookup.hot_keys(facts, "word")
    assert pieces.keys() == {w for w, share in (("the", hot), (None, null)) if share}
    assert all(abs(pieces[w] - share * 0.64) <= 1 for w, share in (("the", hot), (None, null)) if share)


def test_empty_and_equal_rows(spark, by_shuffle):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "word string, n int")
    assert lookup.hot_keys(table.limit(0), "word") == {}
    assert lookup.lookup(table.select("word").limit(0), table, "word").count() == 0
    same = spark.createDataFrame([("a",)] * 50 + [("z",)] * 50, "word string")
    assert sorted({(r.word, r.n) for r in lookup.lookup(same, table, "word").collect()}) == [("a", 1), ("z", None)]
    assert lookup.lookup(same, table, "word").count() == 100


def test_arrays_are_looked_up_in_slices(spark, monkeypatch):
    rows = [[1, 2, 3], [], [4], [5, 6, 7, 8, 9], [], [1]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(rows, pa.list_(pa.int32()))], names=["k", "v"])
    for size in (1, 4, 100):
        monkeypatch.setattr(lookup, "SLICE", size)
        for whole in (batch, pa.concat_batches([batch, batch]).slice(6)):
            parts = list(lookup.sliced(whole, 1))
            assert [row for part in parts for row in part.column(1).to_pylist()] == rows
            assert all(part.num_rows == 1 or len(part.column(1).flatten()) <= size for part in parts)
