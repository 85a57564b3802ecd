"""Draws for positions inside Arrow batches, and what uses them: no work per token inside Spark's lambdas."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import draws
from corpusloom.operators import mask, substitute
from corpusloom.operators.lookup import in_slices


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def encoded(spark, lists):
    rows = spark.createDataFrame(list(enumerate(lists)), "id long, input_ids array<int>")
    masks = {"attention_mask": F.transform("input_ids", lambda _: F.lit(1)), "special_tokens_mask": F.transform("input_ids", lambda i: (i < 3).cast("int"))}
    return rows.withColumns(masks)


def test_digests_of_positions_equal_those_of_expressions(spark, monkeypatch):
    monkeypatch.setattr(draws, "WRITTEN", 3)
    keys = spark.createDataFrame([(5, "a"), (None, "ü"), (7, None)], "id long, of string")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda pos: draws.digest(9, "id", "of", pos))
    for row in keys.select(draws.stem(9, "id", "of").alias("stem"), F.explode(drawn).alias("draw"), F.lit(0)).distinct().collect():
        assert row.draw in {d.astype(">u4").tobytes().hex() for d in draws.position_digests(bytes(row.stem), range(5))}
    one = keys.limit(1).select(draws.stem(9, "id").alias("stem"), draws.uniform(9, "id", F.lit(4)).alias("part"), draws.order_key(9, "id", F.lit(4)).alias("order")).first()
    digests = draws.position_digests(bytes(one.stem), [4])
    assert draws.position_parts(digests, 0).tolist() == [one.part] and draws.position_orders(digests).tolist() == [one.order]


def test_slices_are_put_together_again(monkeypatch):
    monkeypatch.setattr("corpusloom.operators.lookup.SLICE", 2)
    lists = pa.array([[1, 2, 3], None, [], [4]], pa.list_(pa.int32()))
    assert in_slices(lambda x, y: y, pa.array(range(4)), lists, by=1).equals(lists)
    assert in_slices(lambda y: y, lists.slice(0, 0), by=0).to_pylist() == []


def test_rows_that_lack_arrays_or_positions_are_kept(spark):
    table = spark.createDataFrame([(4, True, [4]), (5, False, [4, None]), (6, False, []), (7, False, None)], "idx int, is_source boolean, pieces array<int>")
    rows = encoded(spark, [[0, 5, 6, 7, 2], None, [], [5, None, 9]]).withColumn("attention_mask", F.slice("attention_mask", 1, 2))
    found = {r.id: tuple(r)[1:] for r in substitute.substitute_tokens(rows, "id", table, 1.0, 3).collect()}
    assert found == {
        0: ([0, 4, None, 7, 2], [1, 1, 1], [1, 0, 0, 0, 1], 2),
        1: (None, None, None, 0),
        2: ([], [], [], 0),
        3: ([4, None, None, 9], [1, 1, 1], [0, 0, None, 0], 1),
    }
    labels = {r.id: r.labels for r in mask.mask_tokens(rows, "id", 4, 10, probability=1.0).collect()}
    assert labels == {0: [-100, 5, 6, 7, -100], 1: None, 2: [], 3: [5, -100, 9]}


def test_no_token_is_drawn_for_inside_a_lambda(spark):
    table = spark.createDataFrame([(4, True, [4]), (5, False, [4])], "idx int, is_source boolean, pieces array<int>")
    rows = encoded(spark, [[0, 5, 2]])
    for df in (substitute.substitute_tokens(rows, "id", table, 0.9, 3), mask.mask_tokens(rows, "id", 4, 10)):
        assert "md5" not in plan(df) and "array_sort" not in plan(df) and "ArrowEvalPython" in plan(df)
