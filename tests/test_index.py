import pytest
from pyspark.sql import functions as F

from corpusloom.operators import index

DENSE = list(range(1000))
CLUSTERED = [i * 3 for i in range(900)] + [2**61, 2**62, -(2**40)]


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


@pytest.mark.parametrize("ids", [DENSE, CLUSTERED, [5], [7, 9]])
def test_key_at_rank_is_the_sorted_position(spark, many_cells, ids):
    df = frame(spark, ids)
    for rank in {0, len(ids) // 3, len(ids) - 1}:
        assert index.key_at_rank(df, "id", rank) == (sorted(ids)[rank],)


@pytest.mark.parametrize("leaf", [5, 200_000])
def test_all_ranks_in_one_descent(spark, monkeypatch, leaf):
    monkeypatch.setattr(index, "LEAF_ROWS", leaf)
    ids = [3, 3, 3, 3, 3, 3, 3, -(2**61), 2**61] + list(range(100, 140)) + list(range(10**15, 10**15 + 40))
    rows = sorted((n, i) for i, n in enumerate(ids))
    df = spark.createDataFrame(rows, "id long, no int")
    got = index.keys_at_ranks(df, "id", [0, 2, 5, 8, 9, 50, 88], tie="no")
    assert got == {r: rows[r] for r in (0, 2, 5, 8, 9, 50, 88)}
    assert index.keys_at_ranks(df, "id", [1, 88, 4]) == {r: rows[r][:1] for r in (1, 4, 88)}
    assert index.keys_at_ranks(df, "id", []) == {}
    with pytest.raises(ValueError):
        index.keys_at_ranks(df, "id", [3, len(ids)])


@pytest.mark.parametrize("ids", [DENSE, CLUSTERED, [5], []])
def test_row_index_equals_a_global_sort(spark, many_cells, ids):
    got = {r.id: r.row_idx for r in index.row_index(frame(spark, ids), "id").collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids))}


def test_row_index_per_group_with_one_hot_group(spark, many_cells):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}") for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = {(r.g, r.id): r.row_idx for r in index.row_index(df, "id", by=["g"]).collect()}
    for group in {g for _, g in rows}:
        members = sorted(i for i, g in rows if g == group)
        assert [got[group, i] for i in members] == list(range(len(members)))


def test_shuffled_index_is_a_permutation_and_repeats(spark, many_cells):
    drawn = index.order_at_random(frame(spark, DENSE), "id", 3)
    numbered = index.row_index(drawn, "_order", tie="id", hashed=True)
    first = {r.id: r.row_idx for r in numbered.collect()}
    assert sorted(first.values()) == DENSE
    assert first == {r.id: r.row_idx for r in numbered.repartition(3).collect()}
    assert [first[i] for i in DENSE] != DENSE


@pytest.mark.parametrize(("rows", "percent", "valid"), [(1000, 5, 50), (10, 5, 0), (30, 5, 2), (50, 5, 2), (0, 5, 0), (3, 100, 3)])
def test_percent_split_rounds_halves_to_even(spark, many_cells, rows, percent, valid):
    split = index.percent_split(frame(spark, range(rows)), "id", percent)
    assert split.where("split = 'validation'").count() == valid
    assert split.count() == rows
    assert split.where("split = 'validation'").agg(F.max("id")).first()[0] == (valid - 1 if valid else None)


def test_the_split_leaves_texts_where_they_are(spark):
    plan = index.percent_split(frame(spark, DENSE), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("n", [-1, 0, 1, 999, 1000, 5000])
def test_first_n(spark, many_cells, n):
    got = sorted(r.id for r in index.first_n(frame(spark, DENSE), "id", n).collect())
    assert got == DENSE[: max(n, 0)]


def test_sized_sample_follows_the_shuffled_order(spark, many_cells):
    sample = index.sized_sample(frame(spark, DENSE), "id", 100, 20, seed=4)
    order = [r.id for r in index.order_at_random(frame(spark, DENSE), "id", 4).orderBy("_order", "id").collect()]
    got = {r.id: r.split for r in sample.collect()}
    assert got == {**dict.fromkeys(order[:101], "train"), **dict.fromkeys(order[101:122], "validation")}


def test_a_sample_larger_than_the_table_takes_all_of_it(spark):
    sample = index.sized_sample(frame(spark, range(10)), "id", 7, 50, seed=4)
    assert {r.split: r["count"] for r in sample.groupBy("split").count().collect()} == {"train": 8, "validation": 2}


@pytest.mark.parametrize("cells", ["one", "many"])
def test_rows_with_null_groups_and_keys_are_numbered(spark, request, cells):
    if cells == "many":
        request.getfixturevalue("many_cells")
    rows = [(None if i % 2 else "a", None if i == 4 else i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, k bigint")
    got = index.row_index(df, "k", by=["g"]).orderBy("g", "row_idx").collect()
    assert [r.row_idx for r in got] == [*range(10), *range(10)]
    assert [r.k for r in got if r.g == "a"][:2] == [None, 0]
    assert index.row_index(df, "k").count() == 20


@pytest.mark.parametrize("hashed", [False, True])
def test_no_cell_is_large_however_ids_cluster(spark, many_cells, hashed):
    ids = [*range(300), *range(10**6, 10**6 + 300), *range(2**50, 2**50 + 2000), 2**59, *range(2**58, 2**58 + 10**9, 10**7)]
    rows = [(i, "hot" if n % 3 else "cold") for n, i in enumerate(ids)] + [(None, "hot")] * 2
    df = spark.createDataFrame(rows, "id long, g string")
    span = (None, 0, (1 << index.ORDER_BITS) - 1) if hashed else index.key_range(df, "id")
    place, cells, bars = index._cells(df, "id", ["g"], span)
    assert max(bar["count"] for bar in bars) <= index.LEAF_ROWS and sum(bar["count"] for bar in bars) == len(rows)
    assert place(df).columns == ["id", "g", *cells]
    got = index.row_index(df, "id", by=["g"], hashed=hashed).where("id IS NOT NULL").collect()
    for group, nulls in (("hot", 2), ("cold", 0)):
        members = sorted(i for i, g in rows if g == group and i is not None)
        assert {r.id: r.row_idx - nulls for r in got if r.g == group} == {i: n for n, i in enumerate(members)}
