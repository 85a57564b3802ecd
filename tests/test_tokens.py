import math
import random

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import tokens as tk
from corpusloom.functions import vectors as vec
from corpusloom.operators import encode, mask, metrics, pack, substitute


def rows_of(spark, lists, name="ids"):
    return spark.createDataFrame(list(enumerate(lists)), f"id long, {name} array<int>")


@pytest.mark.parametrize("n", [0, 1, 5, 6, 7, 20])
def test_fit(spark, n):
    ids = list(range(10, 10 + n))
    row = rows_of(spark, [ids]).select(tk.fit_ids(F.col("ids"), 6).alias("a"), tk.fit_mask(F.col("ids"), 6, 0).alias("m"), tk.keep_last(F.col("ids"), 6).alias("k")).first()
    assert row.a == (ids[:5] + [2] if n > 6 else ids + [1] * (6 - n))
    assert row.m == (ids + [0] * 6)[:6]
    assert row.k == (ids if n <= 6 else ids[:5] + ids[-1:])


def test_separator_halves_are_per_row(spark):
    lists = [[5, 6, 3, 7], [3, 1], [1, 3], [4, 4], [3, 3, 8], []]
    got = rows_of(spark, lists).select("id", tk.before_separator(F.col("ids"), F.col("ids")).alias("a"), tk.after_separator(F.col("ids"), F.col("ids")).alias("b")).orderBy("id").collect()
    assert [(r.a, r.b) for r in got] == [([5, 6], [7]), ([], [1]), ([1], []), (None, None), ([], [3, 8]), (None, None)]


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([2.0],)], "s array<double>")
    assert [r[0] for r in df.select(tk.argmax(F.col("s"))).collect()] == [1, 0]


@pytest.mark.parametrize("batch_rows", [1, 3, 1000])
def test_chunks_are_each_batch_cut_in_pieces(spark, many_cells, batch_rows):
    rng = random.Random(batch_rows)
    lists = [[rng.randrange(100) for _ in range(rng.choice([0, 1, 2, 7, 40]))] for _ in range(60)]
    df = rows_of(spark, lists, "input_ids").withColumn("att", F.transform("input_ids", lambda x: x + 1000))
    got = {(r.batch, r.chunk): (r.input_ids, r.att) for r in pack.pack_chunks(df, "id", 8, ("input_ids", "att"), batch_rows).collect()}
    want = {}
    for b in range(0, len(lists), batch_rows):
        flat = [i for ids in lists[b : b + batch_rows] for i in ids]
        for c in range(len(flat) // 8):
            piece = flat[c * 8 : c * 8 + 8]
            want[b // batch_rows, c] = (piece, [i + 1000 for i in piece])
    assert got == want


def test_batches_are_padded_to_their_longest_row(spark):
    df = rows_of(spark, [[7] * n for n in (1, 9, 3, 2)], "input_ids").withColumn("attention_mask", tk.ones_like(F.col("input_ids")))
    got = pack.pad_batches(df, "id", 2).orderBy("id").collect()
    assert [r.width for r in got] == [16, 16, 8, 8]
    assert got[0].input_ids == [7] + [1] * 15 and got[0].attention_mask == [1] + [0] * 15


def test_masking_rate_labels_and_way_back(spark):
    ids = [[0, *range(10, 4000), 2]]
    df = rows_of(spark, ids, "input_ids").withColumn("special_tokens_mask", F.transform("input_ids", lambda i: (i <= 2).cast("int")))
    masked = mask.mask_tokens(df, "id", mask_id=4, vocab_size=5000, seed=9)
    row = masked.withColumn("back", tk.unmask(F.col("input_ids"), F.col("labels"))).first()
    assert row.back == ids[0]
    chosen = [i for i, label in enumerate(row.labels) if label != tk.IGNORE]
    assert 0.12 < len(chosen) / 3990 < 0.18 and 0 not in chosen and 3991 not in chosen
    kept = sum(row.input_ids[i] == ids[0][i] for i in chosen) / len(chosen)
    hidden = sum(row.input_ids[i] == 4 for i in chosen) / len(chosen)
    assert 0.72 < hidden < 0.88 and 0.04 < kept < 0.17
    assert all(row.input_ids[i] == ids[0][i] for i in range(3992) if i not in set(chosen))
    assert masked.first().labels == row.labels


@pytest.mark.parametrize("limit", [4_000_000, 1])
def test_substitution_reaches_the_share(spark, monkeypatch, limit):
    monkeypatch.setattr("corpusloom.operators.lookup.BROADCAST_VALUES", limit)
    table = spark.createDataFrame([(i, i < 50, [i] if i < 50 else [1, 2, 3]) for i in range(100)], "idx int, is_source boolean, pieces array<int>")
    rng = random.Random(1)
    lists = [[rng.randrange(100) for _ in range(n)] for n in (0, 1, 10, 200)]
    df = rows_of(spark, lists, "input_ids").withColumns({"attention_mask": tk.ones_like(F.col("input_ids")), "special_tokens_mask": tk.zeros_like(F.col("input_ids"))})
    got = substitute.substitute_tokens(df, "id", table, 0.9, 5).orderBy("id").collect()
    shares = {r.id: r.source_ratio for r in substitute.source_share(df, "id", table.where("is_source").select("idx")).collect()}
    for row, ids in zip(got, lists, strict=True):
        share = sum(i < 50 for i in ids) / len(ids) if ids else 0
        assert shares[row.id] == pytest.approx(share)
        swaps = min(max(int(len(ids) * (0.9 - share)), 0), sum(i >= 50 for i in ids))
        assert row.n_swapped == swaps
        assert len(row.input_ids) == len(ids) + 2 * swaps
        assert len(row.attention_mask) == len(row.special_tokens_mask) == len(row.input_ids)
        # What is left is the input with some target tokens replaced, in place.
        left = iter(row.input_ids)
        for i in ids:
            token = next(left)
            if token != i:
                assert i >= 50 and token == 1 and [next(left), next(left)] == [2, 3]


def test_accuracy_ignores_unlabelled_positions(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (5, -100), (3, 3)], "pred int, label int")
    assert tuple(metrics.token_accuracy(df).first()) == (pytest.approx(2 / 3), 3)


def test_losses(spark):
    df = spark.createDataFrame([(0, 1, 2, 1.0), (0, 2, 1, 4.0), (1, 3, 1, 2.0)], "epoch int, step int, n int, loss double")
    assert metrics.mean_loss(df).first().perplexity == pytest.approx(math.exp(7 / 3))
    assert metrics.mean_loss(df.withColumn("loss", F.lit(1e5))).first().perplexity == math.inf
    got = {r.epoch: (r.step, r.train_loss, r.eval_loss) for r in metrics.epoch_metrics(df, df).collect()}
    assert got == {0: (2, 2.5, 2.0), 1: (3, 2.0, 2.0)}


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [6.0, 8.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vec.normalise(F.col("a")).alias("n"), vec.alignment_loss(F.col("a"), F.col("b")).alias("l")).collect()
    assert rows[0].n == pytest.approx([0.6, 0.8]) and rows[0].l == pytest.approx(0)
    assert rows[1].n == [0, 0] and rows[1].l == 1


def test_pooling_skips_padding(spark):
    df = spark.createDataFrame([(1, 1, [2.0, 4.0]), (1, 0, [9.0, 9.0]), (1, 1, [4.0, 8.0]), (2, 0, [5.0, 5.0])], "row int, att int, vec array<float>")
    got = {r.row: r.vec for r in metrics.mean_pool(df, "row").collect()}
    assert got == {1: [3.0, 6.0], 2: [0.0, 0.0]}


def test_random_vectors_have_the_he_spread(spark):
    rows = spark.range(200).select(vec.he_normal(64, 3, F.col("id")).alias("v")).collect()
    values = [x for r in rows for x in r.v]
    assert abs(sum(values) / len(values)) < 0.01
    assert sum(x * x for x in values) / len(values) == pytest.approx(2 / 64, rel=0.05)


def test_distinct_words_of_a_batch_are_segmented_once():
    rows = pa.array([["ab", "c", "ab"], None, [], ["c", "", "ab"]], pa.list_(pa.string()))
    asked = []
    spelled = encode._spelled(rows, lambda word: asked.append(word) or list(word), pa.string())
    assert spelled.to_pylist() == [["a", "b", "c", "a", "b"], None, [], ["c", "a", "b"]]
    assert asked == ["ab", "c", ""]
    # A slice of a batch, whose offsets do not begin at 0.
    assert encode._spelled(rows.slice(3), list, pa.string()).to_pylist() == [["c", "a", "b"]]
