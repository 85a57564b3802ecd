"""Whole jobs: tokenizer files, byte-level encoding, substitution and masked-LM preparation."""

import importlib

from pyspark.sql import functions as F

from corpusloom.operators import encode
from corpusloom.operators import vocab as v
from corpusloom.plans import adaptation, masked_lm, substitution
from corpusloom.sources import tokenizer

TEXTS = ["Hello world, it's 2024!", "", None, "Grüße aus Köln  und  naïve café", "tab\tand\nlines\n\n  end ", "日本語 🙂 x"]


def test_byte_level_encoding_equals_the_library(spark):
    files = importlib.import_module("public_tokenizers")
    library = importlib.import_module("tokenizers").Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    vocab, merges = tokenizer.read_tokenizer(spark, str(files.path("byte_bpe_50k.json")))
    tokens = {row["token"]: row["idx"] for row in vocab.collect()}
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    rows = encode.encode_byte_level(df, "id", "text", merges, tokens, specials=False).collect()
    assert {r.id: r.ids for r in rows} == {
        i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)
    }


def test_tokenizer_files_round_trip(spark, tmp_path):
    vocab = spark.createDataFrame([('"', 5), ("Ġa", 4), ("\\u0041", 7), ("é", 6)], "token string, idx int")
    tokenizer.save_tokenizer(vocab, [("Ġ", "a"), ("#version", "x")], str(tmp_path / "t"))
    assert sorted(tokenizer.read_vocabulary(spark, str(tmp_path / "t/vocab")).collect()) == sorted(vocab.collect())
    assert tokenizer.read_merges(spark, str(tmp_path / "t/merges")) == [("Ġ", "a"), ("#version", "x")]


def test_substitution_by_split(spark):
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, idx int")
    table = spark.createDataFrame(
        [(0, True, None), (2, True, None), (4, True, None), (5, False, [4, 4])], "idx int, is_source boolean, pieces array<int>"
    )
    rows = [("train", 1, "a b"), ("validation", 1, "a b"), ("test", 2, "a b"), ("train", 3, None)]
    texts = spark.createDataFrame(rows, "split string, id int, text string")
    out = substitution.substitution_job(texts, "id", "text", vocab, table, 1.0, seed=1, length=6)
    found = {(r.split, r.id): (r.input_ids, r.n_swapped) for r in out.collect()}
    assert found == {
        ("train", 1): ([0, 4, 4, 4, 2, 1], 1),
        ("validation", 1): ([0, 4, 5, 2, 1, 1], 0),
        ("train", 3): ([0, 2, 1, 1, 1, 1], 0),
    }


def test_masked_rows_packed_and_by_line(spark):
    vocab = spark.createDataFrame([("a", 5), ("b", 6)], "token string, idx int")
    texts = spark.createDataFrame([(1, "a b"), (2, "  "), (3, None), (4, "b a b a")], "id bigint, text string")
    made = masked_lm.masked_lm_rows({"train": texts}, "id", vocab, 4, 7, length=4, line_by_line=True)
    assert {r.row_no: len(r.input_ids) for r in made.collect()} == {1: 4, 4: 4}
    packed = masked_lm.masked_lm_rows({"train": texts, "validation": texts}, "id", vocab, 4, 7, length=4, most={"validation": 1})
    back = packed.select("split", F.expr("transform(input_ids, (i, p) -> if(labels[p] = -100, i, labels[p]))").alias("ids"), "row_no")
    rows = {(r.split, r.row_no): r.ids for r in back.collect()}
    whole = [0, 5, 6, 2, 0, 2, 0, 2, 0, 6, 5, 6, 5, 2]
    assert rows == {("train", i): whole[4 * i : 4 * i + 4] for i in range(3)} | {("validation", 0): whole[:4]}


def test_every_adapted_token_has_a_vector(spark):
    source = spark.createDataFrame([("a", 0), ("b", 1)], "token string, idx int")
    base = spark.createDataFrame([(0, [1.0, 0.0]), (1, [3.0, 2.0]), (9, [9.0, 9.0])], "idx int, embedding array<float>")
    adapted = spark.createDataFrame(
        [("a", 0, v.SOURCE, [1.0, 0.0]), ("ab", 2, v.HELPER, None), ("t", 3, v.TARGET, [5.0, 5.0]), ("u", 4, v.TARGET, None)],
        "token string, idx int, origin string, embedding array<float>",
    )
    rows = {r.idx: r.embedding for r in adaptation.embedding_table(base, adapted, source, 2, seed=1).collect()}
    assert rows.keys() == {0, 2, 3, 4} and all(len(x) == 2 for x in rows.values())
    assert (rows[0], rows[2], rows[3]) == ([1.0, 0.0], [2.0, 1.0], [5.0, 5.0])
