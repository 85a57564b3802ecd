import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import language, lookup

TEXTS = [
    (1, "de", "der hund und die katze schlafen im haus"),
    (2, "de", "das ist ein schönes haus und ein garten"),
    (3, "en", "the dog and the cat sleep in the house"),
    (4, "en", "this is a nice house with a garden"),
]


@pytest.mark.parametrize("limit", [4_000_000, 1])
def test_detection_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr(lookup, "BROADCAST_VALUES", limit)
    texts = spark.createDataFrame(TEXTS, "id long, lang string, text string")
    profile, languages = language.train_profile(texts)
    assert languages == ["de", "en"]
    new = spark.createDataFrame([(1, "die katze und der hund"), (2, "the cat and the dog"), (3, "12 !"), (4, None), (5, "日本語の文")], "id long, text string")
    got = {r.id: r.detected for r in language.detect(new, "id", profile, languages).collect()}
    assert got == {1: "de", 2: "en", 3: None, 4: None, 5: None}


def test_trigrams_overlap_and_cover_the_whole_text(spark):
    text = "Ab1c  déf" + "x" * 5000
    cleaned = "ab c déf" + "x" * 5000
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(language.trigrams(F.col("t"))).first()[0] == [cleaned[i : i + 3] for i in range(len(cleaned) - 2)]


def test_wide_tables_are_not_broadcast(spark, monkeypatch):
    wide = spark.range(10).select("id", F.array_repeat(F.lit(1.0), 768).alias("v"))
    assert lookup.measured(wide) == 10 * (1 + 769)
    monkeypatch.setattr(lookup, "BROADCAST_VALUES", 5000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = lookup.lookup(spark.range(5), wide, "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan


def test_rows_that_share_a_key_are_told_apart(spark):
    learned = spark.createDataFrame([("the cat and the dog and the house", "en"), ("der hund und die katze und das haus", "de")], "text string, lang string")
    profile, languages = language.train_profile(learned)
    texts = [(1, "the dog and the cat"), (1, "der hund und die katze"), (1, "der hund und die katze"), (None, "the house"), (None, "das haus"), (2, None), (2, "")]
    found = language.detect(spark.createDataFrame(texts, "id int, text string"), "id", profile, languages)
    got = sorted((str(r.id), str(r.detected)) for r in found.collect())
    assert got == [("1", "de"), ("1", "de"), ("1", "en"), ("2", "None"), ("2", "None"), ("None", "de"), ("None", "en")]


ODD = ["", None, "a", "ab", "Ab c", "x1y2z", "\U0001d400bc", "a\U0001d400\U0001d401b", "日本語の文 und", "İstanbul", "  ", "aaaa"]


def test_trigrams_of_blocks_with_small_and_large_alphabets(monkeypatch):
    texts = pa.array(["abcab", None, "", "ab", "日本語の", "abc"])
    want = ["abc", "bca", "cab", "日本語", "本語の", "abc"]
    for dense in (0, 200):
        monkeypatch.setattr(language, "DENSE", dense)
        numbers, places, times = language._grams(texts)
        assert [language._text(numbers[i]) for i in places.tolist()] == want and times.tolist() == [3, 0, 0, 0, 2, 1]
    batch = pa.RecordBatch.from_arrays([texts], names=["_letters"])
    for size, rows in ((1, [1, 2, 1, 1, 1]), (8, [4, 1, 1]), (100, [6])):
        monkeypatch.setattr(language, "BLOCK_BYTES", size)
        assert [block.num_rows for block in language._blocks(batch)] == rows


def test_counts_and_scores_are_those_of_single_trigrams(spark, monkeypatch):
    """Letters of any plane, short texts and NULLs."""
    rows = [(i, "abc"[i % 3], t) for i, t in enumerate([*ODD, *(t for *_, t in TEXTS)])]
    texts = spark.createDataFrame(rows, "id long, lang string, text string").coalesce(1)
    want = texts.select("lang", F.explode(language.trigrams(F.col("text"))).alias("gram")).groupBy("gram", "lang").agg(F.count("*").alias("n"))
    assert sorted(language._counted(texts, "text", "lang").collect()) == sorted(want.collect())
    profile, languages = language.train_profile(texts.where("id <> 7"))
    whole = sorted(language.detect(texts, "id", profile, languages).collect())
    monkeypatch.setattr(lookup, "BROADCAST_VALUES", 1)
    assert sorted(language.detect(texts, "id", profile, languages).collect()) == whole


def test_scoring_moves_no_row_a_trigram(spark):
    texts = spark.createDataFrame(TEXTS, "id long, lang string, text string")
    profile, languages = language.train_profile(texts)
    plan = language.detect(texts, "id", profile, languages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
