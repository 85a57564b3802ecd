"""The language stage against texts of languages that were not learned."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import language
from corpusloom.llm.common import remainder

SF = "/root/testdata/sf0.01"
FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "".join(np.random.default_rng(0).choice(list("abcdefghijklmnopqrstuvwxyz     "), 400)),
    "xqzv kjwq pfgt bvcx zzqk " * 10,
]


def test_foreign_texts_go_and_held_out_texts_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(-1 - i, t, None, "s", len(t)) for i, t in enumerate([*FOREIGN, "123 ...", None, ""]) for t in [t or ""]]
    foreign = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").select(*docs.columns)
    got = corpus_pipeline.identify_language(spark, docs.unionByName(foreign), SF)
    kept = {r.doc_id: r.lang for r in got.select("doc_id", "lang").collect()}
    assert not [i for i in kept if i < 0]
    held = {r.doc_id: r.lang for r in docs.where((remainder("doc_id", 4) == 2) & F.col("text").rlike(r"\p{L}")).collect()}
    stay = [i for i in held if i in kept]
    assert len(stay) >= 0.97 * len(held) and np.mean([held[i] == kept[i] for i in stay]) > 0.97


@pytest.mark.parametrize("families", [2, 8])
def test_margins_do_not_depend_on_the_number_of_families(families):
    rng = np.random.default_rng(families)
    codes = ["en", "fr", "ru", "fi", "tr", "ar", "hi", "fa"][:families]
    bases = {c: rng.permutation(language.DIMENSIONS)[:40] for c in codes}

    def texts(at, n):
        x = np.zeros((n, language.DIMENSIONS), np.float32)
        for row in x:
            np.add.at(row, rng.choice(at, 60), 1)
        return np.sqrt(x / 60)

    x, langs = np.concatenate([texts(bases[c], 60) for c in codes]), np.repeat(codes, 60)
    order = rng.permutation(len(x))
    lengths = np.full(len(x), 300)
    judge = language.Judge(language.fitted(x, langs) + language.floors(x[order], langs[order], lengths))
    clean = np.concatenate([texts(bases[c], 50) for c in codes])
    assert (judge.above(clean, judge(clean)[0], np.full(len(clean), 300)) >= 0).mean() > 0.95
    noise = texts(np.arange(language.DIMENSIONS), 50)
    assert (judge.above(noise, judge(noise)[0], np.full(50, 300)) < 0).all()
