"""Language, quality, language model, WARC, vectors and fingerprints against plain Python."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import graph, hmm, language, quality, queries, simhash, vectors, warc
from corpusloom.llm.common import remainder

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, score string, fp string, t string"
ROWS = [(1, None, "en", "s", "x", "y", "z"), (1, None, "en", "s", "x", "y", "z"), (None, "", None, "s", "x", "y", "z"), (2, "...", "en", None, "x", "y", "z"),
        (3, "word " * 40_000, "en", "s", "x", "y", "z"), (4, "Une ÉTÉ", "fr", "s", "x", "y", "z"), (5, "eine Zeit", "de", "s", "x", "y", "z")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components_are_those_of_a_union(spark):
    rng = np.random.default_rng(3)
    links = [tuple(map(int, x)) for x in rng.integers(0, 400, (250, 2))] + [(1000 - i, 1001 - i) for i in range(30)]
    df = spark.createDataFrame([*links, (None, 5)], "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(df).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == components(nodes, [x for x in links if x[0] != x[1]])
    assert graph.components(df.limit(0)).count() == 0


# language and quality --------------------------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    got = queries.op1_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").toPandas()
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.95
    assert got.where("score not between 0 and 1 or score is null").count() == 0


def test_language_of_odd_rows(spark, docs):
    model = language.fit(docs, F.lit(True))
    got = language.predicted(docs, model)
    assert got.drop("lang_pred").columns == docs.drop("score").columns + ["score"]
    pred = [(r.doc_id, r.lang_pred) for r in got.collect()]
    assert sorted(pred, key=str) == sorted([(1, "und"), (1, "und"), (None, "und"), (2, "und"), (3, "en"), (4, "fr"), (5, "de")], key=str)
    assert language.fit(docs.limit(0), F.lit(True)) == []
    assert {r.lang_pred for r in language.predicted(docs, []).collect()} == {"und"}
    assert [r.lang_pred for r in language.predicted(docs.where("doc_id = 4"), language.fit(docs.where("lang = 'en'"), F.lit(True))).collect()] == ["en"]
    assert language.accepted(docs, F.lit(True)).columns == docs.columns


def test_quality_of_held_out_texts(spark):
    got = queries.op2_quality(spark, SF)
    assert got.count() == 1000 and got.where("score not between 0 and 1 or predicted <> cast(score >= 0.3 as int)").count() == 0
    held = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert ((held.score >= 0.3) == held.quality).mean() > 0.85
    assert held.score[held.quality == 1].mean() > held.score[held.quality == 0].mean() + 0.3


def test_chunks_cover_the_whole_text():
    rng = np.random.default_rng(1)
    net = quality.Network(rng.normal(size=(4, 256, 5)), rng.normal(size=11))
    for size in (0, 1, 3, 4, 127, 128, 131, 132, 1000, quality.CHUNK, quality.CHUNK + 2, quality.CHUNK + 130):
        data = rng.integers(0, 256, size, np.uint8).tobytes()
        b = np.frombuffer(data.ljust(4, b"\0"), np.uint8)
        n = len(b) - 3
        answers = sum(net.taps[j][b[j : j + n]] for j in range(4))
        parts = np.stack([answers[i : i + 128].max(0) for i in range(0, n, 128)])
        np.testing.assert_allclose(quality.halves(data, net.tables()), parts, atol=1e-5)


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (2, None), (None, 0), (3, 7)], "doc_id bigint, quality int")
    net = quality.fit(docs, labels, F.lit(True))
    got = quality.scored(docs, net, ["doc_id"])
    assert got.count() == len(ROWS) and got.columns == ["doc_id", "score", "predicted"]
    assert quality.fit(docs, labels.where("quality = 1"), F.lit(True)) is None
    assert {r.score for r in quality.scored(docs, None, ["doc_id"]).collect()} == {0.5}


# language model --------------------------------------------------------------------------------------------------------


def test_base_score_and_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    learn = remainder("doc_id", 7) != 2
    got = hmm.scores(docs.withColumn("learn", learn), learn, ["doc_id", "text", "learn"], frequent=300).collect()
    counts = Counter(t for r in got if r.learn for t in hmm.tokens((r.text or "").encode()))
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == docs.count()
    for r in got:
        tokens = hmm.tokens((r.text or "").encode())
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in counts for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + distinct + 1)) for t in tokens))
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert sum(r.score for r in got if not r.learn) > sum(r.base_score for r in got if not r.learn)


def test_recursions_equal_a_sum_over_all_paths():
    rng = np.random.default_rng(0)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Model(norm(rng.random(2), 0), norm(rng.random((2, 2)), 1), norm(rng.random((5, 2)), 0))
    lines = [rng.integers(0, 5, n) for n in (1, 4, 2, 4, 3)]
    first, move, emit, whole = np.zeros(2), np.zeros((2, 2)), np.zeros((5, 2)), []
    for x in lines:
        weights = {}
        for path in np.ndindex(*[2] * len(x)):
            p = model.first[path[0]] * model.emit[x[0], path[0]]
            for t in range(1, len(x)):
                p *= model.move[path[t - 1], path[t]] * model.emit[x[t], path[t]]
            weights[path] = p
        total = sum(weights.values())
        whole.append(math.log10(total))
        for path, p in weights.items():
            first[path[0]] += p / total
            for t, s in enumerate(path):
                emit[x[t], s] += p / total
                if t:
                    move[path[t - 1], s] += p / total
    np.testing.assert_allclose(hmm.forward(model, lines), whole)
    for got, want in zip(hmm.expected(model, lines), (first, move, emit, sum(whole)), strict=True):
        np.testing.assert_allclose(got, want)


def test_language_model_of_odd_rows(spark, docs):
    got = hmm.scores(docs, F.lit(True), ["doc_id"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS) and {r.n_tokens for r in got if r.doc_id == 1} == {1}
    assert hmm.scores(docs.limit(0), F.lit(True), ["doc_id"]).count() == 0
    assert all(r.n_known == 0 for r in hmm.scores(docs, F.lit(False), ["doc_id"]).collect())


# WARC ------------------------------------------------------------------------------------------------------------------


def test_pages_come_back(spark):
    html = "é" * 60
    rows = [(5, "http://a/ b\n", html), (3, None, html), (9, "u", html), (3, "again", html), (7, "u", "short"), (8, "u", "short"), (None, "u", html),
            (11, "u", None), (12, "u", ""), (13, "u", "x\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n" + "y" * 200), (14, "u", "q" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, payload string")
    got = [tuple(r) for r in warc.round_trip(pages).collect()]
    want = []
    for page, _, text in rows:
        data = (text or "").encode()
        again = text == html and page is not None and page > 3
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    name, bodies = "x.arc", [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npay\nload", b"", b"bare\r\n\r\n"]
    data = warc.arc_version_block(version, name)
    for b in bodies:
        data += warc.arc_record(version, "http://a/é x", "20240102030405", b, len(data), name)
    found = list(warc.arc_records(data))
    assert [r.body for r in found] == bodies and {r.version for r in found} == {version} and " " not in found[0].uri
    assert warc.split_http(bodies[0])[1] == b"pay\nload" and warc.iso_date(found[0].date) == "2024-01-02T03:04:05Z"
    with pytest.raises(ValueError):
        list(warc.arc_records(data[:-5]))


# vectors ---------------------------------------------------------------------------------------------------------------


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16)).astype(np.float32)
    dense = base[0] + rng.normal(size=(700, 16)).astype(np.float32) * 0.25
    rows = [*base.tolist(), *dense.tolist(), *[base[1].tolist()] * 4, (base[1] * 3).tolist()]
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], [1.0, 2.0], [-0.0] * 16]
    everything = [(i, v, 0, "c") for i, v in enumerate(rows + odd)] + [(None, base[2].tolist(), 0, "c")]
    df = spark.createDataFrame(everything, "vec_id bigint, embedding array<float>, label int, v string")
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    x = np.array(rows, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T) >= 0.9
    np.fill_diagonal(near, False)
    degree = near.sum(1)
    degree[2] += 1
    found = sum(got[i].n_links for i in range(len(rows)))
    assert found >= 0.99 * degree.sum() and all(got[i].n_links <= degree[i] for i in range(len(rows)))
    want = components(range(len(rows)), zip(*np.nonzero(near), strict=True))
    assert np.mean([got[i].component_id == want[i] for i in range(len(rows))]) > 0.99
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(rows)))
    for i in range(len(rows), len(rows) + len(odd)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 1 and got[None].component_id == 2 and not got[None].kept
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# fingerprints ----------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = 0
    for k in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> k & 1 for g in grams) > len(grams):
            bits |= 1 << k
    return bits


def test_fingerprints_and_groups(spark, docs):
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = docs.select("doc_id", "text").unionByName(more.withColumn("doc_id", F.col("doc_id") + 10))
    got = simhash.near_duplicates(df).collect()
    texts = {(r.doc_id, r.text) for r in df.collect()}
    assert len(got) == df.count() and {(r.doc_id, r.fingerprint) for r in got} == {(i, f"{slow_fingerprint(t):016x}") for i, t in texts}
    prints = sorted({int(r.fingerprint, 16) for r in got})
    root = components(prints, [(a, b) for i, a in enumerate(prints) for b in prints[i:] if (a ^ b).bit_count() <= 2])
    least = {}
    for r in got:
        if r.doc_id is not None:
            least[root[int(r.fingerprint, 16)]] = min(r.doc_id, least.get(root[int(r.fingerprint, 16)], r.doc_id))
    assert all(r.component_id == least[root[int(r.fingerprint, 16)]] for r in got)
    kept = simhash.one_per_group(df)
    assert kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_per_group(docs.limit(0)).count() == 0
    assert simhash.one_per_group(docs).columns == docs.columns


def test_trees_find_every_pair():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, 1500, np.uint64)
    flips = lambda x, k: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, len(x)), np.uint64), axis=0)
    crowd = flips(np.repeat(centre[:1], 1500), 3)
    points = np.unique(np.concatenate([centre, flips(centre[:700], 1), flips(centre[:700], 2), crowd]))
    linked = [(i, j) for i, p in enumerate(points) for j in np.flatnonzero(np.bitwise_count(points ^ p) <= 2) if i < j]
    want = components(range(len(points)), linked)
    tree = simhash.upper_levels(points[::7], 4)
    at = {int(p): i for i, p in enumerate(points)}
    found = [(at[int(a)], at[int(b)]) for _, rows in simhash.routed(points, tree) for x, y in simhash.links_within(points[rows]) for a, b in zip(x, y, strict=True)]
    assert all(bin(int(points[a] ^ points[b])).count("1") >= 0 for a, b in found)
    assert components(range(len(points)), found) == want


# pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = docs.limit(2).withColumns({"doc_id": F.lit(None).cast("bigint"), "text": F.lit(None).cast("string")})
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, folder)
        if name != "shards":
            assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert docs.count() > 0
        empty = stage(spark, before.limit(0), folder)
        assert empty.count() == 0
    sums = docs.groupBy("shard").agg(F.sum("n_bytes").alias("n"), F.first("shard_bytes").alias("m"), F.count("*").alias("c"))
    assert sums.where("n <> m or (n > 1048576 and c > 1)").count() == 0
