"""What the stages of the pipeline keep, against plain Python; columns that clash; results that partitions do not change."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_learned import components, slow_fingerprint

import corpus_pipeline
from corpusloom.llm import decontaminate, hmm, language, mixture, shards, simhash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return docs.unionByName(docs.limit(20).withColumns({"doc_id": F.col("doc_id") + 100_000, "source": F.lit("copies")}))


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def permuted(x, size, *key):
    for turn in range(1, mixture.ROUNDS + 1):
        mirror = (number(*key, turn) % size - x) % size
        high = max(x, mirror)
        x = mirror if number(*key, turn, high) % 2 else x
    return x


def test_taken_against_plain_python(spark, documents):
    place, _ = mixture.mixed(documents, ["doc_id"])
    rows = place.collect()
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(r.size for r in rows if r.source == s) for s in sources}
    weights = {s: i % 3 + 1 for i, s in enumerate(sources)}
    target, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = left / sum(weights[s] for s in sources if s not in full)
        target = {s: 3 * sizes[s] if s in full else share * weights[s] for s in sources}
        over = {s for s in sources if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    times, per_shard, count = Counter(), Counter(), 0
    for rank, s in enumerate(sources, 1):
        blocks = -(-sizes[s] // mixture.BLOCK)
        need = round(target[s] * blocks / sizes[s])
        count += need
        for slot in range(need):
            lap = slot // blocks
            if lap < 3:
                times[s, permuted(slot % blocks, blocks, mixture.SEED, rank, lap)] += 1
    want = {}
    for s in sources:
        end = 0
        for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.start, r.size)):
            assert r.start == end and r.source_size == sizes[s] and r.target == pytest.approx(target[s], rel=1e-12)
            end += r.size
            words = (times[s, w // mixture.BLOCK] for w in range(r.start, end))
            want[r.doc_id] = sum(words)
    got = {r.doc_id: r for r in mixture.taken(documents).collect()}
    assert {k: r.taken for k, r in got.items()} == want
    assert all(r.taken <= 3 * r.size for r in got.values())


def test_slots_fall_on_all_shards(spark):
    """Ten shards of 1,000 slots on average: counts scatter as multinomial ones do."""
    plan = spark.createDataFrame([(1, 100_000, 100_000.0, 800), (2, 540_000, 540_000.0, 9_200)], "rank int, source_size long, target double, blocks long")
    rows = mixture.slots(plan)
    assert rows.count() == 10_000 and rows.select("rank", "lap", "block").distinct().count() == 10_000
    old, mixture.SHARD = mixture.SHARD, 1_000
    try:
        per_shard = {(r.rank, r.shard): r["count"] for r in mixture.slots(plan).groupBy("rank", "shard").count().collect()}
    finally:
        mixture.SHARD = old
    assert len(per_shard) == 20
    chi = sum((n - (80 if rank == 1 else 920)) ** 2 / (80 if rank == 1 else 920) for (rank, _), n in per_shard.items())
    assert 4 < chi < 45


CLASH = ["_text", "_text_", "_lang", "_score", "_above", "cell", "_cell", "_hash", "_at", "_cuts", "_words", "key", "mark", "fp", "root", "row", "t"]


@pytest.mark.parametrize(
    "stage",
    [
        lambda d, items: language.accepted(d, F.lit(True)),
        lambda d, items: simhash.one_per_group(d),
        lambda d, items: decontaminate.clean(d, items),
        lambda d, items: mixture.mixed_documents(d),
        lambda d, items: shards.sharded(d, limit=2_000),
    ],
)
def test_other_columns_stay(spark, documents, stage):
    marked = documents.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASH})
    got = stage(marked, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert set(marked.columns) <= set(got.columns)
    rows = got.select("doc_id", *CLASH).collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASH)


def test_near_duplicate_stage(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    prints = {r.doc_id: slow_fingerprint(r.text) for r in rows}
    distinct = sorted(set(prints.values()))
    root = components(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i:] if (a ^ b).bit_count() <= 2])
    first = {}
    for key, fp in prints.items():
        first[root[fp]] = min(key, first.get(root[fp], key))
    kept = corpus_pipeline.drop_near_duplicates(spark, documents, FOLDER)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(first.values())


def test_decontamination_stage(spark, documents):
    words = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = set()
    for item in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(item.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = set()
    for r in documents.collect():
        w = words(r.text)
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            clean.add(r.doc_id)
    kept = corpus_pipeline.decontaminated(spark, documents, FOLDER)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == clean and 0 < len(clean) < documents.count()


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", F.lit(1).alias("row"), F.lit(2).alias("t"))
    learn = F.col("doc_id") % 3 != 0
    found = []
    for parts in (2, 5):
        scored = hmm.scores(docs.repartition(parts, F.xxhash64("doc_id")), learn, ["doc_id", "row", "t"], frequent=2_000)
        found.append({r.doc_id: r.score for r in scored.collect()})
        assert {r.row for r in scored.select("row").distinct().collect()} == {1}
    assert found[0].keys() == found[1].keys()
    assert all(found[0][k] == pytest.approx(found[1][k], rel=1e-6) for k in found[0])
