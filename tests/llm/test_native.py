"""Chat, decontamination, mixture and shards against SQL or plain Python."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import check
from corpusloom.llm import chat, decontaminate, mixture, queries, shards

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, shard string, w string, token string, row string"
ROWS = [
    (1, "A b c", "en", "s", 5, 1, "x", "w", "t", "r"),
    (1, "A b c", "en", "s", 5, 1, "x", "w", "t", "r"),
    (2, None, None, None, None, None, None, None, None, None),
    (None, "", "en", "s", 0, 1, "x", "w", "t", "r"),
    (3, " \t\n", "en", None, 3, 1, "x", "w", "t", "r"),
    (4, "É e1 " * 3000, "fr", "t", 15000, 1, "x", "w", "t", "r"),
    (5, "one two three four five six seven eight nine ten eleven", "en", "u", 55, 1, "x", "w", "t", "r"),
    (6, "x ONE-two three four five six seven eight nine ten", "en", "u", 55, 1, "x", "w", "t", "r"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_matches_sql(spark, monkeypatch, name):
    monkeypatch.setattr(check.entry, "queries", lambda: queries.QUERIES)
    monkeypatch.setattr(check.entry, "oracle_sql", lambda: queries.ORACLES)
    verdict, _ = check.compare(spark, check.connect("/root/testdata/sf0.001"), "/root/testdata/sf0.001", name)
    assert verdict.startswith("ok"), verdict


# chat ------------------------------------------------------------------------------------------------------------------

TALKS = [
    (1, 0, "user", "plain"), (1, 1, "assistant", "\\ [INST] \\\\</s> [\\INST] <s"), (2, 1, "assistant", "first?"), (2, 2, None, None),
    (3, None, "user", "late"), (3, 0, "system", "[/INST]"), (None, 0, "user", "nobody"), (4, 0, "us</s>er", ""), (4, 0, "us</s>er", ""),
]


def test_conversations_come_back_as_written(spark):
    turns = spark.createDataFrame([(*t, "clash") for t in TALKS], "conv_id bigint, turn bigint, role string, text string, turns string")
    rows = chat.read_back(chat.formatted(turns)).collect()
    want: dict = {}
    for c, t, r, x in TALKS:
        want.setdefault(c, []).append(((t is None, t or 0), r or "", x or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in rows} == {c: [(r, x) for _, r, x in sorted(v)] for c, v in want.items()}
    assert {r.conv_id: r.valid for r in rows} == {1: True, 2: False, 3: False, None: False, 4: False}
    assert {r.conv_id: list(r.loss_texts) for r in rows}[1] == [TALKS[1][3]]
    digest = {r.conv_id: r for r in chat.digests(chat.formatted(turns)).collect()}[1]
    assert digest.loss_sha256 == hashlib.sha256(TALKS[1][3].encode()).hexdigest() and digest.loss_chars == len(TALKS[1][3])
    assert chat.digests(chat.formatted(turns.limit(0))).count() == 0


# decontamination -------------------------------------------------------------------------------------------------------


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(rows, items, size=10):
    out = Counter()
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            for k in range(max(len(p) - size, 0) + 1 if p else 0):
                run = p[k : k + size]
                for i in range(len(w) - len(run) + 1):
                    if w[i : i + len(run)] == run:
                        hit |= set(range(i, i + len(run)))
                        found.add("" if item is None else str(item))
        out[key, len(w), len(hit), ",".join(sorted(found))] += 1
    return out


@pytest.mark.parametrize("most", [100_000, -1])
def test_hits_equal_those_of_a_scan(spark, docs, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    items = [
        (10, "One two three four five six seven eight nine ten"), (9, "e1 É"), (9, None), (None, "B, c!"), (12, ""), (11, "nine ten eleven"),
        (13, "é e1"),
    ]
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, items int")
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate.hits(docs, table, ["doc_id"]).collect())
    assert got == brute_hits([(r[0], r[1]) for r in ROWS], items)
    assert decontaminate.hits(docs, table.limit(0), ["doc_id"]).where("n_hit > 0").count() == 0
    assert decontaminate.hits(docs.limit(0), table, ["doc_id"]).count() == 0
    left = decontaminate.clean(docs, table)
    assert left.columns == docs.columns and sorted(r.doc_id or -1 for r in left.collect()) == [-1, 2, 3]


# mixture ---------------------------------------------------------------------------------------------------------------


def water_filling(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full: set = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in order}
        full |= above


def test_targets_share_the_excess_by_weight(spark):
    sizes = {"b": 5, "a": 1000, "é": 40, "z": 3, None: 7, "c": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixture.targets(rows).collect()}
    assert got == pytest.approx(water_filling(sizes))


def test_mix_comes_near_its_targets(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixture.taken(rows).join(rows.select("doc_id", "source"), "doc_id").toPandas()
    assert len(got) == 1000 and (got.taken <= 3 * got["size"]).all()
    assert (got["size"].to_numpy() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in rows.toPandas().set_index("doc_id").text[got.doc_id]]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), source_size=("source_size", "first"))
    assert (by["size"] == by.source_size).all()
    want = water_filling(by["size"].to_dict())
    assert by.target.to_dict() == pytest.approx(want)
    assert (abs(by.taken - by.target) <= 0.03 * by.target).all()
    again = mixture.taken(rows.repartition(3)).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()


def test_mix_of_odd_rows(spark, docs):
    got = mixture.taken(docs).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(r[0] or -1 for r in ROWS)
    assert {r.doc_id: r.size for r in got} == {1: 3, 2: 0, None: 0, 3: 0, 4: 6000, 5: 11, 6: 10}
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixture.taken(docs.limit(0)).count() == 0
    mixed = mixture.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text) and r.text.replace("\n", " ").strip() in dict((x[0], x[1]) for x in ROWS)[r.doc_id] * 2
    assert taken[4] == sum(r.taken for r in got if r.doc_id == 4)
    assert mixture.mixed_documents(docs.limit(0)).count() == 0


def test_shuffled_is_a_permutation(spark):
    for size in (1, 2, 7, 100):
        df = spark.range(size).select(mixture.shuffled(F.col("id"), F.lit(size).cast("bigint"), "key").alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(size))


# shards ----------------------------------------------------------------------------------------------------------------


def test_shards_keep_to_the_limit(spark, docs):
    got = shards.sharded(docs, limit=40).collect()
    assert len(got) == len(ROWS)
    sums, rows = Counter(), Counter()
    for r in got:
        sums[r.shard] += r.n_bytes
        rows[r.shard] += 1
        assert r.n_bytes == len((r.text or "").encode())
    assert all(sums[r.shard] == r.shard_bytes and rows[r.shard] == r.shard_docs for r in got)
    assert all(n <= 40 or rows[s] == 1 for s, n in sums.items())
    prefixes = [s for s in sums]
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)
    assert shards.sharded(docs.limit(0)).count() == 0
    # A bucket was split only because its parent was too large.
    for s in prefixes:
        if s:
            parent = [r for r in got if r.shard.startswith(s[:-1])]
            assert sum(r.n_bytes for r in parent) > 40 and len(parent) > 1


def test_copies_beyond_the_limit_are_cut(spark):
    df = spark.createDataFrame([(1, "abcd")] * 10, "doc_id bigint, text string")
    got = shards.sharded(df, limit=9).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [2] * 5 and all(r.shard_bytes == 8 for r in got)
