import collections
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import encode, learn
from corpusloom.operators import vocab as v
from corpusloom.plans import adaptation

SCHEMA = "token string, idx int, string string"


def adapted(source, target, learned):
    """The merging rule on plain dictionaries, one token at a time."""
    vocab = {t: {"idx": i, "origin": v.TARGET} for t, i in target.items()}
    vocab.update({t: {"idx": i, "origin": v.SOURCE} for t, i in source.items()})
    vocab = {t: e for t, e in vocab.items() if "�" not in t}
    ids = collections.Counter(e["idx"] for e in vocab.values())
    move = dict(zip(sorted(i for i, n in ids.items() if n > 1), sorted(set(range(len(vocab))) - set(ids)), strict=False))
    for e in vocab.values():
        if e["origin"] == v.TARGET and e["idx"] in move:
            e["idx"] = move[e["idx"]]
    vocab = {t: e for t, e in vocab.items() if t in learned}
    free = sorted(set(range(len(learned))) - {e["idx"] for e in vocab.values()})
    for token, idx in zip(sorted(learned.keys() - vocab.keys(), key=learned.get), free, strict=False):
        vocab[token] = {"idx": idx, "origin": v.HELPER}
    free = sorted(set(range(len(learned))) - {e["idx"] for e in vocab.values()})
    for e in sorted((e for e in vocab.values() if e["idx"] >= len(learned)), key=lambda e: e["idx"]):
        if free:
            e["idx"] = free.pop()
    return {t: (e["idx"], e["origin"]) for t, e in vocab.items()}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("large", [False, True])
def test_adaptation_equals_the_sequential_rule(spark, request, seed, large):
    if large:
        request.getfixturevalue("many_cells")
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(400)] + ["�a", "b�"]
    pick = lambda n: {t: i for i, t in enumerate(rng.sample(names, n))}
    source, target = pick(150), pick(200)
    learned = {t: i for t, i in pick(220).items() if "�" not in t}
    frame = lambda d: spark.createDataFrame([(t, i, t) for t, i in d.items()], SCHEMA)
    result = adaptation.adapt(frame(source), frame(target), frame(learned).select("token", "idx")).collect()
    got = {r.token: (r.idx, r.origin) for r in result}
    assert got == adapted(source, target, learned)
    assert len({r.idx for r in result}) == len(result) == len(learned)
    assert all(got[t] == (i, v.SOURCE) for t, i in source.items() if t in got and i < len(learned))


def merges_one_by_one(counts, n):
    words, merges = [(list(w), c) for w, c in counts], []
    while len(merges) < n:
        pairs = collections.Counter()
        for s, c in words:
            for pair in zip(s, s[1:], strict=False):
                pairs[pair] += c
        if not pairs:
            break
        (a, b), c = min(pairs.items(), key=lambda e: (-e[1], e[0]))
        merges.append((a, b, c))
        words = [(joined(s, a, b), c) for s, c in words]
    return merges, words


def joined(s, a, b):
    out, i = [], 0
    while i < len(s):
        step = 2 if s[i : i + 2] == [a, b] else 1
        out.append("".join(s[i : i + step]))
        i += step
    return out


WORDS = [("a\U0001f600a\U0001f600", 7), ("aaaa", 3), ("aaa", 5), ("abab", 4), ("ababa", 2), ("banana", 6), ("abcabc", 3), ("bcabc", 2), ("é日é日", 4), ("x", 9)]


@pytest.mark.parametrize(("known", "sample"), [(10_000, 100), (10_000, 2), (3, 100), (1, 1)])
def test_merges_are_the_textbook_ones(spark, known, sample):
    counts = spark.createDataFrame(WORDS, "word string, n long")
    merges, spelled = learn.learn_merges(counts, 20, stage_every=4, known=known, sample=sample)
    want, words = merges_one_by_one(WORDS, 20)
    assert merges == want
    got = sorted((r.s, r.n) for r in spelled.select(F.col("pieces").alias("s"), "n").collect())
    assert got == sorted(words)


@pytest.mark.parametrize("at_once", [1, 64])
def test_batched_merges_are_those_of_one_at_a_time(spark, at_once):
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 9))): rng.randrange(1, 400) for _ in range(150)}
    counts = spark.createDataFrame(list(words.items()), "word string, n long")
    for sample in (1_000, 12):
        merges, _ = learn.learn_merges(counts, 40, at_once=at_once, sample=sample)
        assert merges == merges_one_by_one(list(words.items()), 40)[0]


@pytest.mark.parametrize("sample", [20_000, 400])
def test_two_thousand_merges_of_real_words(spark, sample):
    """A whole vocabulary: as many merges as the words have, up to two thousand, with few known pairs and a small sample."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.word, r.n) for r in v.word_counts(docs).where("length(word) < 12").collect())[::4]
    merges, spelled = learn.learn_merges(spark.createDataFrame(rows, "word string, n long"), 2_000, known=3_000, sample=sample)
    want, left = merges_quickly(rows, 2_000)
    assert merges == want and len(merges) == 2_000
    assert sorted((r.pieces, r.n) for r in spelled.collect()) == sorted(left)


def test_blocks_of_words_give_the_same_merges(spark, monkeypatch):
    monkeypatch.setattr(learn, "BLOCK_BYTES", 1)
    counts = spark.createDataFrame(WORDS, "word string, n long").coalesce(1)
    parts = learn._in_numbers(counts).toArrow().to_batches(max_chunksize=2)
    assert [len(weights) for weights, _, _ in learn._blocks(iter(parts))] == [2] * 5
    merges, spelled = learn.learn_merges(counts, 20, stage_every=4)
    want, words = merges_one_by_one(WORDS, 20)
    assert merges == want
    assert sorted((r.pieces, r.n) for r in spelled.collect()) == sorted(words)


def merges_quickly(counts, n):
    """One merge at a time, with the pair counts of touched words kept up to date."""
    words, merges, pairs = [(list(w), c) for w, c in counts], [], collections.Counter()
    for s, c in words:
        for pair in zip(s, s[1:], strict=False):
            pairs[pair] += c
    while len(merges) < n:
        (a, b), c = min(((p, k) for p, k in pairs.items() if k > 0), key=lambda e: (-e[1], e[0]))
        merges.append((a, b, c))
        for i, (s, k) in enumerate(words):
            if a in s and b in s and (a, b) in zip(s, s[1:], strict=False):
                for pair in zip(s, s[1:], strict=False):
                    pairs[pair] -= k
                words[i] = (joined(s, a, b), k)
                for pair in zip(words[i][0], words[i][0][1:], strict=False):
                    pairs[pair] += k
    return merges, words


def test_marks_inside_words_are_letters_like_others(spark):
    words = [("a\x03b", 5), ("a\x02\x03", 3), ("\x04A\x04", 4), ("\x04\x03A", 2)]
    counts = spark.createDataFrame(words, "word string, n long")
    merges, spelled = learn.learn_merges(counts, 10)
    want, left = merges_one_by_one(words, 10)
    assert merges == want
    assert sorted((r.s, r.n) for r in spelled.select(F.col("pieces").alias("s"), "n").collect()) == sorted(left)


def test_encoding_follows_the_merges(spark):
    counts = spark.createDataFrame(WORDS, "word string, n long")
    merges, spelled = learn.learn_merges(counts, 6)
    tokens = {r.token: r.idx for r in learn.learned_tokens(counts, merges).collect()}
    texts = spark.createDataFrame([(1, ["aaaa", "banana", "é日é日"]), (2, []), (3, ["abab?"])], "id long, words array<string>")
    pieces = {r.id: r.p for r in texts.select("id", encode.segment_words(F.col("words"), merges).alias("p")).collect()}
    spellings = {"".join(r.s): r.s for r in spelled.select(F.col("pieces").alias("s")).collect()}
    assert pieces[1] == [p for w in ("aaaa", "banana", "é日é日") for p in spellings[w]] and pieces[2] == []
    ids = {r.id: r.ids for r in encode.encode_with_merges(texts, "id", F.col("words"), merges, tokens).collect()}
    assert ids[1] == [tokens[p] for p in pieces[1]] and ids[3][-1] == encode.UNKNOWN


def test_too_many_merges_are_refused(spark, monkeypatch):
    monkeypatch.setattr(encode, "MAX_MERGES", 1)
    with pytest.raises(ValueError):
        encode.segment_words(F.array(F.lit("a")), [("a", "b"), ("b", "c")])


@pytest.mark.parametrize("limit", [4_000_000, 1])
def test_word_ids_with_and_without_broadcast(spark, monkeypatch, limit):
    monkeypatch.setattr("corpusloom.operators.lookup.BROADCAST_VALUES", limit)
    vocab = spark.createDataFrame([("the", 4), ("end", 5)], "token string, idx int")
    texts = spark.createDataFrame([(1, "the the end\nof the"), (2, " "), (3, None), (4, "the " * 500)], "id long, text string")
    got = {r.id: r.ids for r in encode.word_ids(texts, "id", "text", vocab).collect()}
    assert got == {1: [4, 4, 5, 3, 4], 2: [], 3: [], 4: [4] * 500}
    twice = encode.word_ids(texts.union(texts), "id", "text", vocab, unknown=9).collect()
    assert len(twice) == 8 and sorted(r.ids for r in twice if r.id == 1) == [[4, 4, 5, 9, 4]] * 2


def test_substitutes_spell_unknown_tokens(spark):
    source = spark.createDataFrame([("a", 4), ("b", 5), ("ab", 6)], "token string, idx int")
    target = spark.createDataFrame([("ab", 10), ("ba", 11), ("b?a", 12)], "token string, idx int")
    got = {r.idx: r.pieces for r in encode.substitutes(target, source).collect()}
    assert got == {10: [6], 11: [5, 4], 12: [5, 3, 4]}


def test_substitutes_follow_the_merges_of_the_source(spark):
    tokens = [("a", 4), ("b", 5), ("c", 6), ("ab", 7), ("abc", 8), ("cab", 9)]
    source = spark.createDataFrame(tokens, "token string, idx int")
    target = spark.createDataFrame([("abcab", 10), ("cab", 11), ("bbcx", 12), ("ccab", 13)], "token string, idx int")
    merges = [("a", "b", 9), ("ab", "c", 5), ("b", "c", 3)]
    got = {r.idx: r.pieces for r in encode.substitutes(target, source, merges).collect()}
    # The source knows "cab" whole; of "bbcx" the piece "bc" has no id and is spelled, and "x" is unknown.
    assert got == {10: [8, 7], 11: [9], 12: [5, 5, 6, 3], 13: [6, 6, 7]}


def test_overlay_keeps_source_rows(spark):
    base = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], "idx int, embedding array<float>")
    vocab = spark.createDataFrame([(0, v.SOURCE, [9.0]), (1, v.TARGET, [8.0])], "idx int, origin string, embedding array<float>")
    assert {r.idx: r.embedding for r in v.overlay(base, vocab).collect()} == {0: [1.0], 1: [8.0], 2: [3.0]}


def test_overlay_enlarges_the_matrix(spark):
    base = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "idx int, embedding array<float>")
    tokens = spark.createDataFrame([(1, "new", [5.0]), (7, "new", [6.0])], "idx int, origin string, embedding array<float>")
    got = {r.idx: list(r.embedding) for r in v.overlay(base, tokens).collect()}
    assert got == {0: [1.0], 1: [5.0], 7: [6.0]}
