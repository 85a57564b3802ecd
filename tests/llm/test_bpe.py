"""Tokens against the library that the tokenizer files are for, and the automaton against merging step by step."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest

from corpusloom.llm import bpe

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

PATH = public.path("word_bpe_49k.json")
TEXTS = [
    None,
    "",
    " \t\n",
    "Hello  World's 12 don't",
    "<|startoftext|> a<|endoftext|>b <|ENDOFTEXT|>",
    "x</w> </w>y",
    "héllo é Ünḯ 中文 \U0001f600\U0001f601",
    "\x00\x01\x1c\x1fabc d\x85e\xa0f",
    "İstanbul ẞ ΣΑΣ ΟΣ",
    "\U00010d50\U00016ea0 ꟋᲉ ՘",
    "hahahahaha" * 2_000,
    "word " * 20_000,
]


def library():
    return tokenizers.Tokenizer.from_file(PATH)


def expected(text):
    lib = library()
    ids = lib.encode(text or "", add_special_tokens=False).ids
    raw, back = np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_digests_equal_the_library(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 0), (None, "null key", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    got = sorted((tuple(r) for r in bpe.digests(docs, PATH).collect()), key=str)
    assert got == sorted(((i, *expected(t)) for i, t, _, _ in rows), key=str)


def test_encoded_and_decoded(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id bigint, text string")
    rows = bpe.encoded(docs, PATH, ["doc_id"])
    assert {r.doc_id: r.ids for r in rows.collect()} == {1: library().encode("Hello world", add_special_tokens=False).ids, 2: []}
    assert {r.doc_id: r.decoded for r in bpe.decoded(rows, PATH, ["doc_id"]).collect()} == {1: "hello</w> world</w>", 2: ""}
    strange = spark.createDataFrame([(1, [3306, None, 10**6]), (2, None)], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decoded(strange, PATH, ["doc_id"]).collect()} == {1: "hello</w>", 2: None}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.digests(docs, PATH).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert bpe.digests(docs, PATH).count() == 0


def test_random_texts_and_characters():
    lib, encode, draw = library(), bpe.load(PATH).encoder(), random.Random(7)
    texts = ["".join(draw.choice("abcdehinorst s'") for _ in range(300)) for _ in range(300)]
    # Every 13th character of the first planes, between letters, digits and signs.
    texts += ["".join(f"a{chr(c)}1{chr(c)}- " for c in range(b, b + 832, 13) if not 0xD800 <= c < 0xE000) for b in range(0, 0x20000, 832)]
    for text, row in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text) == row.ids


def merged(word, merges):
    """Merge by merge, each from left to right, as the definition says."""
    tokens = list(word)
    for u, v in merges:
        i = 0
        while i < len(tokens) - 1:
            if (tokens[i], tokens[i + 1]) == (u, v):
                tokens[i : i + 2] = [u + v]
            i += 1
    return tokens


@pytest.mark.parametrize("seed", range(12))
def test_automaton_follows_any_merges(seed):
    """Drawn merges, also ones that can never apply and tokens beside themselves, on all words up to eight letters."""
    draw = random.Random(seed)
    known, merges = ["a", "b"], []
    while len(merges) < 9:
        u, v = draw.choice(known), draw.choice(known)
        if u + v not in known:
            merges.append((u, v))
            known.append(u + v)
    vocab = {letter: i for i, letter in enumerate(bpe.byte_letters())}
    vocab |= {t: len(vocab) + i for i, t in enumerate(known[2:])}
    model = {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]}
    automaton = bpe.compiled(bpe.read_merges(model), len(vocab), False)
    names = {i: t for t, i in vocab.items()}
    for size in range(1, 9):
        for letters in itertools.product("ab", repeat=size):
            word = "".join(letters)
            assert [names[t] for t in automaton.word(word.encode())] == merged(word, merges), (merges, word)


def test_refuses_what_it_is_not_for(tmp_path):
    model = {"type": "BPE", "vocab": {}, "merges": []}
    with pytest.raises(ValueError, match="lacks byte"):
        bpe.read_merges(model)
    file = json.loads(open(PATH, encoding="utf-8").read())
    file["normalizer"]["normalizers"].append({"type": "NFKC"})
    path = tmp_path / "other.json"
    path.write_text(json.dumps(file), encoding="utf-8")
    with pytest.raises(ValueError, match="not supported"):
        bpe.load(str(path))
