"""Byte-pair encoding by a tokenization automaton.

The automaton reads tokens, not characters: an arc is a token, and a path from the start is a sequence of tokens that the merges
could have left behind. It begins as one state with an arc for every byte. Each merge ``u v -> w``, in order, adds a gadget: the
state that ``u`` led to is copied without its arc ``v`` and becomes the new target of ``u``; every state with an arc ``u`` gets an
arc ``w`` to where ``u v`` led. All arcs of one token lead to one state throughout, so a merge adds one state at most, and the
automaton is deterministic.

A state differs from the one it was copied from by the arc ``v`` and by the arcs of later tokens that begin with that ``v``. With
tokens numbered along the tree of their left parts, newest first, these are one interval. The transition table holds, per state,
the intervals of tokens that it has no arc for.

Exactly one path spells a word, and one each of its beginnings. So a word is encoded left to right: from each place, whose
state is known, the tokens that are spelled next are looked up in the table; the one that may follow fixes the state at its end.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

#: Words whose tokens a task remembers; beyond that it starts anew.
REMEMBERED = 300_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte: itself if it is a visible Latin-1 character, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


@dataclass
class Merges:
    """A vocabulary as arcs: of every token that merges make its two parts, its bytes, and whether it ends a word."""

    spelled: dict[int, bytes]
    ends: dict[int, bool]
    parts: list[tuple[int, int, int]]


def read_merges(model: dict) -> Merges:
    """The bytes of every token. Raises on vocabularies that the automaton is not for: unknown symbols, two merges for a token."""
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    if model["type"] != "BPE" or any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "byte_fallback", "dropout", "ignore_merges")):
        raise ValueError("only plain merges of bytes are supported")
    spelled, ends = {}, {}
    for letter, byte in byte_letters().items():
        for end in (False, True) if suffix else (False,):
            token = vocab.get(letter + (suffix if end else ""))
            if token is None:
                raise ValueError(f"the vocabulary lacks byte {byte}")
            spelled[token], ends[token] = bytes([byte]), end
    parts = []
    for merge in model["merges"]:
        u, v = merge.split(" ") if isinstance(merge, str) else merge
        left, right, token = vocab[u], vocab[v], vocab[u + v]
        if token in spelled or left not in spelled or right not in spelled:
            raise ValueError(f"token {u + v!r} is made twice, or before its parts")
        spelled[token], ends[token] = spelled[left] + spelled[right], ends[right]
        parts.append((left, right, token))
    return Merges(spelled, ends, parts)


@dataclass
class Automaton:
    """The transition table and the tree of spellings.

    ``next_node[node << 8 | byte]`` walks the spellings; ``inner`` and ``final`` name the token that a node spells inside and at the
    end of a word (-1: none). ``place`` is a token's number in the intervals, ``target`` the state that it leads to. The
    intervals of state s are ``low[first[s]:first[s + 1]]`` and ``high``, ascending and apart.
    """

    next_node: dict[int, int]
    inner: list[int]
    final: list[int]
    place: list[int]
    target: list[int]
    first: list[int]
    low: list[int]
    high: list[int]

    def word(self, word: bytes) -> list[int]:
        """The tokens of a word, by the only path that spells it."""
        n = len(word)
        state, origin, label = [0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        step, place, target, low, high, first = self.next_node.get, self.place, self.target, self.low, self.high, self.first
        open_ends = [0] if n else []
        while open_ends:
            # The longest token so far is followed first; no place is reached twice, as each beginning has one path.
            i = open_ends.pop()
            node, here = 0, state[i]
            begin, end = first[here], first[here + 1]
            for j in range(i, n):
                node = step(node << 8 | word[j], -1)
                if node < 0:
                    break
                token = self.inner[node] if j < n - 1 else self.final[node]
                if token < 0:
                    continue
                at = place[token]
                k = bisect_right(low, at, begin, end) - 1
                if k < begin or at >= high[k]:
                    state[j + 1], origin[j + 1], label[j + 1] = target[token], i, token
                    open_ends.append(j + 1)
            if label[n] >= 0:
                break
        tokens = []
        while n:
            tokens.append(label[n])
            n = origin[n]
        return tokens[::-1]


def compiled(merges: Merges, size: int, suffixed: bool) -> Automaton:
    """The automaton of the merges, one gadget after the other. ``size`` is above every token."""
    #: The state that a token leads to, by tokens; the state that each state was copied from and the arc that the copy lost.
    target = dict.fromkeys(merges.spelled, 0)
    copied, lost = [0], [(-1, -1)]
    rank = {(u, v): m for m, (u, v, _) in enumerate(merges.parts)}
    made, left, right = {}, {}, {}
    never = len(merges.parts)

    def follows(u: int, v: int, now: int) -> bool:
        """Whether the state of ``u`` has an arc ``v`` before merge ``now``: no earlier gadget took it, or what it began with."""
        until_u = now
        while u >= 0:
            w, until_w = v, now
            while w >= 0:
                m = rank.get((u, w), never)
                if m < until_u and m <= until_w and m < now:
                    return False
                until_w, w = made.get(w, -1), left.get(w, -1)
            until_u, u = made.get(u, -1), right.get(u, -1)
        return True

    dead = set()
    children = defaultdict(list)
    for m, (u, v, w) in enumerate(merges.parts):
        if u in dead or v in dead or merges.ends[u] or not follows(u, v, m):
            dead.add(w)
            continue
        before = target[u]
        copied.append(before)
        lost.append((v, m))
        target[w] = before if u == v else target[v]
        target[u] = len(copied) - 1
        made[w], left[w], right[w] = m, u, v
        children[u].append(w)

    place, end = [0] * size, [0] * size
    at, todo = 0, [(t, False) for t in merges.spelled if t not in made and t not in dead]
    while todo:
        token, done = todo.pop()
        if done:
            end[token] = at
            continue
        place[token] = at
        at += 1
        todo.append((token, True))
        todo += [(c, False) for c in children[token]]

    def taken(state: int) -> list[tuple[int, int]]:
        spans = []
        while state:
            v, m = lost[state]
            # Newest first: the children of v that were made from merge m on come right behind it.
            late = bisect_left(children[v], m, key=made.__getitem__)
            spans.append((place[v], end[children[v][late]] if late < len(children[v]) else place[v] + 1))
            state = copied[state]
        spans.sort()
        apart: list[tuple[int, int]] = []
        for low, high in spans:
            if apart and low <= apart[-1][1]:
                apart[-1] = (apart[-1][0], max(high, apart[-1][1]))
            else:
                apart.append((low, high))
        return apart

    alive = [t for t in merges.spelled if t not in dead]
    states = sorted({0} | {target[t] for t in alive})
    number = {s: i for i, s in enumerate(states)}
    spans = [taken(s) for s in states]
    ends_at = np.cumsum([0] + [len(s) for s in spans]).tolist()

    next_node, inner, final = {}, [-1], [-1]
    for token in alive:
        node = 0
        for byte in merges.spelled[token]:
            node = next_node.setdefault(node << 8 | byte, len(inner))
            if node == len(inner):
                inner.append(-1)
                final.append(-1)
        if merges.ends[token] or not suffixed:
            final[node] = token
        if not merges.ends[token]:
            inner[node] = token
    goes = [0] * size
    for token in alive:
        goes[token] = number[target[token]]
    flat = [s for row in spans for s in row]
    return Automaton(next_node, inner, final, place, goes, ends_at, [a for a, _ in flat], [b for _, b in flat])


@dataclass
class Tokenizer:
    """What a tokenizer file declares: the automaton, the labels of its arcs, the strings cut out first, and the words of a text."""

    automaton: Automaton
    labels: dict[int, str]
    whole: dict[str, int]
    steps: list[tuple[str, str, str]]
    split: str

    def encoder(self) -> Callable[[str | None], list[int]]:
        """A function from a text to its tokens; a null text has none."""
        words = splitter(self.steps, self.split)
        cut = re.compile("(" + "|".join(map(re.escape, sorted(self.whole, key=len, reverse=True))) + ")") if self.whole else None
        known: dict[str, list[int]] = {}

        def encode(text: str | None) -> list[int]:
            ids: list[int] = []
            for piece in cut.split(text or "") if cut else [text or ""]:
                if piece in self.whole:
                    ids.append(self.whole[piece])
                    continue
                for word in words(piece):
                    tokens = known.get(word)
                    if tokens is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        tokens = self.automaton.word(word.encode())
                        if len(word) < 64:
                            known[word] = tokens
                    ids += tokens
            return ids

        return encode

    def decoded(self, ids: np.ndarray) -> str:
        """The labels of the arcs, a blank between; ids that name no arc are left out."""
        labels = self.labels
        return " ".join([labels[i] for i in ids.tolist() if i in labels])


#: White space as regular expressions of the library know it.
BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def splitter(steps: list[tuple[str, str, str]], split: str) -> Callable[[str], list[str]]:
    """A function from a text to its normalised words.

    Python's tables of characters may be older than the library's. Texts with characters that they do not know yet are split by
    the library's own steps; words become tokens by the automaton all the same.
    """
    narrow = split.replace(r"\s", "\\t-\\r ").replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
    plain_words, words = re.compile(narrow).findall, regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
    assigned: set[str] = set()
    # Runs of blanks other than one space alone: what replacing runs by a space changes.
    others = BLANKS.replace(" ", "")
    runs = re.compile(f"(?:[{others}]| [{BLANKS}])[{BLANKS}]*")

    def own(text: str) -> str:
        for kind, _, _ in steps:
            if kind == "NFC" and not text.isascii():
                text = unicodedata.normalize("NFC", text)
            elif kind == "Replace":
                text = runs.sub(" ", text)
            elif kind == "Lowercase":
                # Lower each character on its own: a sigma does not look at what follows it.
                text = text.replace("\u03a3", "\u03c3").lower()
        return text

    @cache
    def library_steps() -> tuple:
        from tokenizers import Regex, normalizers, pre_tokenizers

        made = [
            normalizers.Replace(Regex(pattern), content) if kind == "Replace" else getattr(normalizers, kind)()
            for kind, pattern, content in steps
        ]
        return normalizers.Sequence(made), pre_tokenizers.Split(Regex(split), "removed", invert=True)

    def library(text: str) -> list[str]:
        normal, pieces = library_steps()
        return [w for w, _ in pieces.pre_tokenize_str(normal.normalize_str(text))]

    def known(text: str) -> bool:
        new = set(text) - assigned
        assigned.update(c for c in new if unicodedata.category(c) != "Cn")
        return new <= assigned

    def found(text: str) -> list[str]:
        if text.isascii():
            return plain_words(own(text))
        return words(own(text)) if known(text) else library(text)

    return found


@cache
def load(path: str) -> Tokenizer:
    """Read a tokenizer file and compile its merges. The file is read on the driver only; its tables are bounded by the vocabulary."""
    file = json.loads(Path(path).read_text(encoding="utf-8"))
    model, pre = file["model"], file["pre_tokenizer"]["pretokenizers"]
    normal = file["normalizer"]["normalizers"] if file.get("normalizer") else []
    steps = [(s["type"], s.get("pattern", {}).get("Regex", ""), s.get("content", "")) for s in normal]
    plain = [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
    unknown = [s[0] for s in steps if s[0] not in ("NFC", "Replace", "Lowercase")]
    added = file["added_tokens"]
    odd = [t for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if unknown or odd or not plain or pre[1]["add_prefix_space"] or pre[1]["use_regex"] or file.get("decoder"):
        raise ValueError(f"{path}: steps that are not supported")
    labels = {i: token for token, i in model["vocab"].items()} | {t["id"]: t["content"] for t in added}
    automaton = compiled(read_merges(model), max(labels) + 1, bool(model.get("end_of_word_suffix")))
    split = pre[0]["pattern"]["Regex"]
    if "\\" in re.sub(r"\[[^\]]*\]", "", split) or any(s[0] == "Replace" and s[1:] != (r"\s+", " ") for s in steps):
        raise ValueError(f"{path}: patterns that are not supported")
    return Tokenizer(automaton, labels, {t["content"]: t["id"] for t in added}, steps, split)


def encoded(docs: DataFrame, path: str, keep: list[str], text: str = "text", packed: bool = False) -> DataFrame:
    """The columns ``keep`` and ``ids``, the tokens of each whole text.

    ``ids`` is an array of integers, or with ``packed`` the bytes of unsigned 32-bit little-endian ones, as token files hold them.
    Null and empty texts have no tokens. Very long texts and words take time in proportion to their length. Rows that repeat stay
    repeated, an empty table gives none; columns other than ``keep`` and ``text`` are not read, whatever their names. There are no
    ties: a text has one encoding.
    """
    tokenizer = load(path)

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer.encoder()
        for part in parts:
            rows = (encode(t.as_py()) for t in part.column(len(keep)))
            if packed:
                ids = pa.array([np.array(r, "<u4").tobytes() for r in rows], pa.binary())
            else:
                ids = pa.array([np.array(r, np.int32) for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], ids], names=[*keep, "ids"])

    kept = docs.select(*keep, F.col(text).alias("_"))
    shape = [*kept.schema.fields[: len(keep)], StructField("ids", BinaryType() if packed else ArrayType(IntegerType()))]
    return kept.mapInArrow(per_batch, StructType(shape))


def decoded(rows: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``decoded``, the text that the tokens in ``ids`` (packed or an array) stand for.

    Null ids give a null text, no ids an empty one; ids that the file does not name are left out.
    """
    labels = load(path).labels

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Tokenizer(None, labels, {}, [], "")
        for part in parts:
            texts = []
            for cell in part.column(len(keep)):
                raw = cell.as_py()
                values = np.frombuffer(raw, "<u4") if isinstance(raw, bytes) else raw and np.array([i for i in raw if i is not None], np.int64)
                texts.append(None if raw is None else reader.decoded(np.asarray(values, np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    kept = rows.select(*keep, F.col(ids).alias("_"))
    return kept.mapInArrow(per_batch, StructType([*kept.schema.fields[: len(keep)], StructField("decoded", StringType())]))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256``: what was encoded, and what decoding it gives back."""
    rows = decoded(encoded(docs, path, [key], text, packed=True).withColumn("packed", F.col("ids")), path, [key, "packed"])
    return rows.select(
        key,
        (F.octet_length("packed") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
