"""Learn subword merges from word counts.

Merges must be learned one after the other, but a Spark job for each would be thousands of jobs. So the driver proposes many at
once, from the exact counts of the most frequent pairs and from what each merge changes in a bounded sample of the words; one
job then applies them to all words, in order, and tells what each changed. The driver replays these exact changes and takes the
proposals for as long as each was the best pair of all words at its turn; from the first that was not, it proposes anew. Wrong proposals cost time only: the merges are those that the textbook learns one at a time.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from corpusloom.sources.stage import staged

#: The most frequent pairs whose counts the driver holds after counting them all, and the heaviest words that it proposes from
#: (with about as many drawn ones).
KNOWN = 20_000
SAMPLE = 20_000
#: Merges proposed at once: at least, at most.
LEAST, MOST = 96, 1_024
#: Merges that a job may apply again before the words are written with them.
STAGE_EVERY = 512
#: Bytes of words that a task works on at once, four to a symbol.
BLOCK_BYTES = 16 << 20
#: Numbers below are code points.
LETTERS = 0x110000

MERGES = StructType(
    [
        StructField("rank", IntegerType(), False),
        StructField("left", StringType(), False),
        StructField("right", StringType(), False),
        StructField("n", LongType(), False),
    ]
)

Pair = tuple[str, str]


def joined(pieces: Sequence[str], left: str, right: str) -> list[str]:
    """The pieces with the pair merged, from left to right."""
    out, at, last = [], 0, len(pieces) - 1
    while at <= last:
        if at < last and pieces[at] == left and pieces[at + 1] == right:
            out.append(left + right)
            at += 2
        else:
            out.append(pieces[at])
            at += 1
    return out


def changed(before: Sequence[str], after: Sequence[str]) -> Counter:
    """What a merge adds to the pairs of a word, and takes."""
    delta = Counter(zip(after, after[1:], strict=False))
    delta.subtract(zip(before, before[1:], strict=False))
    return delta


def _number(symbol: str, numbers: dict[str, int]) -> int:
    """A letter is its code point; what merges make is numbered from LETTERS on."""
    return ord(symbol) if len(symbol) == 1 else numbers[symbol]


def _numbered(merges: Sequence[tuple], names: Sequence[str]) -> list[tuple[int, int, int]]:
    """Merges as numbers: left, right, and what they make; ``names`` are all symbols made, in the order of their numbers."""
    numbers = {name: LETTERS + i for i, name in enumerate(names)}
    return [(_number(m[0], numbers), _number(m[1], numbers), numbers[m[0] + m[1]]) for m in merges]


def _texts(numbers: np.ndarray, names: Sequence[str]) -> pa.Array:
    """The symbols that numbers stand for."""
    distinct, places = np.unique(numbers, return_inverse=True)
    listed = [chr(i) if i < LETTERS else names[i - LETTERS] for i in distinct.tolist()]
    return pa.array(listed, pa.string()).take(pa.array(places))


class _Words:
    """A block of words as numbers of symbols, chained by place, with the places of the pairs to merge: a merge costs what it
    occurs, whatever the number of words and of merges."""

    def __init__(self, weights: np.ndarray, ends: np.ndarray, symbol: np.ndarray, merges: list[tuple[int, int, int]]):
        lengths = np.diff(ends, prepend=0)
        self.symbol, self.weights, self.words = symbol, weights, len(lengths)
        self.word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        place = np.arange(len(symbol), dtype=np.int32)
        self.after, self.before = place + 1, place - 1
        self.after[ends[lengths > 0] - 1] = -1
        self.before[(ends - lengths)[lengths > 0]] = -1
        # A small table tells the pairs to merge from their left and right symbols.
        pairs = dict.fromkeys((left, right) for left, right, _ in merges)
        self.pair_of = {pair: i for i, pair in enumerate(pairs)}
        self.lefts, self.rights = np.zeros((2, max((m[2] for m in merges), default=LETTERS) + 1), np.int32)
        for side, symbols in ((self.lefts, {x for x, _ in pairs}), (self.rights, {x for _, x in pairs})):
            side[sorted(symbols)] = 1 + np.arange(len(symbols))
        self.table = np.full((self.lefts.max() + 1, self.rights.max() + 1), -1, np.int32)
        for (left, right), i in self.pair_of.items():
            self.table[self.lefts[left], self.rights[right]] = i
        self.places: list[list[np.ndarray]] = [[] for _ in pairs]
        if pairs:
            self._find(place[self.after >= 0])

    def _find(self, at: np.ndarray) -> None:
        """Note the pairs to merge that begin at these places."""
        pair = self.table[self.lefts[self.symbol[at]], self.rights[self.symbol[self.after[at]]]]
        at, pair = at[pair >= 0], pair[pair >= 0]
        order = np.argsort(pair, kind="stable")
        at, pair = at[order], pair[order]
        edges = np.flatnonzero(np.diff(pair, prepend=-1))
        for i, some in zip(pair[edges].tolist(), np.split(at, edges[1:]) if len(edges) else (), strict=True):
            self.places[i].append(some)

    def merge(self, left: int, right: int, made: int, tell: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """Merge a pair in all words, from left to right; with ``tell`` the pairs added and taken, and their weights."""
        noted = self.places[self.pair_of[left, right]]
        if not noted:
            return None
        at = _distinct(np.concatenate(noted))
        noted.clear()
        at = at[(self.symbol[at] == left) & (self.after[at] >= 0)]
        at = at[self.symbol[self.after[at]] == right]
        if left == right and len(at):
            # Of a run of equal symbols every second place.
            run = np.flatnonzero(np.append(True, self.after[at[:-1]] != at[1:]))
            first = np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        if not len(at):
            return None
        gone = self.after[at]
        beyond, earlier = self.after[gone], self.before[at]
        if tell:
            taken = self._pairs(_distinct(np.concatenate([earlier[earlier >= 0], at, gone[beyond >= 0]])), -1)
        self.symbol[at], self.symbol[gone] = made, -1
        self.after[at] = beyond
        self.before[beyond[beyond >= 0]] = at[beyond >= 0]
        earlier = self.before[at]
        new = _distinct(np.concatenate([earlier[earlier >= 0], at[beyond >= 0]]))
        self._find(new)
        if tell:
            added = self._pairs(new, 1)
            return np.concatenate([taken[0], added[0]]), np.concatenate([taken[1], added[1]])

    def _pairs(self, at: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray]:
        return self.symbol[at].astype(np.int64) << 32 | self.symbol[self.after[at]], sign * self.weights[self.word[at]]

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(*self._pairs(np.flatnonzero(self.after >= 0), 1))

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the words end, and their symbols."""
        held = np.flatnonzero(self.symbol >= 0)
        return np.cumsum(np.bincount(self.word[held], minlength=self.words)), self.symbol[held]


def _distinct(places: np.ndarray) -> np.ndarray:
    places = np.sort(places)
    return places[np.flatnonzero(np.diff(places, prepend=-1))]


def _summed(pairs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs with the sums of their weights."""
    order = np.argsort(pairs, kind="stable")
    pairs, weights = pairs[order], weights[order]
    edges = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[edges], np.add.reduceat(weights, edges) if len(edges) else weights


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words ``(n, symbols)`` of a task in blocks of bounded size: weights, ends and symbols."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part.nbytes
        if size > BLOCK_BYTES:
            yield _block(held)
            held, size = [], 0
    if held:
        yield _block(held)


def _block(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cells = pa.concat_arrays([part.column(1) for part in parts])
    ends = np.cumsum(pc.binary_length(cells).to_numpy() // 4, dtype=np.int64)
    symbols = np.frombuffer(b"".join(cells.to_pylist()), np.int32).copy()
    return pa.concat_arrays([part.column(0) for part in parts]).to_numpy(), ends, symbols


def _in_numbers(counts: DataFrame) -> DataFrame:
    """``(n, symbols)`` of words: four bytes a symbol, a letter being its code point."""

    def per_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cells = [word.encode("utf-32-le") for word in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells, pa.binary())], names=["n", "symbols"])

    return counts.select(F.col("n").cast("bigint").alias("n"), "word").mapInArrow(per_task, "n bigint, symbols binary")


def applied(spelled: DataFrame, merges: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """The words ``(n, symbols)`` with merges applied, each in its turn.

    A merge has its turn once. What it makes may be a pair of an earlier turn, if a symbol can come about in two ways; that pair
    stays.
    """
    turns = _numbered(merges, names)

    def per_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for weights, ends, symbols in _blocks(parts):
            words = _Words(weights, ends, symbols, turns)
            for turn in turns:
                words.merge(*turn)
            ends, symbols = words.held()
            starts, whole = (4 * np.append(0, ends)).tolist(), symbols.astype(np.int32).tobytes()
            cells = [whole[i:j] for i, j in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(weights), pa.array(cells, pa.binary())], names=["n", "symbols"])

    return spelled.mapInArrow(per_task, "n bigint, symbols binary")


def in_pieces(spelled: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(n, pieces)`` of ``(n, symbols)``."""

    def per_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for weights, ends, symbols in _blocks(parts):
            pieces = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), _texts(symbols, names))
            yield pa.RecordBatch.from_arrays([pa.array(weights), pieces], names=["n", "pieces"])

    return spelled.mapInArrow(per_task, "n bigint, pieces array<string>")


def pair_counts(spelled: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adjacent symbol pairs ``(left, right, n)`` of ``(n, symbols)``, weighted by word count, combined before the shuffle."""

    def per_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(parts):
            pairs, n = _Words(*block, []).all_pairs()
            arrays = [_texts(pairs >> 32, names), _texts(pairs & 0xFFFFFFFF, names), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["left", "right", "n"])

    found = spelled.mapInArrow(per_task, "left string, right string, n bigint")
    return found.groupBy("left", "right").agg(F.sum("n").alias("n"))


def changes(
    spelled: DataFrame, done: Sequence[tuple], batch: Sequence[Pair], known: set[Pair], names: Sequence[str]
) -> list[dict[Pair, int]]:
    """What each merge of the batch changes in the pair counts of all words, after the merges ``done``.

    Only pairs with a symbol that the batch makes and ``known`` pairs are told. Per block the changes are summed first.
    """
    names = list(dict.fromkeys([*names, *(left + right for left, right in batch)]))
    earlier, turns = _numbered(done, names), _numbered(batch, names)
    numbers = {name: LETTERS + i for i, name in enumerate(names)}
    made = np.zeros(LETTERS + len(names), bool)
    made[[made_now for _, _, made_now in turns]] = True
    listed = np.sort(np.array([_number(left, numbers) << 32 | _number(right, numbers) for left, right in known], np.int64))

    def told(weights: np.ndarray, ends: np.ndarray, symbols: np.ndarray) -> pa.RecordBatch:
        words = _Words(weights, ends, symbols, [*earlier, *turns])
        for turn in earlier:
            words.merge(*turn)
        sums = [(np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))]
        for step, turn in enumerate(turns):
            found = words.merge(*turn, tell=True)
            if found is not None:
                pairs, d = _summed(*found)
                sums.append((np.full(len(d), step, np.int32), pairs, d))
        steps, pairs, d = map(np.concatenate, zip(*sums, strict=True))
        left, right = pairs >> 32, pairs & 0xFFFFFFFF
        kept = np.flatnonzero((d != 0) & (made[left] | made[right] | np.isin(pairs, listed)))
        arrays = [pa.array(steps[kept]), _texts(left[kept], names), _texts(right[kept], names), pa.array(d[kept])]
        return pa.RecordBatch.from_arrays(arrays, names=["step", "left", "right", "d"])

    def per_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(parts):
            yield told(*block)

    rows = spelled.mapInArrow(per_task, "step int, left string, right string, d bigint")
    # As many rows as pairs stand beside what the batch makes: bounded by its length and the symbols there are.
    table = rows.groupBy("step", "left", "right").agg(F.sum("d").alias("d")).where("d <> 0").toArrow()
    found: list[dict[Pair, int]] = [{} for _ in batch]
    for step, left, right, d in zip(*(table.column(c).to_pylist() for c in ("step", "left", "right", "d")), strict=True):
        found[step][left, right] = d
    return found


class _Best:
    """Pair counts with the greatest at hand; ties go by ``left``, then ``right``."""

    def __init__(self, counts: dict[Pair, float]):
        self.counts = dict(counts)
        self.heap = [(-n, pair) for pair, n in counts.items()]
        heapq.heapify(self.heap)

    def top(self) -> tuple[Pair, float] | None:
        while self.heap:
            n, pair = self.heap[0]
            if self.counts.get(pair) == -n:
                return pair, -n
            heapq.heappop(self.heap)
        return None

    def put(self, pair: Pair, n: float) -> None:
        if n > 0:
            self.counts[pair] = n
            heapq.heappush(self.heap, (-n, pair))
        else:
            self.counts.pop(pair, None)


class _Sample:
    """Words, as the merges so far spell them, and where each pair was last seen (or more places)."""

    def __init__(self, words: list[tuple[int, list[str]]]):
        self.weights = [n for n, _ in words]
        self.words = [pieces for _, pieces in words]
        self.places: dict[Pair, list[int]] = defaultdict(list)
        for at, pieces in enumerate(self.words):
            for pair in set(zip(pieces, pieces[1:], strict=False)):
                self.places[pair].append(at)

    def merge(self, pair: Pair, words: dict[int, list[str]], places: dict[Pair, list[int]]) -> tuple[Counter, int]:
        """Merge a pair in the words, on top of ``words`` and ``places``: the change of all pairs, and the pair's own count."""
        delta: Counter = Counter()
        total = 0
        for at in dict.fromkeys([*self.places.get(pair, ()), *places.get(pair, ())]):
            before = words.get(at) or self.words[at]
            after = joined(before, *pair)
            if len(after) == len(before):
                continue
            words[at] = after
            for p, d in changed(before, after).items():
                if d:
                    delta[p] += d * self.weights[at]
                    if d > 0:
                        places[p].append(at)
            total += self.weights[at] * (len(before) - len(after))
        return delta, total

    def take(self, pair: Pair) -> None:
        words: dict[int, list[str]] = {}
        places: dict[Pair, list[int]] = defaultdict(list)
        self.merge(pair, words, places)
        for at, pieces in words.items():
            self.words[at] = pieces
        for p, at in places.items():
            self.places[p] += at

    def proposed(self, counts: dict[Pair, int], most: int, floor: int, told: dict[Pair, dict[Pair, int]]) -> list[Pair]:
        """The merges that would follow if all words changed as the sample does, in proportion to each pair's count.

        What a merge changed in all words when it was last proposed is ``told``, and a better guess.
        """
        best, batch, words = _Best(counts), [], {}
        places: dict[Pair, list[int]] = defaultdict(list)
        while len(batch) < most:
            top = best.top()
            if top is None or (top[1] <= floor and batch) or top[0] in batch[-MOST:]:
                break
            pair, n = top
            batch.append(pair)
            delta, own = self.merge(pair, words, places)
            share = n / own if own else 0.0
            if pair in told:
                delta, share = told[pair], 1.0
            for p, d in delta.items():
                if p != pair and (p in best.counts or d > 0):
                    best.put(p, best.counts.get(p, 0) + d * share)
            best.put(pair, 0)
        return batch


def _drawn(words: DataFrame, sample: int) -> list[tuple[int, str]]:
    """The heaviest words, and of the others about as many drawn by a hash, which stand for all of those."""
    weight = F.col("n") * F.length("word")
    heaviest = words.orderBy(F.desc(weight), "word").limit(sample).collect()
    rest = words.count() - len(heaviest)
    step = max(1, rest // sample)
    drawn = words.where(F.pmod(F.xxhash64("word", F.lit(1)), F.lit(step)) == 0).limit(2 * sample).collect() if rest else []
    known = {r.word for r in heaviest}
    return [(r.n, r.word) for r in heaviest] + [(r.n * step, r.word) for r in drawn if r.word not in known]


def learn_merges(
    counts: DataFrame,
    n_merges: int,
    min_count: int = 1,
    stage_every: int = STAGE_EVERY,
    at_once: int = MOST,
    known: int = KNOWN,
    sample: int = SAMPLE,
) -> tuple[list[tuple[str, str, int]], DataFrame]:
    """The first ``n_merges`` byte-pair merges ``(left, right, n)`` over ``(word, n)``, and the words ``(n, pieces)`` after them.

    The result is that of learning one merge at a time, the most frequent pair first (ties go by ``left``, then ``right``).

    A pair comes about when the later of its symbols does, and only loses from then on. So of the pairs that were not among the
    ``known`` most frequent when all were counted, and of new ones that came about with no more than the last of those, none can
    rise above it: as long as the best known pair is above, it is the best of all. When it no longer is, or when a symbol comes
    about in a second way, all pairs are counted again. A job reads each distinct word once for up to ``at_once`` merges.
    """
    # Without a number of partitions they follow the size of the words.
    listed = staged(counts.where("word IS NOT NULL").select("n", "word").repartition(F.xxhash64("word")), "words")
    spelled = staged(_in_numbers(listed), "spellings")
    words = _Sample([(n, list(word)) for n, word in _drawn(listed, sample)])
    merges: list[tuple[str, str, int]] = []
    pending: list[tuple[str, str, int]] = []
    symbols: dict[str, None] = {}
    exact: _Best | None = None
    floor, size = 0, LEAST
    told: dict[Pair, dict[Pair, int]] = {}
    while len(merges) < n_merges:
        fresh = exact is None
        if fresh:
            if pending:
                spelled, pending = staged(applied(spelled, pending, list(symbols)), "spellings"), []
            top = pair_counts(spelled, list(symbols)).orderBy(F.desc("n"), "left", "right").limit(known).collect()
            exact = _Best({(r.left, r.right): r.n for r in top})
            floor = top[-1].n if len(top) == known else 0
        batch = words.proposed(exact.counts, min(size, at_once, n_merges - len(merges)), floor, told)
        found = changes(spelled, pending, batch, set(exact.counts), list(symbols)) if batch else []
        taken, again = 0, False
        for pair, delta in zip(batch, found, strict=True):
            best = exact.top()
            # Right after counting, the first of all pairs is known, even if others are as frequent as the last one known.
            sure = best is not None and (best[1] > floor or (fresh and not taken))
            if not sure or best[0] != pair or best[1] < min_count:
                break
            merges.append((*pair, best[1]))
            words.take(pair)
            taken += 1
            for p, d in delta.items():
                if p in exact.counts or d > floor:
                    exact.put(p, exact.counts.get(p, 0) + d)
            again = "".join(pair) in symbols
            symbols["".join(pair)] = None
            if again:
                break
        pending += merges[len(merges) - taken :]
        told |= dict(zip(batch[taken:], found[taken:], strict=True))
        if fresh and not taken:
            break
        best = exact.top()
        if again or not taken or best is None or best[1] <= floor:
            exact = None
        elif len(pending) >= stage_every:
            spelled, pending = staged(applied(spelled, pending, list(symbols)), "spellings"), []
        told = {pair: delta for pair, delta in told.items() if pair in batch}
        size = max(LEAST, 2 * taken)
    return merges, in_pieces(applied(spelled, pending, list(symbols)) if pending else spelled, list(symbols))


def merge_table(spark: SparkSession, merges: list[tuple[str, str, int]]) -> DataFrame:
    rows = [(rank, left, right, n) for rank, (left, right, n) in enumerate(merges)]
    return spark.createDataFrame(rows, MERGES)


def learned_tokens(counts: DataFrame, merges: list[tuple[str, str, int]], first_id: int = 4) -> DataFrame:
    """The learned vocabulary ``(token, idx)``: the alphabet in text order, then one token per merge."""
    letters = counts.select(F.explode(F.split(F.col("word"), "")).alias("token")).where("token <> ''").distinct()
    # An alphabet is a set of characters: small whatever the corpus is.
    alphabet = sorted(row["token"] for row in letters.collect())
    made = [left + right for left, right, _ in merges]
    tokens = list(dict.fromkeys([*alphabet, *made]))
    rows = [(token, first_id + i) for i, token in enumerate(tokens)]
    return counts.sparkSession.createDataFrame(rows, "token string, idx int")
