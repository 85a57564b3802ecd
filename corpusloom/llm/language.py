"""Language identification in two steps: the family first, then one-versus-one linear machines inside the family.

Texts become hashed counts of byte trigrams of letters. Families are told apart by one linear support vector machine each
(one against the rest), the languages of a family by one machine per pair, which vote.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import pieces, unused

DIMENSIONS = 4_096
#: Rows per language that the machines are fitted on, chosen by a hash of row and text.
SAMPLE = 800
CHUNK = 1 << 20
ROWS = 256
UNKNOWN = "und"
#: Share of labelled texts, held out from the fit in turn, whose margins may fall below the floors of the pipeline.
LOST = 0.005
#: Floors are set by length in bytes: short texts have smaller margins. A band of fewer texts takes the next longer ones too.
BANDS = (64, 256, 1024)
BAND_ROWS = 100
#: Two-letter language codes by family. A code that is not listed belongs to the family "other".
FAMILIES = {
    "germanic": "af da de en fy is lb nl nn no nb sv yi",
    "romance": "ca es fr gl it oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "celtic": "br cy ga gd",
    "baltic": "lt lv",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def features(text: str) -> np.ndarray:
    """Roots of the hashed trigram counts, at length one. The whole text is read, in chunks."""
    data = text.lower().encode("utf-8", "replace").translate(_LETTERS)
    counts = np.zeros(DIMENSIONS)
    for part in pieces(b" " + data + b" ", CHUNK, 2):
        b = np.frombuffer(part, np.uint8).astype(np.uint32)
        grams = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        grams = grams[(b[:-2] != 32) | (b[1:-1] != 32)]
        counts += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    root = np.sqrt(counts)
    return (root / max(1e-9, float(np.sqrt(counts.sum())))).astype(np.float32)


def machine(x: np.ndarray, positive: np.ndarray, cost: float = 4.0, passes: int = 12) -> np.ndarray:
    """Weights and bias (last) of a linear support vector machine, by dual coordinate descent; classes weigh the same."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    y = np.where(positive, 1.0, -1.0)
    most = np.where(positive, cost * len(x) / max(1, 2 * positive.sum()), cost * len(x) / max(1, 2 * (~positive).sum()))
    square, alpha, w = (x * x).sum(1), np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(0)
    for _ in range(passes):
        for i in rng.permutation(len(x)):
            step = min(max(alpha[i] + (1 - y[i] * (x[i] @ w)) / square[i], 0.0), most[i])
            w += (step - alpha[i]) * y[i] * x[i]
            alpha[i] = step
    return w.astype(np.float32)


def fitted(x: np.ndarray, langs: np.ndarray) -> list[tuple[str, str, bytes]]:
    """``kind, name, weights``: a ``family`` machine per family, a ``pair`` machine (``a b``) per two languages of one."""
    known = sorted(set(langs))
    family = np.array([FAMILY.get(c, "other") for c in langs])
    names = sorted(set(family))
    model = [("lang", code, b"") for code in known]
    model += [("family", n, machine(x, family == n).tobytes()) for n in names if len(names) > 1]
    for n in names:
        for a, b in itertools.combinations([c for c in known if FAMILY.get(c, "other") == n], 2):
            either = (langs == a) | (langs == b)
            model.append(("pair", f"{a} {b}", machine(x[either], langs[either] == a).tobytes()))
    return model


def floors(x: np.ndarray, langs: np.ndarray, lengths: np.ndarray, lost: float = LOST) -> list[tuple[str, str, bytes]]:
    """``floor, band, values``: the family and the pair margin that all but ``lost`` of the texts reach.

    Each half of the texts is judged by machines that learned from the other half, and by its own label.
    """
    margins = np.full((len(x), 2), np.nan)
    for own in (np.arange(len(x)) % 2 == k for k in (0, 1)):
        known = own & np.isin(langs, langs[~own])
        if known.any():
            margins[known] = Judge(fitted(x[~own], langs[~own])).margins(x[known], langs[known])
    seen = ~np.isnan(margins[:, 0])
    margins, bands, found = margins[seen], np.searchsorted(BANDS, lengths[seen], side="right"), []
    for band in range(len(BANDS) + 1):
        upto = next((k for k in range(band, len(BANDS)) if ((bands >= band) & (bands <= k)).sum() >= BAND_ROWS), len(BANDS))
        rows = margins[(bands >= band) & (bands <= upto)]
        rows = rows if len(rows) else margins
        reached = [c[np.isfinite(c)] for c in rows.T]  # a language alone in its family has no pair margin
        values = [max(0.0, np.quantile(c, lost, method="lower")) if len(c) else 0.0 for c in reached]
        found.append(("floor", str(band), np.array(values, np.float32).tobytes()))
    return found


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", sample: int = SAMPLE, lost: float | None = None) -> list[tuple[str, str, bytes]]:
    """The model, from rows for which ``learn`` holds and ``lang`` is not null.

    At most ``sample`` rows per language are read for the fit: a scan counts the languages, a hash of the row picks about
    as many as wanted, the smallest hashes of them stay. One task fits, and returns one vector per machine. With ``lost`` the
    model also has floors, which that share of labelled texts do not reach.
    """
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.lit(7), text).alias("h")
    )
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(v) for l, n in counts.items() for v in (l, int(min(1.0, 2 * sample / n) * (1 << 30)))])
    picked = rows.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("l")]).dropDuplicates(["l", "h"])

    def learn_all(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple[int, np.ndarray, int]]] = {}
        for part in parts:
            for l, t, h in zip(*[c.to_pylist() for c in part.columns], strict=True):
                kept.setdefault(l, []).append((h, features(t), len(t.encode("utf-8", "replace"))))
                if len(kept[l]) > 2 * sample:
                    kept[l] = sorted(kept[l], key=lambda r: r[0])[:sample]
        picks = [(l, *r[1:]) for l in sorted(kept) for r in sorted(kept[l], key=lambda r: r[0])[:sample]]
        if picks:
            x, langs = np.stack([r[1] for r in picks]), np.array([r[0] for r in picks])
            model = fitted(x, langs)
            if lost is not None:
                model += floors(x, langs, np.array([r[2] for r in picks]), lost)
            yield pa.RecordBatch.from_pydict(dict(zip(("kind", "name", "weights"), map(list, zip(*model)), strict=True)))

    model = picked.repartition(1).mapInArrow(learn_all, "kind string, name string, weights binary")
    return [tuple(r) for r in model.collect()]


def squashed(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))


class Judge:
    """Applies a model to a matrix of features."""

    def __init__(self, model: list[tuple[str, str, bytes]]):
        self.langs = [n for k, n, _ in model if k == "lang"]
        self.families = sorted({FAMILY.get(c, "other") for c in self.langs})
        weights = {(k, n): np.frombuffer(w, np.float32) for k, n, w in model if k in ("family", "pair")}
        self.floors = np.stack([np.zeros(2, np.float32)] * (len(BANDS) + 1))
        for n, w in ((n, w) for k, n, w in model if k == "floor"):
            self.floors[int(n)] = np.frombuffer(w, np.float32)
        self.family = np.stack([weights["family", f] for f in self.families]) if len(self.families) > 1 else None
        self.pairs = [(n.split(" "), w) for (k, n), w in sorted(weights.items()) if k == "pair"]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(x)
        if self.family is None:
            chosen, sure = np.zeros(rows, int), np.ones(rows)
        else:
            margins = x @ self.family[:, :-1].T + self.family[:, -1]
            chosen = margins.argmax(1)
            odds = squashed(margins)
            sure = odds.max(1) / odds.sum(1)
        votes, level = np.zeros((rows, len(self.langs))), np.zeros((rows, len(self.langs)))
        at = {c: i for i, c in enumerate(self.langs)}
        for (a, b), w in self.pairs:
            p = squashed(x @ w[:-1] + w[-1])
            for code, q in ((a, p), (b, 1 - p)):
                votes[:, at[code]] += q >= 0.5
                level[:, at[code]] += q
        mates = np.array([self.families.index(FAMILY.get(c, "other")) for c in self.langs])
        inside = mates[None, :] == chosen[:, None]
        pick = np.where(inside, votes + level / (1 + len(self.langs)), -1).argmax(1)
        others = np.bincount(mates, minlength=len(self.families))[chosen] - 1
        within = np.where(others > 0, level[np.arange(rows), pick] / np.maximum(1, others), 1.0)
        return np.array(self.langs)[pick], sure * within

    def margins(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How clearly each text belongs to the family of its code, and to the code rather than to the closest other language of
        the family; infinite where there is nothing else. Unlike the score neither depends on how many others there are."""
        out = np.full((len(x), 2), np.inf)
        if self.family is not None:
            at = np.array([self.families.index(FAMILY.get(c, "other")) for c in codes], int)
            out[:, 0] = (x @ self.family[:, :-1].T + self.family[:, -1])[np.arange(len(x)), at]
        for (a, b), w in self.pairs:
            m = x @ w[:-1] + w[-1]
            for code, side in ((a, m), (b, -m)):
                own = codes == code
                out[own, 1] = np.minimum(out[own, 1], side[own])
        return out

    def above(self, x: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """By how much the smaller of the two margins exceeds its floor."""
        return (self.margins(x, codes) - self.floors[np.searchsorted(BANDS, lengths, side="right")]).min(1)


def predicted(docs: DataFrame, model: list[tuple[str, str, bytes]], text: str = "text", pred: str = "lang_pred", score: str = "score", above: str | None = None) -> DataFrame:
    """The rows with their predicted language, its score and, if ``above`` is named, how far the margins are above the floors.

    ``und`` with score 0 where the text is null or has no letter, or the model is empty. Empty and repeated rows are
    scored as they are. Columns of ``docs`` with the names of the new ones are replaced; rows never move.
    """
    added = [pred, score, *([above] if above else [])]
    rows = docs.drop(*added)
    schema = rows.select("*", F.lit("").alias(pred), *[F.lit(0.0).alias(c) for c in added[1:]]).schema
    names, place = rows.columns, rows.columns.index(text)
    judge = Judge(model) if model else None

    def per_batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for start in range(0, whole.num_rows, ROWS):
                part = whole.slice(start, ROWS)
                texts = part.column(place).to_pylist()
                lettered = [i for i, t in enumerate(texts) if judge and t is not None and any(map(str.isalpha, t))]
                codes, scores, over = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts)), np.full(len(texts), -np.inf)
                if lettered:
                    x = np.stack([features(texts[i]) for i in lettered])
                    codes[lettered], scores[lettered] = judge(x)
                    if above:
                        over[lettered] = judge.above(x, codes[lettered], np.array([len(texts[i].encode("utf-8", "replace")) for i in lettered]))
                columns = [pa.array(codes, pa.string()), pa.array(scores), pa.array(over)][: len(added)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*names, *added])

    return rows.mapInArrow(per_batch, schema)


def accepted(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", lost: float = LOST) -> DataFrame:
    """The documents whose language is recognised, with ``lang`` set to it.

    Those without letters go, and those with a margin that is smaller than almost all labelled texts of about the length
    have: a text in a language that was not learned, or in none. With a single language learned no lettered text goes.
    """
    pred, score, above = (unused(name, docs) for name in ("_lang", "_score", "_above"))
    rows = predicted(docs, fit(docs, learn, text, lang, lost=lost), text, pred, score, above)
    return rows.where((F.col(pred) != UNKNOWN) & (F.col(above) >= 0)).withColumn(lang, F.col(pred)).select(*docs.columns)
