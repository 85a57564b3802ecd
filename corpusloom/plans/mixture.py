"""Build a training mixture: link code corpora, split, sample the sized corpus, interleave by weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.functions.text import link_doc_and_code, strip_comments
from corpusloom.operators.index import percent_label, sampled
from corpusloom.operators.mix import pick_rows, tagged, within
from corpusloom.sources.stage import staged
from corpusloom.sources.writers import with_splits


def linked_corpus(code: DataFrame, keep: Sequence[str] = (), python: bool = False) -> DataFrame:
    """Code rows as ``doc</s>code`` texts; rows that fail on either side are dropped."""
    both = code.where("func_documentation_string IS NOT NULL AND whole_func_string IS NOT NULL")
    bare = strip_comments(F.col("whole_func_string"), F.col("language"), python)
    linked = both.select(*keep, link_doc_and_code(F.col("func_documentation_string"), bare).alias("text"))
    # Only Python sources can fail on the way; a filter on the text would have it made twice.
    return linked.where(F.col("text").isNotNull()) if python else linked


NO_DOC, NO_CODE, NOT_READ = "no documentation", "no code", "not tokenisable"
FAILURES = (NO_DOC, NO_CODE, NOT_READ)


def link_outcomes(code: DataFrame, keep: Sequence[str] = (), python: bool = False) -> DataFrame:
    """``(…, text, error)``: every code row, with its linked text or the reason why it has none. No row vanishes."""
    doc, source = F.col("func_documentation_string"), F.col("whole_func_string")
    linked = code.select(*keep, doc, source, link_doc_and_code(doc, strip_comments(source, F.col("language"), python)).alias("text"))
    reason = F.when(doc.isNull(), NO_DOC).when(source.isNull(), NO_CODE).when(F.col("text").isNull(), NOT_READ)
    return linked.select(*keep, "text", reason.alias("error"))


def accounted(
    rows: DataFrame, name: str, reasons: Sequence[str] = FAILURES, error: str = "error"
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The rows without and with an ``error``, and how many there are of each reason (and of ``rows`` in all).

    The rows are written once, failed ones too; the counts are taken while they are written, so they need no pass of their own
    and are those of the table. Any other reason counts as ``other``.
    """
    which = F.col(error)
    counts = {r: F.count(F.when(which == r, 1)) for r in reasons}
    counts["other"] = F.count(F.when(which.isNotNull() & ~which.isin(*reasons), 1))
    counts["rows"] = F.count(F.lit(1))
    seen = Observation(name)
    kept = staged(rows.observe(seen, *[c.alias(r) for r, c in counts.items()]), name)
    return kept.where(which.isNull()).drop(error), kept.where(which.isNotNull()), dict(seen.get)


def split_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("split").agg(F.count("*").alias("n"))


def total_rows(corpora: Sequence[DataFrame]) -> dict[str, int]:
    totals: dict[str, int] = {}
    for corpus in corpora:
        for row in split_counts(corpus).collect():
            totals[row["split"]] = totals.get(row["split"], 0) + row["n"]
    return totals


def build_mixture(
    corpora: Sequence[DataFrame],
    weights: Sequence[float],
    key: str,
    seed: int,
    sized: int | None = None,
    percent: float = 5,
) -> DataFrame:
    """``(split, row_idx, source_no, key, text)`` of all corpora interleaved by weight, for each split.

    ``sized`` is the position of the corpus that is too large to take whole: it is shuffled and sampled to its weight
    times the rows of the others; a corpus with its own ``split`` column keeps it. Validation draws from validation
    parts only. Splits, sample and order are found on staged keys. Wide rows outside the sample and the picked keys are
    filtered by literals before their texts are made; the rest is shuffled once, in the join that keeps the picked rows.
    """
    keys = [staged(corpus.select(key, *_own_split(corpus)), "keys") for corpus in corpora]
    split: list[DataFrame | None] = [None] * len(corpora)
    for n, corpus in enumerate(corpora):
        if n != sized:
            label = F.col("split") if _own_split(corpus) else percent_label(keys[n], key, percent)
            split[n] = keys[n].select(key, label.alias("split"))
    wide = [corpus.select(key, "text") for corpus in corpora]
    if sized is not None:
        totals = total_rows([part for part in split if part is not None])
        rows = [int(weights[sized] * totals.get(name, 0)) for name in ("train", "validation")]
        only = keys[sized].select(key)
        split[sized] = staged(sampled(only, only, key, *rows, seed=seed), "sample")
        wide[sized] = sampled(wide[sized], only, key, *rows, seed=seed).drop("split")
    ids = staged(tagged(split), "split-keys")
    picks = staged(with_splits(
        {
            name: pick_rows(ids.where(F.col("split") == name).drop("split"), weights, seed, key)
            for name in ("train", "validation")
        }
    ), "picks")
    return tagged(within(wide, picks, key)).join(picks, ["source_no", key])


def _own_split(corpus: DataFrame) -> list[str]:
    return ["split"] if "split" in corpus.columns else []
