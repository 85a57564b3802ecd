"""Repository selection from landed search results: hits, stars, trees, and a vote on the documentation's language."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Votes that decide, undocumented methods in a row that end the reading, least stars.
VOTES, STREAK, MIN_STARS = 5, 500, 2

MOST_KEYWORDS = 1_000

NO_DOC, MATCH, OTHER, ERROR = "nodoc", "match", "other", "err"


def keyword_queries(keywords: DataFrame, size: int = 3) -> DataFrame:
    """All combinations of ``size`` keywords of ``(pos, word)`` as search strings, in list order.

    The keyword list is a search parameter, and its size is checked. A combination is found from its number alone: in the order of
    their places, so many begin with each keyword, so many of those go on with each later one. So the numbers are a range that
    any number of tasks share, and no task makes more than its own.
    """
    spark = keywords.sparkSession
    listed = [r.word for r in keywords.orderBy("pos").limit(MOST_KEYWORDS + 1).collect()]
    if len(listed) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords")
    n = len(listed)
    left, start = F.col("id"), F.lit(0)
    found = spark.range(math.comb(n, size))
    word = F.array(*map(F.lit, listed)) if listed else F.array().cast("array<string>")
    for place in range(size):
        # How many combinations of what is left to pick begin before each keyword.
        before = [0, *accumulate(math.comb(n - 1 - x, size - 1 - place) for x in range(n))]
        counts = F.array(*(F.lit(c).cast("bigint") for c in before))
        goal = left + F.get(counts, start)
        at = F.size(F.filter(counts, _up_to(goal))) - 1
        # Of keywords that no combination begins with, the last would be found.
        at = F.least(at, F.lit(n - size + place))
        found = found.withColumn(f"at{place}", at).withColumn("id", goal - F.get(counts, F.col(f"at{place}")))
        left, start = F.col("id"), F.col(f"at{place}") + 1
    picked = [F.get(word, F.col(f"at{place}")) for place in range(size)]
    return found.select(F.concat_ws(" ", *picked).alias("query"))


def _up_to(goal: Column):
    return lambda count: count <= goal


def hit_names(hits: DataFrame) -> DataFrame:
    """Distinct repository names of landed result pages ``(items)``."""
    return hits.select(F.explode("items.repository.full_name").alias("repo")).dropDuplicates(["repo"])


def branch_files(trees: DataFrame, repos: DataFrame, suffix: str = ".java") -> DataFrame:
    """``(repo, branch, file_no, path, url)`` of the ``master`` tree, or of ``main`` where there is none.

    A repository without either keeps one row with NULL files.
    """
    by_branch = {
        branch: trees.where(F.col("branch") == branch).select("repo", F.col("tree").alias(branch))
        for branch in ("master", "main")
    }
    chosen = repos.join(by_branch["master"], "repo", "left").join(by_branch["main"], "repo", "left")
    files = F.filter(
        F.transform(F.coalesce("master", "main"), lambda f, i: F.struct(i.alias("file_no"), f["path"].alias("path"), f["url"].alias("url"))),
        lambda f: f["path"].endswith(suffix),
    )
    branch = F.when(F.col("master").isNotNull(), "master").when(F.col("main").isNotNull(), "main")
    return chosen.select("repo", branch.alias("branch"), F.explode_outer(files).alias("f")).select("repo", "branch", "f.*")


def decode_blob(content: Column) -> Column:
    """Base64 file content as text, one character per byte."""
    return F.decode(F.unbase64(content), "ISO-8859-1")


def blob_text(content: Column, utf8: bool = False) -> Column:
    """Base64 content, line ends allowed, as text: one character per byte or as UTF-8; NULL for what is neither."""
    raw = F.try_to_binary(F.translate(content, " \t\r\n", ""), F.lit("base64"))
    return F.try_validate_utf8(raw.cast("string")) if utf8 else F.decode(raw, "ISO-8859-1")


def vote_kind(doc: Column, detected: Column, wanted: str) -> Column:
    return F.when(doc.isNull(), NO_DOC).when(detected == wanted, MATCH).otherwise(OTHER)


def language_vote(events: DataFrame, votes: int = VOTES, streak: int = STREAK, block: int = 1024) -> DataFrame:
    """Decide each repository from its methods ``(repo, file_no, method_no, kind)`` read in order.

    A method documented in the wanted language votes +1, in another one -1; reading stops at ±``votes``. It also stops
    behind a file at whose end ``streak`` undocumented methods have passed since the last +1. An error ends its file.

    A running total over a whole repository would put a repository with a third of all methods in one task. Files are
    therefore cut into blocks of ``block``; totals run inside a block, and a table with one row per block carries them
    over from block to block. ``verdict`` is ``keep``, ``drop`` or ``undecided``.
    """
    placed = events.withColumn("blk", F.expr(f"file_no div {block}")).repartition("repo", "blk")
    in_file = Window.partitionBy("repo", "blk", "file_no")
    in_block = Window.partitionBy("repo", "blk").orderBy("file_no", "method_no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    is_match = F.col("kind") == MATCH
    running = (
        placed.withColumn("broken_at", F.min(F.when(F.col("kind") == ERROR, F.col("method_no"))).over(in_file))
        .where(F.col("broken_at").isNull() | (F.col("method_no") < F.col("broken_at")))
        .withColumn("step", F.when(is_match, 1).when(F.col("kind") == OTHER, -1).otherwise(0))
        .withColumn("bare", (F.col("kind") == NO_DOC).cast("int"))
        .withColumn("vote_in", F.sum("step").over(in_block))
        .withColumn("bare_in", F.sum("bare").over(in_block))
        .withColumn("reset_in", F.max(F.when(is_match, F.col("bare_in"))).over(in_block))
    )
    totals = running.groupBy("repo", "blk").agg(
        F.sum("step").alias("step"), F.sum("bare").alias("bare"), F.max("reset_in").alias("reset")
    )
    earlier = Window.partitionBy("repo").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        totals.withColumn("vote_before", F.coalesce(F.sum("step").over(earlier), F.lit(0)))
        .withColumn("bare_before", F.coalesce(F.sum("bare").over(earlier), F.lit(0)))
        .withColumn("reset_before", F.max(F.col("bare_before") + F.col("reset")).over(earlier))
        .select("repo", "blk", "vote_before", "bare_before", "reset_before")
    )
    reset = F.coalesce(F.greatest(F.col("bare_before") + F.col("reset_in"), F.col("reset_before")), F.lit(0))
    state = running.join(carried, ["repo", "blk"]).select(
        "repo",
        "blk",
        "file_no",
        "method_no",
        (F.col("vote_before") + F.col("vote_in")).alias("vote"),
        (F.col("bare_before") + F.col("bare_in") - reset).alias("since_match"),
    )
    # Per file: the first decisive vote and the streak at its end. Then per repository: the earliest of each.
    decisive = F.when(F.abs("vote") == votes, F.struct("file_no", "method_no", "vote"))
    per_file = state.groupBy("repo", "blk", "file_no").agg(
        F.min(decisive).alias("hit"), F.max_by("since_match", "method_no").alias("at_end")
    )
    per_repo = per_file.groupBy("repo").agg(
        F.min("hit").alias("hit"), F.min(F.when(F.col("at_end") >= streak, F.col("file_no"))).alias("stop_file")
    )
    reached = F.col("hit").isNotNull() & (
        F.col("stop_file").isNull() | (F.col("hit.file_no") <= F.col("stop_file"))
    )
    verdict = F.when(~reached, "undecided").when(F.col("hit.vote") > 0, "keep").otherwise("drop")
    return per_repo.select("repo", verdict.alias("verdict"))


def select_repositories(
    names: DataFrame, metadata: DataFrame, verdicts: DataFrame | None = None, min_stars: int = MIN_STARS
) -> DataFrame:
    """Names minus those with too few stars or a vote against. Without evidence (no metadata, no vote) a name stays."""
    removed = metadata.where(F.col("stargazers_count") < min_stars).select("repo")
    if verdicts is not None:
        removed = removed.unionByName(verdicts.where(F.col("verdict") == "drop").select("repo"))
    return names.join(removed, "repo", "left_anti")
