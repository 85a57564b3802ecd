"""The whole chain over landed responses: hits, stars, trees, blobs, methods, vote, documentation pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import repos
from corpusloom.operators.lookup import lookup
from corpusloom.plans import selection
from corpusloom.sources import landed
from corpusloom.sources.stage import staged

#: Reasons why a listed file has no source: no usable blob, or one that is not base64 or not in the charset.
NO_BLOB, UNDECODABLE = "no blob", "undecodable"


@dataclass(frozen=True)
class Landing:
    """Landed records with their ``error``; ``files`` are those of the candidates: ``(repo, file_no, path, code, error)``."""

    hits: DataFrame
    metadata: DataFrame
    trees: DataFrame
    blobs: DataFrame
    names: DataFrame
    files: DataFrame

    def failures(self) -> DataFrame:
        """``(kind, error, n)`` over all records that were read and all files that were wanted."""
        return landed.failures({k: getattr(self, k) for k in ("hits", "metadata", "trees", "blobs", "files")})

    def sources(self) -> DataFrame:
        return self.files.where("error IS NULL").select("repo", "file_no", "code")


def read_landing(spark: SparkSession, root: str, min_stars: int = repos.MIN_STARS, suffix: str = ".java", utf8: bool = False) -> Landing:
    """Read the responses below ``root`` and put together the sources of the repositories worth reading.

    Each step narrows the next one's input before it is opened: only named repositories with enough stars have their trees
    unrolled, and of the blobs only those that these trees list are kept, beside the failed ones. Repeated responses count once:
    the greatest tree of a branch, the greatest content of a blob. ``utf8`` reads sources as UTF-8 instead of a character a byte.
    """
    hits, metadata, trees, blobs = (landed.landed(spark, root, kind) for kind in landed.KINDS)
    names = staged(repos.hit_names(landed.usable(hits)).where("repo IS NOT NULL"), "names")
    rated = landed.usable(metadata).groupBy("repo").agg(F.min("stargazers_count").alias("stars")).where(F.col("stars") >= min_stars)
    candidates = staged(names.join(rated, "repo", "left_semi"), "candidates")
    files = staged(_listed(trees.join(candidates, "repo", "left_semi"), candidates, suffix), "files")
    wanted = files.select("url").distinct().withColumn("_wanted", F.lit(True))
    # Failed records may have lost their url, so they are kept whatever it says.
    read = staged(blobs.join(wanted, "url", "left").where("error IS NOT NULL OR _wanted").drop("_wanted"), "blobs")
    contents = staged(landed.usable(read).groupBy("url").agg(F.max("content").alias("content")), "contents")
    code = repos.blob_text(F.col("content"), utf8)
    found = lookup(files, contents, "url").select("repo", "file_no", "path", "content", code.alias("code"))
    reason = F.when(F.col("content").isNull(), NO_BLOB).when(F.col("code").isNull(), UNDECODABLE)
    sources = staged(found.withColumn("error", reason).drop("content"), "sources")
    return Landing(hits, metadata, trees, read, names, sources)


def _listed(trees: DataFrame, candidates: DataFrame, suffix: str) -> DataFrame:
    """Files by the ``master`` tree, or by ``main`` only where the answer for ``master`` was that there is none, or no answer landed."""
    refused = trees.where((F.col("branch") == "master") & (F.col("error") == landed.REFUSED) & (F.col("status") != landed.ABSENT))
    answered = landed.usable(trees).groupBy("repo", "branch").agg(F.max("tree").alias("tree"))
    readable = candidates.join(refused.select("repo"), "repo", "left_anti")
    return repos.branch_files(answered, readable, suffix).where("url IS NOT NULL").select("repo", "file_no", "path", "url")


def landed_repositories(landing: Landing, profile: DataFrame, languages: list[str], wanted: str, min_stars: int = repos.MIN_STARS) -> DataFrame:
    """Names of the hits, minus those with few stars or whose methods vote against the wanted language."""
    metadata = landed.usable(landing.metadata)
    return selection.wanted_repositories(landing.names, metadata, landing.sources(), profile, languages, wanted, min_stars)


def landed_documentation(landing: Landing, kept: DataFrame, profile: DataFrame, languages: list[str], wanted: str) -> DataFrame:
    """Documentation pairs of the repositories kept."""
    files = landing.sources().join(kept, "repo", "left_semi")
    return selection.documentation_pairs(files, profile, languages, wanted)
