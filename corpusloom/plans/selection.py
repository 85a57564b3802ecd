"""From landed files to documentation/function pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import pairs, repos
from corpusloom.operators.language import detect
from corpusloom.sources.stage import staged


def documented_methods(files: DataFrame) -> DataFrame:
    """Methods of ``(repo, file_no, code)`` with a row key and the bare text of their documentation."""
    methods = pairs.methods_with_docs(files)
    key = F.concat_ws("/", "repo", F.col("file_no").cast("string"), F.col("method_no").cast("string"))
    return methods.withColumn("method_key", key).withColumn("doc_text", pairs.doc_text(F.col("doc")))


def vote_events(methods: DataFrame, profile: DataFrame, languages: list[str], wanted: str) -> DataFrame:
    """``(repo, file_no, method_no, kind)``; a method without documentation is not sent to detection."""
    with_doc = methods.where(F.col("doc").isNotNull())
    found = detect(with_doc.select("method_key", "doc_text"), "method_key", profile, languages, "doc_text")
    kind = repos.vote_kind(F.col("doc"), F.col("detected"), wanted)
    return methods.join(found, "method_key", "left").select("repo", "file_no", "method_no", kind.alias("kind"))


def wanted_repositories(
    names: DataFrame, metadata: DataFrame, files: DataFrame, profile: DataFrame, languages: list[str], wanted: str,
    min_stars: int = repos.MIN_STARS,
) -> DataFrame:
    # The vote reads documentation only, so no code is staged.
    methods = staged(documented_methods(files).drop("code"), "methods")
    verdicts = repos.language_vote(vote_events(methods, profile, languages, wanted))
    return repos.select_repositories(names, metadata, verdicts, min_stars)


def documentation_pairs(files: DataFrame, profile: DataFrame, languages: list[str], wanted: str) -> DataFrame:
    """``(repo, file_no, method_no, docstring_tokens, docstring_summary, function)`` in the wanted language."""
    elements = staged(pairs.doc_elements(documented_methods(files).drop("doc_text")), "elements")
    found = detect(elements, "method_key", profile, languages, "docstring_summary")
    return pairs.language_pairs(elements.join(found, "method_key"), "detected", wanted).drop("method_key", "detected")
