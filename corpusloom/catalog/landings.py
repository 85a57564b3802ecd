"""Landed responses of a code host, written as JSON lines from the documents and read back through the whole chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.common import CODE_CTE, code_rows, documents, strip_sql
from corpusloom.catalog.repositories import WANTED, _detected, _grams, _PROFILE, _vote
from corpusloom.operators.language import train_profile
from corpusloom.plans import landed
from corpusloom.sources.stage import new_folder

#: A repository holds one source's documents of so many ids in a row, and a result page names those of so many.
REPO_IDS, PAGE_IDS = 400, 50


def _cut(line: Column) -> Column:
    return F.substring(line, 1, 30)


def write_responses(docs: DataFrame, root: str) -> None:
    """Answers, refusals (403, 404, 500) and broken lines of every kind; which is which follows from ids and lengths."""
    repo = F.concat(F.lit("o"), "source", F.lit("/r"), F.expr(f"doc_id div {REPO_IDS}").cast("string"))
    docs = code_rows(docs.where("source IS NOT NULL AND text IS NOT NULL")).join(docs.select("doc_id", "n_chars"), "doc_id").withColumn("repo", repo)

    def write(lines: DataFrame, kind: str) -> None:
        lines.select(F.col("line").alias("value")).write.text(f"{root}/{kind}")

    def answer(status: int, *fields: Column) -> Column:
        return F.to_json(F.struct(F.lit(status).alias("status"), *fields))

    hit = F.struct(F.struct(F.col("repo").alias("full_name")).alias("repository"))
    pages = docs.groupBy(F.expr(f"doc_id div {PAGE_IDS}").alias("page")).agg(F.collect_list(hit).alias("items"))
    full, turn = answer(200, F.col("items")), F.col("page") % 7
    write(pages.select(F.when(turn == 3, _cut(full)).when(turn == 5, answer(403)).otherwise(full).alias("line")), "hits")

    listed = F.struct(
        "doc_id",
        F.concat(F.lit("src/F"), F.col("doc_id").cast("string"), F.when(F.col("n_chars") % 5 != 0, ".java").otherwise(".md")).alias("path"),
        F.concat(F.lit("blob/"), F.col("doc_id").cast("string")).alias("url"),
    )
    each = docs.groupBy("repo").agg(
        (F.sum(F.col("n_chars") % 7) % 5).alias("stars"),
        (F.sum(F.col("n_chars") % 11) % 9).alias("k"),
        (F.sum(F.col("n_chars") % 13) % 6).alias("t"),
        F.transform(F.sort_array(F.collect_list(listed)), lambda e: F.struct(e["path"].alias("path"), e["url"].alias("url"))).alias("tree"),
    )
    name, k, t = F.col("repo"), F.col("k"), F.col("t")
    stars = (
        F.when(k == 1, answer(404, name))
        .when(k == 2, answer(200, name, F.lit("many").alias("stargazers_count")))
        .otherwise(answer(200, name, F.col("stars").alias("stargazers_count")))
    )
    write(each.where(k != 0).select(stars.alias("line")), "metadata")
    master, main = (F.lit(b).alias("branch") for b in ("master", "main"))
    full = lambda branch: answer(200, name, branch, F.col("tree"))
    other = F.array(F.struct(F.lit("src/Other.java").alias("path"), F.lit("blob/none").alias("url"))).alias("tree")
    on_master = F.when(t <= 1, answer(404, name, master)).when(t == 2, answer(500, name, master)).when(t == 3, _cut(full(master))).otherwise(full(master))
    on_main = F.when(t == 1, answer(404, name, main)).when(t >= 4, answer(200, name, main, other)).otherwise(full(main))
    write(each.select(F.explode(F.array(on_master, on_main)).alias("line")), "trees")

    url, b = F.concat(F.lit("blob/"), F.col("doc_id").cast("string")).alias("url"), F.col("n_chars") % 17
    full = answer(200, url, F.base64(F.encode("code", "UTF-8")).alias("content"))
    blob = F.when(b == 1, answer(500, url)).when(b == 2, _cut(full)).when(b == 3, answer(200, url, F.lit("=?").alias("content"))).otherwise(full)
    write(docs.where(b != 0).select(blob.alias("line")), "blobs")


def landing(spark: SparkSession, folder: str) -> landed.Landing:
    root = new_folder(spark, "landed")
    write_responses(documents(spark, folder, walk=True), root)
    return landed.read_landing(spark, root, utf8=True)


def landed_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Records and files that could not be used, by kind and reason."""
    return landing(spark, folder).failures()


def landed_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories that hits name, minus those with few stars or a vote against."""
    profile, languages = train_profile(documents(spark, folder, walk=True))
    return landed.landed_repositories(landing(spark, folder), profile, languages, WANTED)


def landed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Documentation pairs of the repositories kept."""
    profile, languages = train_profile(documents(spark, folder, walk=True))
    found = landing(spark, folder)
    kept = landed.landed_repositories(found, profile, languages, WANTED)
    rows = landed.landed_documentation(found, kept, profile, languages, WANTED)
    return rows.select("repo", "file_no", "method_no", "docstring_summary", F.array_join("docstring_tokens", " ").alias("docstring_tokens"), "function")


QUERIES = {"landed_failures": landed_failures, "landed_selection": landed_selection, "landed_pairs": landed_pairs}

_LANDED = f"""base AS (SELECT *, 'o' || source || '/r' || (doc_id // {REPO_IDS}) AS repo FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
each AS (SELECT repo, sum(n_chars % 7) % 5 AS stars, sum(n_chars % 11) % 9 AS k, sum(n_chars % 13) % 6 AS t FROM base GROUP BY repo),
names AS (SELECT DISTINCT repo FROM base WHERE doc_id // {PAGE_IDS} % 7 NOT IN (3, 5)),
candidates AS (SELECT repo, t FROM names JOIN each USING (repo) WHERE k > 2 AND stars >= 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY doc_id) - 1 AS file_no FROM base),
files AS (SELECT * FROM numbered JOIN candidates USING (repo) WHERE t NOT IN (1, 2) AND n_chars % 5 <> 0)"""

_CHAIN = f"""{CODE_CTE}, {_LANDED},
elements AS (SELECT doc_id, repo, file_no, trim(line) AS doc_text, trim(regexp_extract(trim(line), '^[^@]*')) AS summary, method
  FROM files JOIN (SELECT doc_id, line, method FROM code_rows) USING (doc_id) WHERE n_chars % 17 > 3),
lines AS (SELECT doc_id, doc_text FROM elements),
{_PROFILE}, {_grams('doc_text', 'lines')}, {_detected('lines', 'doc_id')},
e AS (SELECT repo, file_no, 0 AS method_no, CASE WHEN detected = '{WANTED}' THEN 'match' ELSE 'other' END AS kind
  FROM elements LEFT JOIN detected_lines USING (doc_id)),
{_vote('e', 500)},
kept AS (SELECT repo FROM names WHERE repo NOT IN (SELECT repo FROM each WHERE k > 2 AND stars < 2)
  AND repo NOT IN (SELECT repo FROM verdicts WHERE verdict = 'drop'))"""

ORACLES = {
    "landed_failures": f"""WITH {_LANDED}, pages AS (SELECT DISTINCT doc_id // {PAGE_IDS} % 7 AS turn, doc_id // {PAGE_IDS} AS page FROM base),
failed AS (
  SELECT 'hits' AS kind, CASE turn WHEN 3 THEN 'malformed' ELSE 'refused' END AS error FROM pages WHERE turn IN (3, 5)
  UNION ALL SELECT 'metadata', CASE k WHEN 1 THEN 'refused' ELSE 'malformed' END FROM each WHERE k IN (1, 2)
  UNION ALL SELECT 'trees', CASE t WHEN 3 THEN 'malformed' ELSE 'refused' END FROM each WHERE t <= 3
  UNION ALL SELECT 'trees', 'refused' FROM each WHERE t = 1
  UNION ALL SELECT 'blobs', CASE n_chars % 17 WHEN 1 THEN 'refused' ELSE 'malformed' END FROM base WHERE n_chars % 17 IN (1, 2)
  UNION ALL SELECT 'files', CASE n_chars % 17 WHEN 3 THEN 'undecodable' ELSE 'no blob' END FROM files WHERE n_chars % 17 <= 3)
SELECT kind, error, count(*) AS n FROM failed GROUP BY kind, error""",
    "landed_selection": f"WITH {_CHAIN} SELECT repo FROM kept",
    "landed_pairs": f"""WITH {_CHAIN}, {_grams('summary', 'elements')}, {_detected('elements', 'doc_id')}
SELECT repo, CAST(file_no AS INTEGER) AS file_no, 0 AS method_no, summary AS docstring_summary,
  array_to_string(regexp_extract_all(summary, '[\\p{{L}}\\p{{N}}_]+'), ' ') AS docstring_tokens, {strip_sql('method')} AS function
FROM elements JOIN detected_elements USING (doc_id) JOIN kept USING (repo) WHERE detected = '{WANTED}' AND regexp_matches(summary, '[\\p{{L}}\\p{{N}}_]')""",
}
