"""Scans, filters, splits, samples, mixtures and text cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.common import (
    CODE_CTE, LITERAL_OR_COMMENT_SQL, SEED, code_rows, documents, ink_sql, order_sql, strip_sql, table, uniform_sql,
)
from corpusloom.functions.text import strip_comments, strip_python_comments
from corpusloom.operators import index
from corpusloom.operators.mix import interleave
from corpusloom.operators.pairs import comment_inventory
from corpusloom.plans import mixture
from corpusloom.sources import readers, writers

PERCENT = 5


def scan_filter_project(spark: SparkSession, folder: str) -> DataFrame:
    return readers.non_empty(readers.with_text(documents(spark, folder), keep=("doc_id",)))


def choose_text_column(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "conversations").select("text", "conv_id", "turn")
    unnamed = table(spark, folder, "pages").select("html", "page_id")
    parts = {
        "conversations": readers.with_text(named).withColumnRenamed("text", "content"),
        "pages": readers.with_text(unnamed).withColumnRenamed("text", "content"),
    }
    return writers.with_splits(parts).withColumnsRenamed({"split": "origin"})


def percent_split(spark: SparkSession, folder: str) -> DataFrame:
    return index.percent_split(documents(spark, folder), "doc_id", PERCENT).select("doc_id", "split")


def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.split_counts(index.percent_split(documents(spark, folder), "doc_id", PERCENT))


def first_n(spark: SparkSession, folder: str) -> DataFrame:
    return index.first_n(documents(spark, folder), "doc_id", 150).select("doc_id", "text")


def shuffled_order(spark: SparkSession, folder: str) -> DataFrame:
    drawn = index.order_at_random(documents(spark, folder).select("doc_id"), "doc_id", SEED)
    return index.row_index(drawn, "_order", tie="doc_id", hashed=True).select("doc_id", "row_idx")


def row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    keys = documents(spark, folder).select("doc_id", "lang")
    return index.row_index(keys, "doc_id", by=["lang"]).withColumn("batch", index.batch_number(F.col("row_idx"), 100))


def sized_sample(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    others = index.percent_split(docs.where("lang <> 'en'").select("doc_id"), "doc_id", PERCENT)
    totals = mixture.total_rows([others])
    rows = [int(0.2 * totals.get(part, 0)) for part in ("train", "validation")]
    return index.sized_sample(docs.where("lang = 'en'").select("doc_id"), "doc_id", *rows, seed=SEED)


def random_rows(spark: SparkSession, folder: str) -> DataFrame:
    return index.random_rows(documents(spark, folder), "doc_id", 3, SEED).select("doc_id", "text")


def _by_language(spark: SparkSession, folder: str, languages: list[str]) -> list[DataFrame]:
    docs = documents(spark, folder).select("doc_id", "lang", "text")
    return [docs.where(F.col("lang") == lang) for lang in languages]


def interleave_2way(spark: SparkSession, folder: str) -> DataFrame:
    mixed = interleave(_by_language(spark, folder, ["de", "en"]), [0.5, 0.5], SEED, "doc_id")
    return mixed.select("row_idx", "doc_id", "lang", "text")


def interleave_3way(spark: SparkSession, folder: str) -> DataFrame:
    mixed = interleave(_by_language(spark, folder, ["es", "fr", "en"]), [0.2, 0.3, 0.5], SEED, "doc_id")
    return mixed.select("row_idx", "doc_id", "lang", "text")


def _code_corpus(spark: SparkSession, folder: str) -> DataFrame:
    rows = code_rows(documents(spark, folder))
    return rows.select(
        "doc_id",
        F.col("code").alias("whole_func_string"),
        F.col("line").alias("func_documentation_string"),
        F.lit("java").alias("language"),
        "lang",
    )


def mixture_build(spark: SparkSession, folder: str) -> DataFrame:
    """Three corpora at 0.2 / 0.3 / 0.5: a web corpus that is sampled by size, texts, and linked code."""
    docs = documents(spark, folder).select("doc_id", "lang", "text")
    web = docs.where("lang = 'en'").select("doc_id", "text")
    texts = readers.non_empty(docs.where("lang = 'de'").select("doc_id", "text"))
    code = mixture.linked_corpus(_code_corpus(spark, folder), keep=("doc_id",))
    mixed = mixture.build_mixture([web, texts, code], [0.2, 0.3, 0.5], "doc_id", SEED, sized=0, percent=PERCENT)
    return mixed.select("split", "row_idx", "source_no", "doc_id", "text")


def strip_code(spark: SparkSession, folder: str) -> DataFrame:
    rows = code_rows(documents(spark, folder))
    ruby = F.when(F.col("lang") == "fr", "ruby").otherwise("java")
    return rows.select("doc_id", strip_comments(F.col("code"), ruby).alias("code"))


def strip_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Comment stripping over raw pages: whole texts with quotes and slashes of every kind."""
    return table(spark, folder, "pages").select("page_id", strip_comments(F.col("html"), "javascript").alias("code"))


def strip_python(spark: SparkSession, folder: str) -> DataFrame:
    line = F.translate("text", "\n\\\"'\r", " ")
    name = F.col("doc_id").cast("string")
    source = F.concat(
        F.lit('"""module '), line, F.lit('"""\nimport os  # '), line, F.lit("\n\ndef f"), name, F.lit('(a):\n    """'),
        line, F.lit("\n    more\n    \"\"\"\n    x = '# keep "), name, F.lit("'  # drop\n\n    return x\n"),
        F.lit('v = [\n"a",  # drop\n"b"]\n"c" "d"\nif v:\n    if x:\n        y = 1\n    "e"\n    z = "f"\ng(\n# drop\n"h"\n)\n'),
    )
    return documents(spark, folder, walk=True).select("doc_id", strip_python_comments(source).alias("code"))


def doc_code_link(spark: SparkSession, folder: str) -> DataFrame:
    rows = _code_corpus(spark, folder)
    # A row without documentation fails to link and is dropped.
    doc = F.when(F.col("lang") != "es", F.col("func_documentation_string"))
    return mixture.linked_corpus(rows.withColumn("func_documentation_string", doc), keep=("doc_id",))


def failed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that fail to link, by reason: as they lie in the quarantine table, and as they were counted while it was written."""
    rows = _code_corpus(spark, folder).select("doc_id", "lang", "func_documentation_string", "whole_func_string")
    key = F.col("doc_id")
    broken = F.concat(F.lit("def f(:\n  '"), F.translate("func_documentation_string", "\n'", " "))
    rows = rows.withColumns(
        {
            "func_documentation_string": F.when(F.col("lang") != "es", F.col("func_documentation_string")),
            "whole_func_string": F.when(key % 11 != 0, F.when(key % 7 == 0, broken).otherwise(F.col("whole_func_string"))),
            "language": F.when(key % 7 == 0, "python").otherwise("java"),
        }
    )
    _, failed, seen = mixture.accounted(mixture.link_outcomes(rows, ["doc_id"], python=True), "linked")
    counted = spark.createDataFrame([(r, n) for r, n in seen.items() if r in mixture.FAILURES], "reason string, observed bigint")
    return failed.groupBy(F.col("error").alias("reason")).agg(F.count("*").alias("n")).join(counted, "reason")


def comments_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    return comment_inventory(code_rows(documents(spark, folder, walk=True)))


QUERIES = {
    "scan_filter_project": scan_filter_project,
    "choose_text_column": choose_text_column,
    "percent_split": percent_split,
    "split_counts": split_counts,
    "first_n": first_n,
    "shuffled_order": shuffled_order,
    "row_numbers": row_numbers,
    "sized_sample": sized_sample,
    "random_rows": random_rows,
    "interleave_2way": interleave_2way,
    "interleave_3way": interleave_3way,
    "mixture_build": mixture_build,
    "strip_comments": strip_code,
    "strip_pages": strip_pages,
    "strip_python": strip_python,
    "doc_code_link": doc_code_link,
    "failed_rows": failed_rows,
    "comment_inventory": comments_by_kind,
}

_CUT = f"CAST(round_even(n * {PERCENT} / 100.0, 0) AS BIGINT)"


def _split_sql(source: str) -> str:
    """``doc_id, text, split`` of a relation with ``doc_id, text``."""
    return (
        f"SELECT doc_id, text, CASE WHEN r < {_CUT} THEN 'validation' ELSE 'train' END AS split FROM ("
        f"SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM {source})"
    )


def _interleave_cte(name: str, sources: list[str], weights: list[float]) -> str:
    """``name(row_idx, source_no, doc_id, text)`` from relations with ``doc_id, text``."""
    edges = [sum(weights[: i + 1]) for i in range(len(weights) - 1)]
    drawn = "CASE " + " ".join(f"WHEN u < {e!r} THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"
    union = " UNION ALL ".join(f"SELECT {i} AS source_no, doc_id, text FROM {s}" for i, s in enumerate(sources))
    return f"""{name}_rows AS (
  SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY doc_id) - 1 AS rank,
         count(*) OVER (PARTITION BY source_no) AS n FROM ({union})),
{name}_drawn AS (
  SELECT slot, {drawn} AS source_no FROM (
    SELECT slot, {uniform_sql(SEED, 'slot')} AS u FROM (SELECT unnest(range((SELECT count(*) FROM {name}_rows))) AS slot))),
{name}_slots AS (
  SELECT slot, source_no, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS rank FROM {name}_drawn),
{name}_all AS (SELECT s.slot AS row_idx, r.* FROM {name}_slots s JOIN {name}_rows r USING (source_no, rank)),
{name} AS (
  SELECT row_idx, source_no, doc_id, text FROM {name}_all
  WHERE row_idx <= (SELECT min(row_idx) FROM {name}_all WHERE rank = n - 1))"""


def _mixed_by_language(languages: list[str], weights: list[float]) -> str:
    ctes = ", ".join(f"s_{lg} AS (SELECT doc_id, text FROM documents WHERE lang = '{lg}')" for lg in languages)
    mixed = _interleave_cte("m", [f"s_{lg}" for lg in languages], weights)
    return f"WITH {ctes}, {mixed} SELECT row_idx, doc_id, lang, m.text FROM m JOIN documents d USING (doc_id)"


_SAMPLE = f"""SELECT doc_id, text, CASE WHEN r <= a THEN 'train' ELSE 'validation' END AS split FROM (
  SELECT doc_id, text, row_number() OVER (ORDER BY {order_sql(SEED, 'doc_id')}, doc_id) - 1 AS r FROM web), sizes
  WHERE r <= a + 1 + b"""

_MIXTURE = f"""WITH {CODE_CTE},
web AS (SELECT doc_id, text FROM documents WHERE lang = 'en'),
texts AS ({_split_sql("(SELECT doc_id, text FROM documents WHERE lang = 'de' AND " + ink_sql('text') + ")")}),
linked AS (SELECT doc_id, line || '</s>' || {strip_sql('code')} AS text FROM code_rows),
code AS ({_split_sql("(SELECT * FROM linked WHERE text IS NOT NULL)")}),
sizes AS (
  SELECT CAST(floor(0.2::DOUBLE * count(*) FILTER (split = 'train')) AS BIGINT) AS a,
         CAST(floor(0.2::DOUBLE * count(*) FILTER (split = 'validation')) AS BIGINT) AS b
  FROM (SELECT split FROM texts UNION ALL SELECT split FROM code)),
sampled AS ({_SAMPLE}),
""" + ", ".join(
    ", ".join(f"{source}_{part} AS (SELECT doc_id, text FROM {source} WHERE split = '{part}')" for source in ("sampled", "texts", "code"))
    + ", "
    + _interleave_cte(f"m_{part}", [f"sampled_{part}", f"texts_{part}", f"code_{part}"], [0.2, 0.3, 0.5])
    for part in ("train", "validation")
) + """ SELECT 'train' AS split, row_idx, source_no, doc_id, text FROM m_train
UNION ALL SELECT 'validation', row_idx, source_no, doc_id, text FROM m_validation"""

ORACLES = {
    "scan_filter_project": f"SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND {ink_sql('text')}",
    "choose_text_column": "SELECT text AS content, 'conversations' AS origin FROM conversations "
    "UNION ALL SELECT html, 'pages' FROM pages",
    "percent_split": f"SELECT doc_id, split FROM ({_split_sql('documents')})",
    "split_counts": f"SELECT split, count(*) AS n FROM ({_split_sql('documents')}) GROUP BY split",
    "first_n": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 150",
    "shuffled_order": f"SELECT doc_id, row_number() OVER (ORDER BY {order_sql(SEED, 'doc_id')}, doc_id) - 1 AS row_idx FROM documents",
    "row_numbers": "SELECT doc_id, lang, row_idx, row_idx // 100 AS batch FROM (SELECT doc_id, lang, "
    "row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row_idx FROM documents)",
    "sized_sample": f"""WITH web AS (SELECT doc_id, text FROM documents WHERE lang = 'en'),
others AS ({_split_sql("(SELECT doc_id, text FROM documents WHERE lang <> 'en')")}),
sizes AS (SELECT CAST(floor(0.2::DOUBLE * count(*) FILTER (split = 'train')) AS BIGINT) AS a,
                 CAST(floor(0.2::DOUBLE * count(*) FILTER (split = 'validation')) AS BIGINT) AS b FROM others)
SELECT doc_id, split FROM ({_SAMPLE})""",
    "random_rows": f"SELECT doc_id, text FROM documents ORDER BY {order_sql(SEED, 'doc_id')}, doc_id LIMIT 3",
    "interleave_2way": _mixed_by_language(["de", "en"], [0.5, 0.5]),
    "interleave_3way": _mixed_by_language(["es", "fr", "en"], [0.2, 0.3, 0.5]),
    "mixture_build": _MIXTURE,
    "strip_comments": f"WITH {CODE_CTE} SELECT doc_id, CASE WHEN lang = 'fr' THEN code ELSE {strip_sql('code')} END AS code FROM code_rows",
    "strip_pages": f"SELECT page_id, {strip_sql('html')} AS code FROM pages",
    "strip_python": r"""SELECT doc_id, 'import os' || '  ' || chr(10) || 'def f' || doc_id || '(a):' || chr(10)
|| '    x = ''# keep ' || doc_id || '''  ' || chr(10) || '    return x' || chr(10) || 'v = [' || chr(10) || '"a",  ' || chr(10) || '"b"]' || chr(10)
|| 'if v:' || chr(10) || '    if x:' || chr(10) || '        y = 1' || chr(10) || '    z = "f"' || chr(10) || 'g(' || chr(10) || '"h"' || chr(10) || ')' AS code FROM documents""",
    "doc_code_link": f"WITH {CODE_CTE} SELECT doc_id, line || '</s>' || {strip_sql('code')} AS text FROM code_rows WHERE lang <> 'es'",
    "failed_rows": """SELECT reason, count(*) AS n, count(*) AS observed FROM (
  SELECT CASE WHEN lang = 'es' THEN 'no documentation' WHEN doc_id % 11 = 0 THEN 'no code' WHEN doc_id % 7 = 0 THEN 'not tokenisable' END AS reason
  FROM documents) WHERE reason IS NOT NULL GROUP BY reason""",
    "comment_inventory": f"""WITH {CODE_CTE},
c AS (SELECT unnest(regexp_extract_all(code, '{LITERAL_OR_COMMENT_SQL}')) AS comment FROM code_rows)
SELECT CASE WHEN comment LIKE '//%' THEN 'line' WHEN comment LIKE '/**%' AND length(comment) > 4 THEN 'doc' ELSE 'block' END AS kind,
       count(*) AS n, CAST(sum(length(comment)) AS BIGINT) AS chars
FROM c WHERE comment LIKE '/%' GROUP BY 1""",
}
