"""Repository selection, language identification, and documentation/function pairs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.common import CODE_CTE, SEED, code_rows, documents, strip_sql, table, top_words_sql, uniform_sql
from corpusloom.functions.draws import uniform
from corpusloom.operators import language, pairs, repos
from corpusloom.operators import vocab as v
from corpusloom.operators.language import detect, train_profile
from corpusloom.plans import selection
from corpusloom.sources import schemas, writers
from corpusloom.sources.stage import staged

KEYWORDS, WANTED, STREAK = 8, "en", 12
HALF = f"{SEED}half"


def keyword_combos(spark: SparkSession, folder: str) -> DataFrame:
    """Search strings from the most frequent words of the benchmark texts."""
    top = v.word_vocab(v.word_counts(table(spark, folder, "benchmark")), KEYWORDS, first_id=0)
    return repos.keyword_queries(top.select(F.col("idx").alias("pos"), F.col("token").alias("word")), 3)


def _repo(source: str = "source") -> F.Column:
    return F.concat(F.lit("owner/"), F.col(source))


def landed_hits(docs: DataFrame) -> DataFrame:
    """Search result pages of 100 hits as JSON text, then read with the declared schema."""
    hit = F.struct(F.struct(_repo().alias("full_name")).alias("repository"))
    pages = docs.groupBy(F.expr("doc_id div 100").alias("page")).agg(F.collect_list(hit).alias("items"))
    text = pages.select(F.to_json(F.struct("items")).alias("value"))
    return text.select(F.from_json("value", schemas.SEARCH_PAGE).alias("p")).select("p.items")


def landed_metadata(docs: DataFrame) -> DataFrame:
    """Stars by repository; every source that ends in 9 has no metadata."""
    counted = docs.where(~F.col("source").endswith("9")).groupBy(_repo().alias("repo")).agg(F.sum(F.col("n_chars") % 7).alias("n"))
    return counted.select("repo", (F.col("n") % 5).cast("int").alias("stargazers_count"))


def landed_trees(docs: DataFrame) -> DataFrame:
    """Trees of one document each: French has ``master`` and ``main``, English the first, German the second, Spanish none."""
    path = F.concat(F.lit("src/F"), F.col("doc_id").cast("string"), F.when(F.col("n_chars") % 2 == 0, ".java").otherwise(".md"))
    entry = lambda p: F.struct(p.alias("path"), F.concat(F.lit("blob/"), p).alias("url"))
    tree = F.array(entry(F.lit("README.md")), entry(path), entry(F.lit("src/Main.java")))
    repo = F.concat(F.lit("repo/"), F.col("doc_id").cast("string"))
    branches = {"master": docs.where("lang in ('en', 'fr')"), "main": docs.where("lang in ('de', 'fr')")}
    return writers.with_splits(
        {name: rows.select(repo.alias("repo"), tree.alias("tree")) for name, rows in branches.items()}
    ).withColumnRenamed("split", "branch")


def repo_names(spark: SparkSession, folder: str) -> DataFrame:
    return repos.hit_names(landed_hits(documents(spark, folder).select("doc_id", "source")))


def repo_filter(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "source", "n_chars")
    return repos.select_repositories(repos.hit_names(landed_hits(docs)), landed_metadata(docs))


def branch_fallback(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "lang", "n_chars")
    names = docs.select(F.concat(F.lit("repo/"), F.col("doc_id").cast("string")).alias("repo"))
    files = repos.branch_files(landed_trees(docs), names)
    return files.fillna("none", ["branch", "path", "url"]).fillna(-1, ["file_no"])


def name_list(spark: SparkSession, folder: str) -> DataFrame:
    """The selected names, written as twice-encoded sets and read back."""
    return writers.read_name_list(writers.name_list(repo_names(spark, folder)))


def blob_decode(spark: SparkSession, folder: str) -> DataFrame:
    blobs = documents(spark, folder).select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("content"))
    text = repos.decode_blob(F.col("content"))
    # One character per byte: the byte view of the decoded text must be the original text's.
    return blobs.select("doc_id", F.length(text).alias("n"), F.md5(F.encode(text, "ISO-8859-1")).alias("digest"))


def _events(docs: DataFrame) -> DataFrame:
    """Documents as methods: ten to a file, in id order, with errors and gaps in the documentation."""
    kind = (
        F.when(F.col("n_chars") % 97 == 0, repos.ERROR)
        .when(F.col("n_chars") % 3 != 0, repos.NO_DOC)
        .otherwise(F.when(F.col("lang") == WANTED, repos.MATCH).otherwise(repos.OTHER))
    )
    return docs.select(
        _repo().alias("repo"),
        F.expr("int(doc_id div 100)").alias("file_no"),
        F.expr("int(doc_id % 100)").alias("method_no"),
        kind.alias("kind"),
    )


def language_vote(spark: SparkSession, folder: str) -> DataFrame:
    events = _events(documents(spark, folder).select("doc_id", "source", "lang", "n_chars"))
    return repos.language_vote(events, streak=STREAK, block=4)


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, walk=True)
    profile, languages = train_profile(docs)
    return detect(docs, "doc_id", profile, languages).fillna("none")


def language_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """How well a profile of a drawn half of the documents tells the other half apart, per language."""
    docs, drawn = documents(spark, folder, walk=True), uniform(HALF, "doc_id") < 0.5
    profile, languages = train_profile(docs.where(drawn))
    rest = docs.where(~drawn)
    found = detect(rest, "doc_id", profile, languages).join(rest.select("doc_id", "lang"), "doc_id")
    right = F.when(language.is_language(F.col("detected"), F.col("lang")), 1.0).otherwise(0.0)
    return found.groupBy("lang").agg(F.count("*").alias("texts"), F.round(F.avg(right), 6).alias("accuracy"))


def _files(docs: DataFrame) -> DataFrame:
    return code_rows(docs).select(_repo().alias("repo"), F.col("doc_id").alias("file_no"), "code")


def doc_methods(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.methods_with_docs(_files(documents(spark, folder, walk=True)))


#: A Java source of many shapes, «doc» and «id» being a document's; and its methods, in order, with whether they have the doc.
_LOCAL = "void local() { return; }"
_ANNOTATED = '@X(y = @Z(1)) @W({"{", "("}) public void annotated«id»() {\n  class L { «doc» ' + _LOCAL + " }\n}"
_CONSTANT = "int constant() { return '}'; }"
_RUN = '@Override public void run() { go("}"); /* } */ }'
_BLOCK = 'String block() {\n  return """\n    void none() { "quoted" }\n    """;\n}'
_PLAIN = "abstract <K, V extends C<K>> Map<K, List<V>> plain«id»(@N(1) int a) throws E;"
_LAMBDA = "static Runnable later(int a) { return () -> { if (a > 0) { new Thread() { «doc» " + _RUN + " }.start(); } }; }"
JAVA_SHAPES = (
    "import a.b;\npublic class C<T extends B<T>> {\n  C() { super(); }\n  static { init(); }\n  «doc»\n  " + _ANNOTATED
    + "\n  int[] v = {1, 2};\n  enum E { A { «doc» " + _CONSTANT + " }, B(2); E(int... x) { } }\n  Runnable r = new Runnable() { " + _RUN
    + " };\n  @interface I { int value() default 3; String[] names() default {}; }\n  // plain\n  " + _BLOCK + "\n  «doc»\n  " + _PLAIN
    + "\n  record R(int x) { R { check(x); } }\n  " + _LAMBDA + "\n}\n"
)
SHAPE_METHODS = (
    (_ANNOTATED, True), (_LOCAL, True), (_CONSTANT, True), (_RUN, False), (_BLOCK, True), (_PLAIN, True), (_LAMBDA, False), (_RUN, True)
)


def _filled(template: str, doc: F.Column) -> F.Column:
    parts = re.split("«(doc|id)»", template)
    values = {"doc": doc, "id": F.col("doc_id").cast("string")}
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def doc_method_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Methods of sources with members at every depth: the whole document is the doc comment of most."""
    rows = code_rows(documents(spark, folder, walk=True))
    files = rows.select(_repo().alias("repo"), F.col("doc_id").alias("file_no"), _filled(JAVA_SHAPES, F.col("doc")).alias("code"))
    return pairs.methods_with_docs(files).fillna("none", ["doc"])


def doc_function_pairs(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, walk=True)
    profile, languages = train_profile(docs)
    found = selection.documentation_pairs(_files(docs), profile, languages, WANTED)
    return found.select("repo", "file_no", "method_no", "docstring_summary", F.array_join("docstring_tokens", " ").alias("docstring_tokens"), "function")


def repository_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Names from hits, minus those with few stars or a vote against, the votes read from the code itself."""
    docs = documents(spark, folder, walk=True)
    profile, languages = train_profile(docs)
    names = repos.hit_names(landed_hits(docs.select("doc_id", "source")))
    return selection.wanted_repositories(names, landed_metadata(docs), _files(docs), profile, languages, WANTED)


QUERIES = {
    "keyword_combos": keyword_combos,
    "repo_names": repo_names,
    "repo_filter": repo_filter,
    "branch_fallback": branch_fallback,
    "name_list": name_list,
    "blob_decode": blob_decode,
    "language_vote": language_vote,
    "language_id": language_id,
    "language_accuracy": language_accuracy,
    "doc_methods": doc_methods,
    "doc_method_shapes": doc_method_shapes,
    "doc_function_pairs": doc_function_pairs,
    "repository_selection": repository_selection,
}

# SQL ------------------------------------------------------------------------------------------------------------------

_STARS = "stars AS (SELECT 'owner/' || source AS repo, sum(n_chars % 7) % 5 AS stars FROM documents WHERE source NOT LIKE '%9' GROUP BY source)"


def _grams(text: str, rows: str, key: str = "doc_id") -> str:
    """``(key, gram)``: three passes of non-overlapping trigrams, one from each offset."""
    passes = " UNION ALL ".join(
        f"SELECT {key}, unnest(regexp_extract_all(substr(t, {i}), '...')) AS gram FROM cleaned_{rows}" for i in (1, 2, 3)
    )
    return (
        f"cleaned_{rows} AS (SELECT *, regexp_replace(lower({text}), '[^\\p{{L}}]+', ' ', 'g') AS t FROM {rows}), grams_{rows} AS ({passes})"
    )


def _profile(where: str = "true") -> str:
    return f"""{_grams('text', 'documents')},
counts AS (SELECT lang, gram, count(*) AS n FROM grams_documents JOIN documents USING (doc_id) WHERE {where} GROUP BY lang, gram),
totals AS (SELECT lang, sum(n) AS total FROM counts GROUP BY lang),
size AS (SELECT count(DISTINCT gram) AS v FROM counts),
profile AS (SELECT g.gram, t.lang, CAST(round((ln(coalesce(n, 0) + 1.0::DOUBLE) - ln((total + v)::DOUBLE)) * 1000000) AS BIGINT) AS s
            FROM (SELECT DISTINCT gram FROM counts) g CROSS JOIN totals t CROSS JOIN size LEFT JOIN counts c ON c.gram = g.gram AND c.lang = t.lang)"""


_PROFILE = _profile()


def _detected(rows: str, key: str) -> str:
    return f"""detected_{rows} AS (SELECT {key}, first(lang ORDER BY s DESC, lang) AS detected FROM (
  SELECT {key}, lang, sum(times * s) AS s FROM (SELECT {key}, gram, count(*) AS times FROM grams_{rows} GROUP BY {key}, gram) JOIN profile USING (gram)
  GROUP BY {key}, lang) GROUP BY {key})"""


def _vote(events: str, streak: int) -> str:
    """``verdicts(repo, verdict)`` of a relation ``(repo, file_no, method_no, kind)``, read in order."""
    return f"""cut AS (SELECT *, min(CASE WHEN kind = 'err' THEN method_no END) OVER (PARTITION BY repo, file_no) AS broken FROM {events}),
read AS (SELECT *, CASE kind WHEN 'match' THEN 1 WHEN 'other' THEN -1 ELSE 0 END AS d, CASE WHEN kind = 'nodoc' THEN 1 ELSE 0 END AS b
         FROM cut WHERE broken IS NULL OR method_no < broken),
run AS (SELECT *, sum(d) OVER o AS g, sum(b) OVER o AS bare FROM read WINDOW o AS (PARTITION BY repo ORDER BY file_no, method_no)),
gone AS (SELECT *, bare - coalesce(max(CASE WHEN kind = 'match' THEN bare END) OVER (PARTITION BY repo ORDER BY file_no, method_no), 0) AS since,
                row_number() OVER (PARTITION BY repo, file_no ORDER BY method_no DESC) AS from_end FROM run),
hits AS (SELECT repo, min((file_no, method_no, g)) AS hit FROM gone WHERE abs(g) = 5 GROUP BY repo),
stops AS (SELECT repo, min(file_no) AS stop_file FROM gone WHERE from_end = 1 AND since >= {streak} GROUP BY repo),
verdicts AS (
  SELECT repo, CASE WHEN hit IS NULL OR hit[1] > coalesce(stop_file, hit[1]) THEN 'undecided' WHEN hit[3] > 0 THEN 'keep' ELSE 'drop' END AS verdict
  FROM (SELECT DISTINCT repo FROM gone) LEFT JOIN hits USING (repo) LEFT JOIN stops USING (repo))"""


_LINES = f"""{CODE_CTE},
elements AS (SELECT doc_id, 'owner/' || source AS repo, trim(regexp_extract(trim(line), '^[^@]*')) AS summary, trim(line) AS doc_text, method FROM code_rows),
lines AS (SELECT * FROM elements)"""



def _filled_sql(template: str) -> str:
    parts = re.split("«(doc|id)»", template)
    quoted = lambda p: " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in p.split("\n"))
    return " || ".join({"doc": "doc", "id": "doc_id"}[p] if i % 2 else quoted(p) for i, p in enumerate(parts))


ORACLES = {
    "keyword_combos": f"""WITH l AS (SELECT string_split_regex(text, '[ \\t\\n\\r\\f]+') AS l FROM benchmark),
w AS (SELECT word FROM (SELECT unnest(l) AS word FROM l) WHERE word <> ''), k AS ({top_words_sql('w', KEYWORDS, first_id='0')})
SELECT a.token || ' ' || b.token || ' ' || c.token AS query FROM k a JOIN k b ON a.idx < b.idx JOIN k c ON b.idx < c.idx""",
    "repo_names": "SELECT DISTINCT 'owner/' || source AS repo FROM documents",
    "repo_filter": f"WITH {_STARS} SELECT DISTINCT 'owner/' || source AS repo FROM documents WHERE 'owner/' || source NOT IN (SELECT repo FROM stars WHERE stars < 2)",
    "branch_fallback": """WITH f AS (SELECT 'repo/' || doc_id AS repo, CASE WHEN lang IN ('en', 'fr') THEN 'master' WHEN lang = 'de' THEN 'main' END AS branch,
  'src/F' || doc_id || CASE WHEN n_chars % 2 = 0 THEN '.java' ELSE '.md' END AS path FROM documents),
files AS (SELECT repo, branch, 1 AS file_no, path FROM f WHERE branch IS NOT NULL AND path LIKE '%.java'
          UNION ALL SELECT repo, branch, 2, 'src/Main.java' FROM f WHERE branch IS NOT NULL)
SELECT repo, branch, file_no, path, 'blob/' || path AS url FROM files UNION ALL SELECT repo, 'none', -1, 'none', 'none' FROM f WHERE branch IS NULL""",
    "name_list": "SELECT DISTINCT 'owner/' || source AS repo FROM documents",
    "blob_decode": "SELECT doc_id, CAST(octet_length(encode(text)) AS INTEGER) AS n, md5(text) AS digest FROM documents",
    "language_vote": f"""WITH e AS (SELECT 'owner/' || source AS repo, doc_id // 100 AS file_no, doc_id % 100 AS method_no,
  CASE WHEN n_chars % 97 = 0 THEN 'err' WHEN n_chars % 3 <> 0 THEN 'nodoc' WHEN lang = '{WANTED}' THEN 'match' ELSE 'other' END AS kind FROM documents),
{_vote('e', STREAK)} SELECT repo, verdict FROM verdicts""",
    "language_id": f"WITH {_PROFILE}, {_detected('documents', 'doc_id')} SELECT doc_id, coalesce(detected, 'none') AS detected FROM documents LEFT JOIN detected_documents USING (doc_id)",
    "language_accuracy": f"""WITH {_profile(f"{uniform_sql(HALF, 'doc_id')} < 0.5")}, {_detected('documents', 'doc_id')}
SELECT lang, count(*) AS texts, round(avg(CASE WHEN detected = lang THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy
FROM documents LEFT JOIN detected_documents USING (doc_id) WHERE {uniform_sql(HALF, 'doc_id')} >= 0.5 GROUP BY lang""",
    "doc_methods": f"WITH {CODE_CTE} SELECT 'owner/' || source AS repo, doc_id AS file_no, 0 AS method_no, doc, method AS code FROM code_rows",
    "doc_method_shapes": f"WITH {CODE_CTE} "
    + " UNION ALL ".join(
        f"SELECT 'owner/' || source AS repo, doc_id AS file_no, {n} AS method_no, {'doc' if has_doc else chr(39) + 'none' + chr(39)} AS doc, "
        f"{_filled_sql(method)} AS code FROM code_rows"
        for n, (method, has_doc) in enumerate(SHAPE_METHODS)
    ),
    "doc_function_pairs": f"""WITH {_LINES}, {_PROFILE}, {_grams('summary', 'elements')}, {_detected('elements', 'doc_id')}
SELECT repo, doc_id AS file_no, 0 AS method_no, summary AS docstring_summary,
  array_to_string(regexp_extract_all(summary, '[\\p{{L}}\\p{{N}}_]+'), ' ') AS docstring_tokens, {strip_sql('method')} AS function
FROM elements JOIN detected_elements USING (doc_id) WHERE detected = '{WANTED}' AND regexp_matches(summary, '[\\p{{L}}\\p{{N}}_]')""",
    "repository_selection": f"""WITH {_LINES}, {_PROFILE}, {_grams('doc_text', 'lines')}, {_detected('lines', 'doc_id')}, {_STARS},
e AS (SELECT repo, doc_id AS file_no, 0 AS method_no, CASE WHEN detected = '{WANTED}' THEN 'match' ELSE 'other' END AS kind FROM lines LEFT JOIN detected_lines USING (doc_id)),
{_vote('e', 500)}
SELECT DISTINCT 'owner/' || source AS repo FROM documents WHERE 'owner/' || source NOT IN (SELECT repo FROM stars WHERE stars < 2)
  AND 'owner/' || source NOT IN (SELECT repo FROM verdicts WHERE verdict = 'drop')""",
}
