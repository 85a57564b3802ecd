"""Tables and SQL fragments that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.readers import spread

SEED = 7


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, walk: bool = False) -> DataFrame:
    """The documents; ``walk=True`` for jobs that work through every text."""
    df = table(spark, folder, "documents")
    return spread(df) if walk else df


def joined(values: Column) -> Column:
    """An array as text, for comparison between engines."""
    return F.array_join(values, ",")


def one_line(text: str = "text") -> Column:
    """The whole text with its line ends as blanks, and without the end of a comment."""
    return F.replace(F.translate(text, "\n\r", "  "), F.lit("*/"), F.lit("* /"))


def code_rows(docs: DataFrame) -> DataFrame:
    """Java-like sources made of the whole documents: one class with one documented method per document."""
    line = one_line()
    doc = F.concat(F.lit("/**\n * "), line, F.lit("\n */"))
    method = F.concat(
        F.lit("public int f"), F.col("doc_id").cast("string"), F.lit("(int a) {\n  // "), F.col("source"),
        F.lit("\n  if (a > 0) { return \"} // keep\".length(); } /* "), F.col("lang"),
        F.lit(" */\n\n  return '}' + a;\n}"),
    )
    source = F.concat(F.lit("class C {\n"), doc, F.lit("\n"), method, F.lit("\n}\n"))
    return docs.select("doc_id", "lang", "source", line.alias("line"), doc.alias("doc"), method.alias("method"), source.alias("code"))


# SQL ------------------------------------------------------------------------------------------------------------------

BLANK_SQL = (
    r"\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def ink_sql(column: str) -> str:
    return f"regexp_matches({column}, '[^{BLANK_SQL}]')"


WORD_LIST_SQL = r"list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda w: w <> '')"


def draw_sql(seed: int | str, *keys: str) -> str:
    return "md5(concat_ws(':', '" + str(seed) + "', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + "))"


def uniform_sql(seed: int | str, *keys: str, part: int = 0) -> str:
    return f"(CAST(('0x' || substr({draw_sql(seed, *keys)}, {8 * part + 1}, 8)) AS BIGINT) / 4294967296.0)"


def order_sql(seed: int | str, *keys: str) -> str:
    return f"CAST(('0x' || substr({draw_sql(seed, *keys)}, 1, 15)) AS BIGINT)"


def words_cte(where: str = "true", name: str = "w") -> str:
    """``w(doc_id, lang, pos, word)``."""
    return (
        f"{name}_l AS (SELECT doc_id, lang, {WORD_LIST_SQL} AS l FROM documents WHERE {where}), "
        f"{name} AS (SELECT doc_id, lang, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM {name}_l)"
    )


def top_words_sql(words: str, size: int, first_id: str = "4", where: str = "true") -> str:
    """``token, idx, n`` of the most frequent words."""
    return (
        f"SELECT word AS token, CAST(row_number() OVER (ORDER BY n DESC, word) - 1 + {first_id} AS INTEGER) AS idx, n "
        f"FROM (SELECT word, count(*) AS n FROM {words} WHERE {where} GROUP BY word ORDER BY n DESC, word LIMIT {size})"
    )


ONE_LINE_SQL = "replace(translate(text, chr(10) || chr(13), '  '), '*/', '* /')"

CODE_CTE = f"""code_parts AS (
  SELECT doc_id, lang, source, {ONE_LINE_SQL} AS line,
         '/**' || chr(10) || ' * ' || {ONE_LINE_SQL} || chr(10) || ' */' AS doc,
         'public int f' || doc_id || '(int a) {{' || chr(10) || '  // ' || source || chr(10)
         || '  if (a > 0) {{ return "}} // keep".length(); }} /* ' || lang || ' */' || chr(10) || chr(10)
         || '  return ''}}'' + a;' || chr(10) || '}}' AS method
  FROM documents),
code_rows AS (
  SELECT *, 'class C {{' || chr(10) || doc || chr(10) || method || chr(10) || '}}' || chr(10) AS code FROM code_parts)"""

LITERAL_OR_COMMENT_SQL = (
    r"""(''(?:\\(?s:.)|[^\\''])*''|"(?:\\(?s:.)|[^\\"])*")|//[^\n]*|/\*(?s:.)*?\*/"""
)


def strip_sql(code: str) -> str:
    marked = f"regexp_replace({code}, '{LITERAL_OR_COMMENT_SQL}', chr(2) || '\\1' || chr(1), 'g')"
    bare = f"replace(replace(replace({marked}, chr(2) || chr(1), ' '), chr(2), ''), chr(1), '')"
    return f"array_to_string(list_filter(string_split({bare}, chr(10)), lambda x: {ink_sql('x')}), chr(10))"
