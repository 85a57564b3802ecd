"""Whole adaptation of a vocabulary, its embedding table, and tokenizer files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.common import SEED, joined, table, uniform_sql
from corpusloom.catalog.vocabularies import (
    ADAPT_STEPS, BYTE_LEVEL_SQL, DIM, MERGES, SOURCE_WORDS, VOCAB_CTE, byte_letters_sql, in_long_form, learn_cte, readable, vocabularies,
)
from corpusloom.functions.text import byte_level_words
from corpusloom.operators import encode, learn
from corpusloom.plans import adaptation
from corpusloom.sources import tokenizer
from corpusloom.sources.stage import new_folder, staged

#: New tokens asked for.
NEW_WORDS = 1000


def _with_vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Source and target vocabularies; a token has the vector of its id modulo their number, a target token twice that."""
    source, target, _ = vocabularies(spark, folder)
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("at"), "embedding")
    rows = vectors.count()
    placed = lambda vocab: vocab.withColumn("at", F.pmod("idx", F.lit(rows))).join(vectors, "at", "left").drop("at")
    doubled = placed(target).withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    return staged(placed(source), "source"), staged(doubled, "target")


def adaptation_job(spark: SparkSession, folder: str) -> DataFrame:
    """From two vocabularies to the adapted one: strings, merges, kept tokens, helpers, ids."""
    source, target, _ = vocabularies(spark, folder)
    adapted, _ = adaptation.adapted_tokenizer(source, target, SOURCE_WORDS, NEW_WORDS, MERGES)
    return adapted.select("token", "idx", "origin")


def adaptation_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The embedding table of the adapted vocabulary, helpers included."""
    source, target = _with_vectors(spark, folder)
    adapted, _ = adaptation.adapted_tokenizer(source, target, SOURCE_WORDS, NEW_WORDS, MERGES)
    base = source.select("idx", "embedding")
    return in_long_form(adaptation.embedding_table(base, staged(adapted, "adapted"), source, DIM, SEED), "idx", digits=4)


def _byte_level(spark: SparkSession, folder: str) -> tuple[DataFrame, list[tuple]]:
    """A byte-level tokenizer of the conversations, written as files and read back."""
    talk = table(spark, folder, "conversations")
    words = talk.select(F.explode(byte_level_words(F.col("text"))).alias("word"))
    counts = staged(words.groupBy("word").agg(F.count("*").alias("n")), "counts")
    merges, _ = learn.learn_merges(counts, MERGES)
    path = new_folder(spark, "tokenizer")
    tokenizer.save_tokenizer(learn.learned_tokens(counts, merges), merges, path)
    return tokenizer.read_vocabulary(spark, f"{path}/vocab"), tokenizer.read_merges(spark, f"{path}/merges")


def tokenizer_files(spark: SparkSession, folder: str) -> DataFrame:
    vocab, merges = _byte_level(spark, folder)
    rules = spark.createDataFrame([(i, f"{left} {right}") for i, (left, right) in enumerate(merges)], "idx int, value string")
    tokens = vocab.select("idx", F.col("token").alias("value"), F.lit("token").alias("kind"))
    return tokens.unionByName(rules.withColumn("kind", F.lit("merge")))


def encode_byte_level(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn as ids of the tokenizer that the files hold."""
    vocab, merges = _byte_level(spark, folder)
    talk = table(spark, folder, "conversations").withColumn("turn_key", F.struct("conv_id", "turn"))
    tokens = {row["token"]: row["idx"] for row in vocab.collect()}
    rows = encode.encode_byte_level(talk, "turn_key", "text", merges, tokens)
    return rows.select("turn_key.conv_id", "turn_key.turn", joined(F.col("input_ids")).alias("input_ids"))


QUERIES = {f.__name__: f for f in (adaptation_job, adaptation_vectors, tokenizer_files, encode_byte_level)}

# SQL ------------------------------------------------------------------------------------------------------------------


def _learned_cte(of: str, merges: int = MERGES) -> str:
    """``tokens(token, idx)``: the letters of the words, then what each merge made, the first of equal ones."""
    made = " UNION ALL ".join(f"SELECT {i} AS place, {readable('l || r')} AS token FROM t{i}" for i in range(1, merges + 1))
    return f"""made AS ({made}),
signs AS (SELECT token, row_number() OVER (ORDER BY token) - 1000000000 AS place
          FROM (SELECT DISTINCT unnest(string_split(word, '')) AS token FROM {of}) WHERE token <> ''),
firsts AS (SELECT token, min(place) AS place FROM (SELECT token, place FROM signs UNION ALL SELECT token, place FROM made) GROUP BY token),
tokens AS (SELECT token, CAST(row_number() OVER (ORDER BY place) + 3 AS INTEGER) AS idx FROM firsts)"""


_STRINGS = f"""{VOCAB_CTE},
strings AS (SELECT string FROM slotted ORDER BY idx LIMIT {SOURCE_WORDS + NEW_WORDS + 10}),
sw AS (SELECT word FROM (SELECT unnest(string_split_regex(string, '[ \\t\\n\\r\\f]+')) AS word FROM strings) WHERE word <> '')"""
_ADAPTED = f"{learn_cte(words=_STRINGS, of='sw')}, {_learned_cte('sw')}, {ADAPT_STEPS.replace('FROM learned', 'FROM tokens')}"

_TALK = f"""talk_l AS (SELECT conv_id, turn, regexp_extract_all(text, '{BYTE_LEVEL_SQL}') AS l FROM conversations),
talk AS (SELECT conv_id, turn, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM talk_l),
raws AS (SELECT raw, array_to_string({byte_letters_sql('raw')}, '') AS word FROM (SELECT DISTINCT raw FROM talk)),
talk_w AS (SELECT conv_id, turn, pos, word FROM talk JOIN raws USING (raw))"""
_TOKENIZER = f"{learn_cte(words=_TALK, of='talk_w')}, {_learned_cte('talk_w')}"
_DRAWN = f"""sqrt(2.0 / {DIM}) * sqrt(-2 * ln(1 - {uniform_sql(f'{SEED}r', 'r.idx', '(r.dim + 1)')}))
  * cos(2 * pi() * {uniform_sql(f'{SEED}a', 'r.idx', '(r.dim + 1)')})"""

ORACLES = {
    "adaptation_job": f"WITH {_ADAPTED} SELECT token, idx, origin FROM adapted",
    "adaptation_vectors": f"""WITH {_ADAPTED},
cells AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
many AS (SELECT count(*) AS m FROM embeddings),
base AS (SELECT idx, dim, CAST(x AS DOUBLE) AS x FROM source, many JOIN cells ON vec_id = idx % m),
goal AS (SELECT a.token, a.idx, a.origin, t.idx AS old FROM adapted a LEFT JOIN target t USING (token)),
spelled AS (SELECT idx, unnest(CASE WHEN token IN (SELECT token FROM source) THEN [token] ELSE string_split(token, '') END) AS token
            FROM goal WHERE origin = 'helper'),
own AS (
  SELECT idx, dim, 2 * CAST(x AS DOUBLE) AS x FROM goal, many JOIN cells ON vec_id = old % m WHERE origin = 'target_lang'
  UNION ALL SELECT p.idx, dim, avg(x) FROM spelled p JOIN source s USING (token) JOIN base b ON b.idx = s.idx GROUP BY p.idx, dim),
grid AS (SELECT idx, unnest(range({DIM})) AS dim FROM adapted)
SELECT r.idx, CAST(r.dim AS INTEGER) AS dim, round(CAST(CAST(coalesce(o.x, b.x, {_DRAWN}) AS FLOAT) AS DOUBLE), 4) + 0.0 AS x
FROM grid r LEFT JOIN own o USING (idx, dim) LEFT JOIN base b USING (idx, dim)""",
    "tokenizer_files": f"WITH {_TOKENIZER} SELECT idx, token AS value, 'token' AS kind FROM tokens UNION ALL "
    + " UNION ALL ".join(f"SELECT {i - 1}, {readable('l')} || ' ' || {readable('r')}, 'merge' FROM t{i}" for i in range(1, MERGES + 1)),
    "encode_byte_level": f"""WITH {_TOKENIZER},
pieces AS (SELECT {readable('word')} AS word, string_split(s[2:length(s) - 1], '><') AS p FROM w{MERGES}),
parts AS (SELECT word, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM pieces),
ids AS (SELECT conv_id, turn, pos, k, idx FROM talk_w JOIN parts USING (word) JOIN tokens ON {readable('part')} = token)
SELECT conv_id, turn, '0,' || coalesce(string_agg(idx, ',' ORDER BY pos, k) || ',', '') || '2' AS input_ids
FROM conversations LEFT JOIN ids USING (conv_id, turn) GROUP BY conv_id, turn""",
}
