"""Word counts, learned merges, vocabulary merging and embedding tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.common import SEED, documents, table, top_words_sql, uniform_sql, words_cte
from corpusloom.functions.text import byte_level_words, from_byte_letters, surface, to_byte_letters
from corpusloom.operators import learn
from corpusloom.operators import vocab as v
from corpusloom.plans import adaptation
from corpusloom.sources.stage import staged

SOURCE_WORDS, TARGET_WORDS, LEARNED_WORDS, MERGES = 6_000, 8_000, 10_000, 300
#: Merges of the learning queries: as many as one SQL statement may nest, and a whole vocabulary.
LEARNED_MERGES, WHOLE_MERGES = 480, 2_000
#: Merges of the source tokenizer.
SOURCE_MERGES = 100
DIM = 64


def counts_by_side(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts of the source language (``en``) and of the others."""
    docs = documents(spark, folder, walk=True).withColumn("side", F.when(F.col("lang") == "en", "source").otherwise("target"))
    return staged(v.word_counts(docs, by=["side"]), "counts")


def vocabularies(spark: SparkSession, folder: str, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``source`` (letters and English words), ``target`` (words of the other languages) and ``learned`` tokens.

    Both sides number their tokens from 4, so ids clash as those of two real tokenizers do. The letter ``ê`` stands for
    bytes that cannot be decoded. ``counts`` are those by side, where they are known already.
    """
    counts = counts_by_side(spark, folder) if counts is None else counts
    side = lambda name: counts.where(F.col("side") == name)
    target = staged(v.word_vocab(side("target").where(F.length("word") > 1), TARGET_WORDS), "target")
    top = staged(v.word_vocab(side("source").where(F.length("word") > 1), SOURCE_WORDS), "top")
    source = adaptation.base_vocabulary(top, target.select("token").unionByName(top.select("token")))
    readable = F.translate("token", "ê", "�")
    both = counts.groupBy("word").agg(F.sum("n").alias("n"))
    learned = v.word_vocab(both, LEARNED_WORDS)
    return (
        staged(source.withColumn("string", readable), "source"),
        target.select("token", "idx").withColumn("string", readable),
        staged(learned.select("token", "idx"), "learned"),
    )


def source_merges(spark: SparkSession, folder: str, counts: DataFrame | None = None) -> list[tuple[str, str, int]]:
    """The merges of the source tokenizer, learned from English words."""
    counts = counts_by_side(spark, folder) if counts is None else counts
    return learn.learn_merges(counts.where(F.col("side") == "source").select("word", "n"), SOURCE_MERGES)[0]


def merged(spark: SparkSession, folder: str) -> DataFrame:
    source, target, _ = vocabularies(spark, folder)
    return staged(v.merge_vocabularies(source, target), "merged")


def word_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return v.word_vocab(v.word_counts(documents(spark, folder, walk=True)), TARGET_WORDS)


def _learned(spark: SparkSession, folder: str, merges: int) -> DataFrame:
    counts = v.word_counts(documents(spark, folder, walk=True))
    return learn.merge_table(spark, learn.learn_merges(counts, merges)[0])


def vocab_learn(spark: SparkSession, folder: str) -> DataFrame:
    return _learned(spark, folder, LEARNED_MERGES)


def vocab_learn_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Two thousand merges, beyond what SQL can learn; tests hold them against one at a time."""
    return _learned(spark, folder, WHOLE_MERGES)


def byte_level_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level words of the conversations: distinct tokens with their readable strings."""
    talk = table(spark, folder, "conversations")
    tokens = talk.select(F.explode(byte_level_words(F.col("text"))).alias("token"))
    counted = tokens.groupBy("token").agg(F.count("*").alias("n"))
    return counted.select(from_byte_letters(F.col("token")).alias("string"), "n")


def token_surface(spark: SparkSession, folder: str) -> DataFrame:
    """All words as byte-level tokens, and their prefixes, which may end inside a character."""
    words = v.word_counts(documents(spark, folder, walk=True)).select(to_byte_letters(F.col("word")).alias("letters"))
    ends = words.select("letters", F.explode(F.sequence(F.lit(1), F.length("letters"))).alias("end"))
    tokens = ends.select(F.substring("letters", F.lit(1), F.col("end")).alias("token")).distinct()
    return tokens.select("token", surface(F.col("token")).alias("string"))


def vocab_merge(spark: SparkSession, folder: str) -> DataFrame:
    return merged(spark, folder).select("token", "idx", "string", "origin")


def vocab_slots(spark: SparkSession, folder: str) -> DataFrame:
    return v.reassign_slots(merged(spark, folder)).select("token", "idx", "origin").orderBy("idx")


def vocab_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    vocab = merged(spark, folder)
    parts = {"duplicate": v.duplicate_ids(vocab), "free": v.free_ids(vocab, vocab.count())}
    return parts["duplicate"].withColumn("kind", F.lit("duplicate")).unionByName(parts["free"].withColumn("kind", F.lit("free")))


def vocab_training_strings(spark: SparkSession, folder: str) -> DataFrame:
    slotted = v.reassign_slots(merged(spark, folder))
    return v.training_strings(slotted, SOURCE_WORDS, 100, 10)


def vocab_sets(spark: SparkSession, folder: str) -> DataFrame:
    source, target, learned = vocabularies(spark, folder)
    kept, dropped, missing = v.match_learned(staged(v.merge_vocabularies(source, target), "merged"), learned)
    parts = {"kept": kept, "dropped": dropped, "missing": missing}
    tagged = [part.select("token", F.lit(kind).alias("kind")) for kind, part in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def vocab_adapt(spark: SparkSession, folder: str) -> DataFrame:
    return adaptation.adapt(*vocabularies(spark, folder)).select("token", "idx", "origin")


def vocab_origin_counts(spark: SparkSession, folder: str) -> DataFrame:
    return v.origin_counts(adaptation.adapt(*vocabularies(spark, folder)))


def source_id_list(spark: SparkSession, folder: str) -> DataFrame:
    return v.source_ids(v.reassign_slots(merged(spark, folder)))


def in_long_form(df: DataFrame, key: str, vector: str = "embedding", digits: int = 6) -> DataFrame:
    cells = df.select(key, F.posexplode(vector).alias("dim", "x"))
    return cells.select(key, "dim", (F.round(F.col("x").cast("double"), digits) + F.lit(0.0)).alias("x"))


def _embedded(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as a vocabulary: label 0 is source, the rest target."""
    origin = F.when(F.col("label") == 0, v.SOURCE).otherwise(v.TARGET)
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("idx"), "embedding", origin.alias("origin"))


def embedding_overlay(spark: SparkSession, folder: str) -> DataFrame:
    vocab = _embedded(spark, folder)
    doubled = vocab.withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    return in_long_form(v.overlay(vocab.select("idx", "embedding"), doubled), "idx")


def piece_mean(spark: SparkSession, folder: str) -> DataFrame:
    vocab = _embedded(spark, folder)
    # Three pieces per token: the token's own row and the rows of ids derived from it.
    pieces = vocab.select(
        F.col("idx").alias("token"), F.array("idx", F.expr("idx div 2"), F.expr("idx div 3")).alias("pieces")
    )
    return in_long_form(v.piece_mean(pieces, vocab), "token")


def random_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return in_long_form(v.with_random_vectors(_embedded(spark, folder), DIM, SEED), "idx", digits=4)


QUERIES = {
    "word_vocab": word_vocab,
    "vocab_learn": vocab_learn,
    "vocab_learn_whole": vocab_learn_whole,
    "byte_level_tokens": byte_level_tokens,
    "token_surface": token_surface,
    "vocab_merge": vocab_merge,
    "vocab_slots": vocab_slots,
    "vocab_duplicates": vocab_duplicates,
    "vocab_training_strings": vocab_training_strings,
    "vocab_sets": vocab_sets,
    "vocab_adapt": vocab_adapt,
    "vocab_origin_counts": vocab_origin_counts,
    "source_id_list": source_id_list,
    "embedding_overlay": embedding_overlay,
    "piece_mean": piece_mean,
    "random_vectors": random_vectors,
}

# SQL ------------------------------------------------------------------------------------------------------------------

VOCAB_CTE = f"""{words_cte()},
target_top AS ({top_words_sql('w', TARGET_WORDS, where="lang <> 'en' AND length(word) > 1")}),
source_top AS ({top_words_sql('w', SOURCE_WORDS, where="lang = 'en' AND length(word) > 1")}),
letters AS (SELECT DISTINCT unnest(string_split(token, '')) AS token
            FROM (SELECT token FROM target_top UNION ALL SELECT token FROM source_top)),
alphabet AS (SELECT token, row_number() OVER (ORDER BY token) - 1 + 4 AS idx FROM letters WHERE token <> ''),
source AS (
  SELECT token, CAST(idx AS INTEGER) AS idx, translate(token, 'ê', '�') AS string FROM alphabet
  UNION ALL SELECT token, CAST(idx + (SELECT count(*) FROM alphabet) AS INTEGER), translate(token, 'ê', '�') FROM source_top),
target AS (SELECT token, idx, translate(token, 'ê', '�') AS string FROM target_top),
learned AS (SELECT token, idx FROM ({top_words_sql('w', LEARNED_WORDS)})),
merged AS (
  SELECT token, coalesce(s.idx, t.idx) AS idx, coalesce(s.string, t.string) AS string,
         CASE WHEN s.idx IS NOT NULL THEN 'source_lang' ELSE 'target_lang' END AS origin
  FROM source s FULL JOIN target t USING (token) WHERE NOT contains(coalesce(s.string, t.string), '�')),
dup AS (SELECT idx, row_number() OVER (ORDER BY idx) AS r FROM (SELECT idx FROM merged GROUP BY idx HAVING count(*) > 1)),
gap AS (SELECT i AS new_idx, row_number() OVER (ORDER BY i) AS r
        FROM (SELECT unnest(range((SELECT count(*) FROM merged))) AS i) WHERE i NOT IN (SELECT idx FROM merged)),
moves AS (SELECT idx, new_idx FROM dup JOIN gap USING (r)),
slotted AS (
  SELECT token, CAST(CASE WHEN origin = 'target_lang' THEN coalesce(new_idx, idx) ELSE idx END AS INTEGER) AS idx, string, origin
  FROM merged LEFT JOIN moves USING (idx))"""

ADAPT_STEPS = """
kept AS (SELECT * FROM slotted WHERE token IN (SELECT token FROM learned)),
missing AS (SELECT token, row_number() OVER (ORDER BY idx) AS r FROM learned WHERE token NOT IN (SELECT token FROM slotted)),
size AS (SELECT count(*) AS n FROM learned),
free AS (SELECT i, row_number() OVER (ORDER BY i) AS r FROM (SELECT unnest(range((SELECT n FROM size))) AS i)
         WHERE i NOT IN (SELECT idx FROM kept)),
filled AS (SELECT token, idx, origin FROM kept
           UNION ALL SELECT token, CAST(i AS INTEGER), 'helper' FROM missing JOIN free USING (r)),
over_ids AS (SELECT idx, row_number() OVER (ORDER BY idx) AS r FROM filled WHERE idx >= (SELECT n FROM size)),
last_free AS (SELECT i, row_number() OVER (ORDER BY i DESC) AS r FROM (SELECT unnest(range((SELECT n FROM size))) AS i)
              WHERE i NOT IN (SELECT idx FROM filled)),
adapted AS (SELECT token, CAST(coalesce(i, idx) AS INTEGER) AS idx, origin
            FROM filled LEFT JOIN (SELECT idx, i FROM over_ids JOIN last_free USING (r)) USING (idx))"""
ADAPT_CTE = f"{VOCAB_CTE}, {ADAPT_STEPS}"


def learn_cte(merges: int = MERGES, words: str = words_cte(), of: str = "w") -> str:
    """``w0 … wN`` (word, n, spelling) and ``t1 … tN`` (the merge of each round), one round after the other."""
    parts = [
        words,
        r"w0 AS MATERIALIZED (SELECT word, count(*) AS n, regexp_replace(word, '((?s:.))', '<\1>', 'g') AS s "
        "FROM (SELECT replace(replace(word, '<', chr(4)), '>', chr(5)) AS word "
        f"FROM {of}) GROUP BY word)",
    ]
    for i in range(1, merges + 1):
        parts.append(f"""t{i} AS MATERIALIZED (
  SELECT l, r, sum(n) AS c FROM (
    SELECT n, unnest(p[1:len(p) - 1]) AS l, unnest(p[2:len(p)]) AS r
    FROM (SELECT n, string_split(s[2:length(s) - 1], '><') AS p FROM w{i - 1}) WHERE len(p) > 1)
  GROUP BY l, r ORDER BY c DESC, l, r LIMIT 1)""")
        parts.append(
            f"w{i} AS MATERIALIZED (SELECT word, n, replace(s, '<' || l || '><' || r || '>', '<' || l || r || '>') AS s FROM w{i - 1}, t{i})"
        )
    return ", ".join(parts)


#: Fixed: the public byte-level split, without its lookahead.
BYTE_LEVEL_SQL = r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"


def byte_letters_sql(word: str) -> str:
    """A list of one printable letter per byte."""
    byte = f"CAST('0x' || substr(hex(encode({word})), CAST(2 * i - 1 AS BIGINT), 2) AS INTEGER)"
    letter = "chr(CASE WHEN x < 33 THEN 256 + x WHEN x BETWEEN 127 AND 160 THEN 162 + x WHEN x = 173 THEN 323 ELSE x END)"
    return f"list_transform(list_transform(range(1, strlen({word}) + 1), lambda i: {byte}), lambda x: {letter})"


def readable(column: str) -> str:
    return f"replace(replace({column}, chr(4), '<'), chr(5), '>')"


ORACLES = {
    "word_vocab": f"WITH {words_cte()} {top_words_sql('w', TARGET_WORDS)}",
    "vocab_learn": f"WITH {learn_cte(LEARNED_MERGES)} "
    + " UNION ALL ".join(
        f"SELECT {i - 1} AS rank, {readable('l')} AS left, {readable('r')} AS right, CAST(c AS BIGINT) AS n FROM t{i}" for i in range(1, LEARNED_MERGES + 1)
    ),
    "byte_level_tokens": f"""WITH t AS (
  SELECT unnest(regexp_extract_all(text, '{BYTE_LEVEL_SQL}')) AS string FROM conversations)
SELECT string, count(*) AS n FROM t GROUP BY string""",
    "token_surface": f"""WITH {words_cte()},
b AS (SELECT word, list_transform(range(1, strlen(word) + 1), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i - 1 AS BIGINT), 2) AS INTEGER)) AS bytes
      FROM (SELECT DISTINCT word FROM w)),
l AS (SELECT word, list_transform(bytes, lambda x: chr(CASE WHEN x < 33 THEN 256 + x WHEN x BETWEEN 127 AND 160 THEN 162 + x WHEN x = 173 THEN 323 ELSE x END)) AS letters,
             list_transform(bytes, lambda x: x < 128 OR x >= 192) AS begins FROM b),
k AS (SELECT *, unnest(range(1, len(letters) + 1)) AS k FROM l),
p AS (SELECT array_to_string(letters[1:k], '') AS token, word, len(list_filter(begins[1:k], lambda x: x)) AS chars, k = len(letters) OR begins[k + 1] AS whole FROM k),
s AS (SELECT token, CASE WHEN whole THEN left(word, chars) ELSE left(word, chars - 1) || '�' END AS string FROM p)
SELECT DISTINCT token, CASE WHEN string = '�' THEN token ELSE string END AS string FROM s""",
    "vocab_merge": f"WITH {VOCAB_CTE} SELECT token, idx, string, origin FROM merged",
    "vocab_slots": f"WITH {VOCAB_CTE} SELECT token, idx, origin FROM slotted",
    "vocab_duplicates": f"WITH {VOCAB_CTE} SELECT idx, 'duplicate' AS kind FROM dup UNION ALL SELECT CAST(new_idx AS INTEGER), 'free' FROM gap",
    "vocab_training_strings": f"WITH {VOCAB_CTE} SELECT idx, string FROM slotted ORDER BY idx LIMIT {SOURCE_WORDS + 110}",
    "vocab_sets": f"""WITH {VOCAB_CTE}
SELECT token, 'kept' AS kind FROM merged WHERE token IN (SELECT token FROM learned)
UNION ALL SELECT token, 'dropped' FROM merged WHERE token NOT IN (SELECT token FROM learned)
UNION ALL SELECT token, 'missing' FROM learned WHERE token NOT IN (SELECT token FROM merged)""",
    "vocab_adapt": f"WITH {ADAPT_CTE} SELECT token, idx, origin FROM adapted",
    "vocab_origin_counts": f"WITH {ADAPT_CTE} SELECT origin, count(*) AS n FROM adapted GROUP BY origin",
    "source_id_list": f"WITH {VOCAB_CTE} SELECT idx FROM slotted WHERE origin = 'source_lang'",
    "embedding_overlay": """SELECT idx, dim, round(CAST(x * (CASE WHEN label = 0 THEN 1 ELSE 2 END) AS DOUBLE), 6) + 0.0 AS x FROM (
  SELECT vec_id AS idx, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)""",
    "piece_mean": """WITH p AS (SELECT vec_id AS token, unnest([vec_id, vec_id // 2, vec_id // 3]) AS idx FROM embeddings),
e AS (SELECT vec_id AS idx, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
SELECT token, dim, round(avg(CAST(x AS DOUBLE)), 6) + 0.0 AS x FROM p JOIN e USING (idx) GROUP BY token, dim""",
    "random_vectors": f"""WITH e AS (
  SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
SELECT vec_id AS idx, i - 1 AS dim, round(CAST(CAST(CASE WHEN label = 0 THEN x ELSE
  sqrt(2.0 / {DIM}) * sqrt(-2 * ln(1 - {uniform_sql(f'{SEED}r', 'vec_id', 'i')})) * cos(2 * pi() * {uniform_sql(f'{SEED}a', 'vec_id', 'i')}) END AS FLOAT) AS DOUBLE), 4) + 0.0 AS x
FROM e""",
}
