"""Encoding, source shares, substitution, packing, padding and masking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog.common import SEED, documents, draw_sql, ink_sql, joined, order_sql, table, top_words_sql, words_cte
from corpusloom.catalog.vocabularies import ADAPT_CTE, MERGES, SOURCE_MERGES, counts_by_side, learn_cte, source_merges, vocabularies
from corpusloom.functions.text import words
from corpusloom.functions.tokens import SEPARATOR_ID, keep_last, unmask
from corpusloom.operators import encode, learn, mask, pack, substitute
from corpusloom.operators import vocab as v
from corpusloom.operators.index import row_index
from corpusloom.plans import adaptation, masked_lm, substitution
from corpusloom.sources import readers, writers
from corpusloom.sources.stage import new_folder, staged

VOCAB, LENGTH, CHUNK, WANTED, BATCH = 20_000, 512, 128, 0.85, 100
EVAL_ROWS = 20
MASK_ID = 4
#: Where texts are joined by the separator, whose id is that of an unknown word elsewhere.
TALK_UNKNOWN, TALK_FIRST = 5, 6


def encoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as ids of the most frequent words, with masks."""
    docs = documents(spark, folder, walk=True)
    vocab = staged(v.word_vocab(v.word_counts(docs), VOCAB), "vocab")
    return encode.encode(docs, "doc_id", "text", vocab)


def encode_words(spark: SparkSession, folder: str) -> DataFrame:
    rows = encoded(spark, folder)
    return rows.select("doc_id", *[joined(F.col(c)).alias(c) for c in rows.columns if c != "doc_id"])


def encode_merges(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder, walk=True)
    counts = staged(v.word_counts(docs), "counts")
    merges, _ = learn.learn_merges(counts, MERGES)
    pieces = encode.segment_words(words(F.col("text")), merges)
    return docs.select("doc_id", F.array_join(pieces, " ").alias("pieces"))


def adapted_rows(spark: SparkSession, folder: str, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents under the adapted vocabulary, that vocabulary, and the source vocabulary."""
    source, target, learned = vocabularies(spark, folder, counts)
    adapted = staged(adaptation.adapt(source, target, learned), "adapted")
    docs = documents(spark, folder, walk=True)
    return encode.encode(docs, "doc_id", "text", adapted), adapted, source


def source_ratio(spark: SparkSession, folder: str) -> DataFrame:
    rows, adapted, _ = adapted_rows(spark, folder)
    ids = staged(v.source_ids(adapted), "source-ids")
    return substitute.source_share(rows, "doc_id", ids).withColumn("source_ratio", F.round("source_ratio", 6))


def ratio_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows, adapted, _ = adapted_rows(spark, folder)
    ids = staged(v.source_ids(adapted), "source-ids")
    summary = substitute.share_summary(substitute.source_share(rows, "doc_id", ids))
    return summary.select("texts", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def ratio_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows, adapted, _ = adapted_rows(spark, folder)
    ids = staged(v.source_ids(adapted), "source-ids")
    return substitute.share_histogram(substitute.source_share(rows, "doc_id", ids))


def ratio_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    rows, adapted, _ = adapted_rows(spark, folder)
    ids = staged(v.source_ids(adapted), "source-ids")
    found = substitute.share_percentiles(substitute.source_share(rows, "doc_id", ids))
    return found.withColumn("source_ratio", F.round("source_ratio", 6))


def substitution_pieces(spark: SparkSession, folder: str) -> DataFrame:
    counts = counts_by_side(spark, folder)
    source, target, learned = vocabularies(spark, folder, counts)
    adapted = staged(adaptation.adapt(source, target, learned), "adapted")
    return adaptation.substitution_table(adapted, source, source_merges(spark, folder, counts)).select("idx", "is_source", joined(F.col("pieces")).alias("pieces"))


def substitute_tokens(spark: SparkSession, folder: str) -> DataFrame:
    counts = counts_by_side(spark, folder)
    rows, adapted, source = adapted_rows(spark, folder, counts)
    pieces = staged(adaptation.substitution_table(adapted, source, source_merges(spark, folder, counts)), "substitutes")
    out = substitute.substitute_tokens(rows, "doc_id", pieces, WANTED, SEED)
    fitted = substitute.fit_rows(out, LENGTH)
    return fitted.select("doc_id", "n_swapped", *[joined(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "special_tokens_mask")])


def pad_truncate(spark: SparkSession, folder: str) -> DataFrame:
    rows = substitute.fit_rows(encoded(spark, folder), LENGTH)
    return rows.select("doc_id", *[joined(F.col(c)).alias(c) for c in rows.columns if c != "doc_id"])


def truncate_keep_last(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(spark, folder).select("doc_id", joined(keep_last(F.col("input_ids"), 64)).alias("input_ids"))


def batch_pad(spark: SparkSession, folder: str) -> DataFrame:
    rows = encoded(spark, folder)
    numbers = row_index(documents(spark, folder).select("doc_id"), "doc_id")
    padded = pack.pad_batches(rows.join(numbers, "doc_id"), "row_idx", BATCH)
    return padded.select("doc_id", "batch", "width", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("attention_mask")).alias("attention_mask"))


def pack_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = staged(encoded(spark, folder).withColumn("n_tokens", F.size("input_ids")), "encoded")
    chunks = pack.pack_chunks(rows, "doc_id", CHUNK, ("input_ids", "attention_mask", "special_tokens_mask"), BATCH, size="n_tokens")
    return chunks.select("batch", "chunk", *[joined(F.col(c)).alias(c) for c in ("input_ids", "attention_mask", "special_tokens_mask")])


def mask_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = mask.mask_tokens(encoded(spark, folder), "doc_id", MASK_ID, VOCAB, seed=SEED)
    return rows.select("doc_id", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("labels")).alias("labels"))


def unmask_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = mask.mask_tokens(encoded(spark, folder), "doc_id", MASK_ID, VOCAB, seed=SEED)
    return rows.select("doc_id", joined(unmask(F.col("input_ids"), F.col("labels"))).alias("input_ids"))


def split_separator(spark: SparkSession, folder: str) -> DataFrame:
    """Question and answer of each turn pair, encoded around a separator, masked and split again; the answer of a last
    turn without one is empty."""
    talk = table(spark, folder, "conversations").withColumn("turn_key", F.struct("conv_id", "turn"))
    vocab = staged(v.word_vocab(v.word_counts(talk), VOCAB, first_id=TALK_FIRST), "vocab")
    turns = encode.word_ids(talk, "turn_key", "text", vocab, unknown=TALK_UNKNOWN)
    pair = F.concat_ws(":", "turn_key.conv_id", F.expr("turn_key.turn div 2")).alias("pair_id")
    half = lambda side: F.flatten(F.collect_list(F.when(F.col("turn_key.turn") % 2 == side, F.col("ids"))))
    pairs = turns.groupBy(pair).agg(F.concat(half(0), F.array(F.lit(SEPARATOR_ID)), half(1)).alias("ids"))
    split = mask.split_pair(mask.mask_tokens(encode.with_specials(pairs), "pair_id", MASK_ID, VOCAB, seed=SEED))
    shown = ("first_unmasked", "second_unmasked", "first_attention_mask", "second_attention_mask")
    return split.select("pair_id", *[joined(F.col(c)).alias(c) for c in shown]).fillna("none")


def _splits(docs: DataFrame) -> dict[str, DataFrame]:
    """Three fifths train, and a fifth each validation and test."""
    fifth = F.pmod("doc_id", F.lit(5))
    return {"train": docs.where(fifth < 3), "validation": docs.where(fifth == 3), "test": docs.where(fifth == 4)}


def substitution_job(spark: SparkSession, folder: str) -> DataFrame:
    """The whole job over a dataset saved by split: its result is saved by split too, and read back."""
    docs = documents(spark, folder, walk=True)
    counts = counts_by_side(spark, folder)
    source, target, learned = vocabularies(spark, folder, counts)
    adapted = staged(adaptation.adapt(source, target, learned), "adapted")
    pieces = staged(adaptation.substitution_table(adapted, source, source_merges(spark, folder, counts)), "substitutes")
    texts = writers.with_splits(_splits(docs.select("doc_id", "text")))
    path = new_folder(spark, "substituted")
    writers.save(substitution.substitution_job(texts, "doc_id", "text", adapted, pieces, WANTED, SEED, LENGTH), path)
    arrays = ("input_ids", "attention_mask", "special_tokens_mask")
    return readers.saved(spark, path).select("split", "doc_id", "n_swapped", *[joined(F.col(c)).alias(c) for c in arrays])


def _masked_lm(spark: SparkSession, folder: str, **options) -> DataFrame:
    docs = documents(spark, folder, walk=True)
    vocab = staged(v.word_vocab(v.word_counts(docs), VOCAB), "vocab")
    parts = {name: rows.select("doc_id", "text") for name, rows in _splits(docs).items() if name != "test"}
    rows = masked_lm.masked_lm_rows(parts, "doc_id", vocab, MASK_ID, VOCAB, CHUNK, batch_rows=BATCH, seed=SEED, **options)
    arrays = ("input_ids", "attention_mask", "special_tokens_mask", "labels")
    return rows.select("split", "row_no", *[joined(F.col(c)).alias(c) for c in arrays])


def masked_lm_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Masked rows of packed texts; the row limit of the validation split is part of the job."""
    return _masked_lm(spark, folder, most={"validation": EVAL_ROWS})


def masked_lm_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _masked_lm(spark, folder, line_by_line=True)


QUERIES = {
    "encode": encode_words,
    "encode_merges": encode_merges,
    "source_ratio": source_ratio,
    "ratio_summary": ratio_summary,
    "ratio_histogram": ratio_histogram,
    "ratio_percentiles": ratio_percentiles,
    "substitution_pieces": substitution_pieces,
    "substitute_tokens": substitute_tokens,
    "pad_truncate": pad_truncate,
    "truncate_keep_last": truncate_keep_last,
    "batch_pad": batch_pad,
    "pack_chunks": pack_chunks,
    "mask_tokens": mask_tokens,
    "unmask": unmask_tokens,
    "split_separator": split_separator,
    "substitution_job": substitution_job,
    "masked_lm_packed": masked_lm_packed,
    "masked_lm_lines": masked_lm_lines,
}

# SQL ------------------------------------------------------------------------------------------------------------------


def _encoded_cte(vocab: str, source: str = "w", key: str = "doc_id", rows: str = "documents") -> str:
    """``tok(key, pos, id, att, special)`` with start and end, and ``n`` tokens per row."""
    return f"""body AS (SELECT {key}, pos + 1 AS pos, coalesce(idx, 3) AS id FROM {source} LEFT JOIN {vocab} ON word = token),
lens AS (SELECT r.{key}, coalesce(n, 0) AS n FROM {rows} r LEFT JOIN (SELECT {key}, count(*) AS n FROM body GROUP BY {key}) b USING ({key})),
tok AS (SELECT {key}, pos, id, 0 AS special FROM body
  UNION ALL SELECT {key}, 0, 0, 1 FROM lens UNION ALL SELECT {key}, n + 1, 2, 1 FROM lens)"""


_ENCODED = f"{words_cte()}, vocab AS ({top_words_sql('w', VOCAB)}), {_encoded_cte('vocab')}"
_LISTS = """lists AS (SELECT doc_id, list(id ORDER BY pos) AS ids, list(special ORDER BY pos) AS special, count(*) AS n FROM tok GROUP BY doc_id)"""
_FIT = f"""SELECT doc_id,
  CASE WHEN n > {LENGTH} THEN array_to_string(ids[1:{LENGTH - 1}], ',') || ',2'
       ELSE array_to_string(list_concat(ids, list_transform(range({LENGTH} - n), lambda x: 1)), ',') END AS input_ids,
  array_to_string(list_concat(list_transform(ids[1:{LENGTH}], lambda x: 1), list_transform(range(greatest({LENGTH} - n, 0)), lambda x: 0)), ',') AS attention_mask,
  array_to_string(list_concat(special[1:{LENGTH}], list_transform(range(greatest({LENGTH} - n, 0)), lambda x: 1)), ',') AS special_tokens_mask"""

_ADAPTED = f"{ADAPT_CTE}, {_encoded_cte('adapted')}, flags AS (SELECT tok.*, coalesce(origin = 'source_lang', false) AS is_source FROM tok LEFT JOIN adapted ON id = idx)"
_RATIO = "ratios AS (SELECT doc_id, count(*) AS n_tokens, avg(CASE WHEN is_source THEN 1.0::DOUBLE ELSE 0 END) AS source_ratio FROM flags GROUP BY doc_id)"
_MERGE_LIST = " UNION ALL ".join(
    f"SELECT {i} AS i, '<' || l || '><' || r || '>' || chr(1) || '<' || l || r || '>' AS m FROM t{i}" for i in range(1, SOURCE_MERGES + 1)
)
_PIECES = rf"""{learn_cte(SOURCE_MERGES, "source_words AS (SELECT word FROM w WHERE lang = 'en')", "source_words")},
merge_list AS (SELECT list(m ORDER BY i) AS l FROM ({_MERGE_LIST})),
cut AS (
  SELECT a.idx, a.origin, s.idx AS own,
         list_reduce(l, lambda s, m: replace(s, split_part(m, chr(1), 1), split_part(m, chr(1), 2)),
                     regexp_replace(replace(replace(token, '<', chr(4)), '>', chr(5)), '((?s:.))', '<\1>', 'g')) AS s
  FROM adapted a LEFT JOIN source s USING (token), merge_list),
ids AS (SELECT map(list(token), list(idx)) AS m FROM source),
pieces AS (
  SELECT idx, origin = 'source_lang' AS is_source,
         CASE WHEN own IS NOT NULL THEN [own] ELSE flatten(list_transform(
           list_transform(string_split(s[2:length(s) - 1], '><'), lambda p: replace(replace(p, chr(4), '<'), chr(5), '>')),
           lambda p: CASE WHEN map_contains(m, p) THEN [map_extract(m, p)[1]]
                     ELSE list_transform(string_split(p, ''), lambda c: coalesce(map_extract(m, c)[1], 3)) END)) END AS pieces
  FROM cut, ids)"""


def _masked_cte(key: str) -> str:
    draw = draw_sql(SEED, key, "pos")
    u = lambda i: f"(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT) / 4294967296.0)"
    return f"""drawn AS (SELECT *, {draw} AS h FROM tok),
picked AS (SELECT *, special = 0 AND {u(0)} < 0.15 AS chosen, {u(1)} AS kind, CAST(floor({u(2)} * {VOCAB}) AS INTEGER) AS other FROM drawn),
masked AS (SELECT *, CASE WHEN NOT chosen OR kind >= 0.9 THEN id WHEN kind < 0.8 THEN {MASK_ID} ELSE other END AS shown,
                  CASE WHEN chosen THEN id ELSE -100 END AS label FROM picked)"""


def _swapped(wanted: str) -> str:
    """``lists(doc_id, n_swapped, ids, special)`` for a wanted share that may look at ``doc_id``."""
    return f"""turns AS (SELECT f.*, n_tokens, source_ratio,
            row_number() OVER (PARTITION BY doc_id, f.is_source ORDER BY {order_sql(SEED, 'doc_id', 'pos')}, pos) AS turn
          FROM flags f JOIN ratios USING (doc_id)),
swaps AS (SELECT t.*, p.pieces, NOT t.is_source AND p.pieces IS NOT NULL
            AND turn <= greatest(CAST(trunc(n_tokens * ({wanted} - source_ratio)) AS BIGINT), 0) AS swap
          FROM turns t LEFT JOIN pieces p ON id = idx),
lists AS (SELECT doc_id, count(*) FILTER (swap) AS n_swapped,
            flatten(list(CASE WHEN swap THEN pieces ELSE [id] END ORDER BY pos)) AS ids,
            flatten(list(CASE WHEN swap THEN list_transform(pieces, lambda x: 0) ELSE [special] END ORDER BY pos)) AS special
          FROM swaps GROUP BY doc_id)"""


_SPLIT = "CASE WHEN doc_id % 5 < 3 THEN 'train' WHEN doc_id % 5 = 3 THEN 'validation' ELSE 'test' END"
_LM_ARRAYS = """string_agg(shown, ',' ORDER BY pos) AS input_ids, string_agg(1, ',' ORDER BY pos) AS attention_mask,
  string_agg(special, ',' ORDER BY pos) AS special_tokens_mask, string_agg(label, ',' ORDER BY pos) AS labels"""

_TALK = f"""talk_l AS (SELECT conv_id || ':' || (turn // 2) AS pair_id, turn % 2 AS side, list_filter(string_split_regex(text, '[ \t\n\r\f]+'), lambda w: w <> '') AS l FROM conversations),
talk AS (SELECT pair_id, side, unnest(l) AS word, generate_subscripts(l, 1) AS p FROM talk_l),
vocab AS ({top_words_sql('talk', VOCAB, first_id=str(TALK_FIRST))}),
parts AS (SELECT pair_id, side, p, coalesce(idx, {TALK_UNKNOWN}) AS idx FROM talk LEFT JOIN vocab ON word = token
  UNION ALL SELECT DISTINCT pair_id, 0, 1000000, {SEPARATOR_ID} FROM talk_l),
flat AS (SELECT pair_id, idx AS id, row_number() OVER (PARTITION BY pair_id ORDER BY side, p) AS pos FROM parts),
lens AS (SELECT pair_id, count(*) AS n FROM flat GROUP BY pair_id),
tok AS (SELECT pair_id, pos, id, 0 AS special FROM flat UNION ALL SELECT pair_id, 0, 0, 1 FROM lens UNION ALL SELECT pair_id, n + 1, 2, 1 FROM lens)"""

ORACLES = {
    "encode": f"""WITH {_ENCODED}, {_LISTS} SELECT doc_id, array_to_string(ids, ',') AS input_ids,
  array_to_string(list_transform(ids, lambda x: 1), ',') AS attention_mask, array_to_string(special, ',') AS special_tokens_mask FROM lists""",
    "encode_merges": f"""WITH {learn_cte()},
pieces AS (SELECT replace(replace(word, chr(4), '<'), chr(5), '>') AS word,
  replace(replace(replace(s[2:length(s) - 1], '><', ' '), chr(4), '<'), chr(5), '>') AS p FROM w{MERGES})
SELECT doc_id, coalesce(string_agg(p, ' ' ORDER BY pos), '') AS pieces
FROM documents LEFT JOIN w USING (doc_id) LEFT JOIN pieces USING (word) GROUP BY doc_id""",
    "source_ratio": f"WITH {_ADAPTED}, {_RATIO} SELECT doc_id, n_tokens, round(source_ratio, 6) AS source_ratio FROM ratios",
    "ratio_summary": f"WITH {_ADAPTED}, {_RATIO} SELECT count(*) AS texts, round(avg(source_ratio), 6) AS mean, round(min(source_ratio), 6) AS low, round(max(source_ratio), 6) AS high FROM ratios",
    "ratio_histogram": f"WITH {_ADAPTED}, {_RATIO} SELECT CAST(least(floor(source_ratio * 10), 9) AS INTEGER) AS bar, count(*) AS texts FROM ratios GROUP BY 1",
    "ratio_percentiles": f"WITH {_ADAPTED}, {_RATIO} "
    + " UNION ALL ".join(
        f"SELECT {p} AS percent, round(quantile_disc(source_ratio, {p / 100}::DOUBLE), 6) AS source_ratio FROM ratios" for p in substitute.PERCENTS
    ),
    "substitution_pieces": f"WITH {ADAPT_CTE}, {_PIECES} SELECT idx, is_source, array_to_string(pieces, ',') AS pieces FROM pieces",
    "substitute_tokens": f"""WITH {_ADAPTED}, {_RATIO}, {_PIECES}, {_swapped(f"{WANTED}::DOUBLE")}
{_FIT}, n_swapped FROM (SELECT *, len(ids) AS n FROM lists)""",
    "pad_truncate": f"WITH {_ENCODED}, {_LISTS} {_FIT} FROM lists",
    "truncate_keep_last": f"""WITH {_ENCODED}, {_LISTS} SELECT doc_id,
  array_to_string(CASE WHEN n > 64 THEN list_concat(ids[1:63], ids[n:n]) ELSE ids END, ',') AS input_ids FROM lists""",
    "batch_pad": f"""WITH {_ENCODED}, {_LISTS},
b AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch FROM lists),
x AS (SELECT *, CAST(ceil(max(n) OVER (PARTITION BY batch) / 8.0) * 8 AS INTEGER) AS width FROM b)
SELECT doc_id, batch, width, array_to_string(list_concat(ids, list_transform(range(width - n), lambda x: 1)), ',') AS input_ids,
  array_to_string(list_concat(list_transform(ids, lambda x: 1), list_transform(range(width - n), lambda x: 0)), ',') AS attention_mask FROM x""",
    "pack_chunks": f"""WITH {_ENCODED},
r AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH} AS batch FROM documents),
g AS (SELECT batch, id, special, row_number() OVER (PARTITION BY batch ORDER BY doc_id, pos) - 1 AS place, count(*) OVER (PARTITION BY batch) AS total FROM tok JOIN r USING (doc_id))
SELECT batch, place // {CHUNK} AS chunk, string_agg(id, ',' ORDER BY place) AS input_ids, string_agg(1, ',' ORDER BY place) AS attention_mask, string_agg(special, ',' ORDER BY place) AS special_tokens_mask
FROM g WHERE place // {CHUNK} < total // {CHUNK} GROUP BY 1, 2""",
    "mask_tokens": f"""WITH {_ENCODED}, {_masked_cte('doc_id')}
SELECT doc_id, string_agg(shown, ',' ORDER BY pos) AS input_ids, string_agg(label, ',' ORDER BY pos) AS labels FROM masked GROUP BY doc_id""",
    "unmask": f"WITH {_ENCODED} SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS input_ids FROM tok GROUP BY doc_id",
    "substitution_job": f"""WITH {_ADAPTED}, {_RATIO}, {_PIECES}, {_swapped(f"CASE WHEN doc_id % 5 < 3 THEN {WANTED}::DOUBLE ELSE 0 END")}
{_FIT}, n_swapped, {_SPLIT} AS split FROM (SELECT *, len(ids) AS n FROM lists) WHERE doc_id % 5 <> 4""",
    "masked_lm_packed": f"""WITH {_ENCODED.replace('tok AS', 'words_tok AS')},
r AS (SELECT doc_id, split, (row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1) // {BATCH} AS batch FROM (SELECT doc_id, {_SPLIT} AS split FROM documents)),
g AS (SELECT split, batch, id, special, row_number() OVER (PARTITION BY split, batch ORDER BY doc_id, pos) - 1 AS place, count(*) OVER (PARTITION BY split, batch) AS total
      FROM words_tok JOIN r USING (doc_id) WHERE split <> 'test'),
c AS (SELECT split, batch * 2147483648 + place // {CHUNK} AS row_no, place % {CHUNK} AS pos, id, special FROM g WHERE place // {CHUNK} < total // {CHUNK}),
tok AS (SELECT *, split || '/' || row_no AS of FROM c
        QUALIFY split = 'train' OR dense_rank() OVER (PARTITION BY split ORDER BY row_no) <= {EVAL_ROWS}), {_masked_cte('of')}
SELECT split, row_no, {_LM_ARRAYS} FROM masked GROUP BY split, row_no""",
    "masked_lm_lines": f"""WITH {_ENCODED.replace('tok AS', 'words_tok AS')},
tok AS (SELECT split, doc_id AS row_no, split || '/' || doc_id AS of, least(pos, {CHUNK - 1}) AS pos, id, special
        FROM (SELECT w.*, n, {_SPLIT} AS split FROM words_tok w JOIN lens USING (doc_id) JOIN documents USING (doc_id) WHERE {ink_sql('text')})
        WHERE split <> 'test' AND (pos < {CHUNK - 1} OR pos = n + 1)), {_masked_cte('of')}
SELECT split, row_no, {_LM_ARRAYS} FROM masked GROUP BY split, row_no""",
    "split_separator": f"""WITH {_TALK}, {_masked_cte('pair_id')},
m AS (SELECT pair_id, pos, CASE WHEN label <> -100 THEN label ELSE shown END AS id, shown FROM masked),
cuts AS (SELECT pair_id, min(pos) AS cut FROM masked WHERE shown = 3 GROUP BY pair_id)
SELECT pair_id,
  CASE WHEN cut IS NOT NULL THEN coalesce(string_agg(id, ',' ORDER BY pos) FILTER (pos < cut), '') ELSE 'none' END AS first_unmasked,
  CASE WHEN cut IS NOT NULL THEN coalesce(string_agg(id, ',' ORDER BY pos) FILTER (pos > cut), '') ELSE 'none' END AS second_unmasked,
  CASE WHEN cut IS NOT NULL THEN coalesce(string_agg(1, ',' ORDER BY pos) FILTER (pos < cut), '') ELSE 'none' END AS first_attention_mask,
  CASE WHEN cut IS NOT NULL THEN coalesce(string_agg(1, ',' ORDER BY pos) FILTER (pos > cut), '') ELSE 'none' END AS second_attention_mask
FROM m LEFT JOIN cuts USING (pair_id) GROUP BY pair_id, cut""",
}
