"""Benchmark passages inside documents: a prefix-filtered containment join, in DataFrame operations only.

A window of a benchmark item is a run of words. It can only occur in a document that has all of its words, so one of them
is enough to find every occurrence: the prefix of a containment of 1 is a single token, and the rarest one, by its count
over all documents, meets the fewest rows. The token's place in the window gives the only possible start; it must leave
room for the whole window (positional and length bounds), and then the words there are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, matched, small, unused
from corpusloom.sources.stage import staged

SIZE = 10
#: Most windows, each with its words and items, that are broadcast.
BROADCAST_WINDOWS = 100_000
#: Fixed: what separates words once A-Z are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """The words of a text, an empty array if null."""
    split = F.split(ascii_lower(text), SEPARATORS)
    return F.coalesce(F.filter(split, lambda w: w != ""), F.array().cast("array<string>"))


def windows(items: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``window`` (its words) and ``items``: the sorted, distinct ids, as text, of the items that hold it."""
    rows = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words(text).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    runs = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, size))).alias("window"))
    return runs.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def prefixes(runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Each window with ``token``, its rarest word by the counts over all documents, and the token's place ``at``.

    Only words of the windows are counted. Ties go to the longer, then the smaller word.
    """
    tokens = staged(runs.select(F.explode("window").alias("token")).distinct(), "tokens")
    tokens_side = F.broadcast(tokens) if small(tokens) else tokens
    counts = rows.select(F.explode("w").alias("token")).join(tokens_side, "token").groupBy("token").count()
    counts = staged(counts, "rarity")
    each = runs.select("window", F.posexplode("window").alias("at", "token")).join(counts, "token", "left")
    order = F.struct(F.coalesce("count", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), "token", "at")
    rarest = each.groupBy("window").agg(F.min(order).alias("p")).select("window", "p.token", "p.at")
    return runs.join(rarest, "window")


def hits(docs: DataFrame, items: DataFrame, keep: list[str], key: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """One row per document: ``keep``, ``n_words``, ``n_hit``, ``n_items`` and ``items`` (sorted ids as text).

    ``docs`` and ``items`` have their text in the column ``text``. Null and word-free texts have no words and no hits;
    items without words have no windows. An item that repeats an id is the same item; a null id is written as an empty
    one. Repeated document rows stay separate rows: each gets a number where it is scanned, and travels with it. A
    document meets the windows where it lies, in one generated loop without moving its text; only hits and one summary row
    per document are shuffled, by that number. The windows are broadcast only after they were counted; where they are too
    many, each word goes to them with its surroundings alone, less than two windows long, so the shuffle carries a fixed
    multiple of the text.
    """
    docs = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], words(text).alias("w"))
    runs = staged(windows(items, key, text, size), "windows")
    table = prefixes(runs, docs).select("token", "at", "window", "items")
    nothing = table.sparkSession.sql(
        "SELECT '' AS token, 0 AS at, cast(array() AS array<string>) AS window, cast(array() AS array<string>) AS items"
    )
    table = staged(table.unionByName(nothing), "prefixes")
    local = small(table, BROADCAST_WINDOWS)
    table = F.broadcast(table) if local else table
    # The empty word that ends every document meets the empty window: so each document keeps one row.
    names = [f"k{i}" for i in range(len(keep))]
    places = docs.withColumn("row", F.monotonically_increasing_id()).select(
        "row", *names, "w", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "token")
    )
    places = places.withColumn("n_words", F.size("w")).withColumn("skip", F.lit(0))
    if not local:
        skip = F.greatest(F.col("pos") - size + 1, F.lit(0))
        places = places.withColumn("skip", skip).withColumn("w", F.slice("w", skip + 1, F.lit(2 * size - 1)))
    begin, length = F.col("pos") - F.col("at"), F.size("window")
    same = F.slice("w", F.greatest(begin - F.col("skip"), F.lit(0)) + 1, length) == F.col("window")
    found = places.join(table, "token").where((begin >= 0) & (begin + length <= F.col("n_words")) & same)
    found = found.select(
        "row", *names, "n_words", F.when(length > 0, F.struct(begin.alias("s"), (begin + length).alias("e"))).alias("span"), "items"
    )
    per_doc = found.groupBy("row").agg(
        *[F.first(c).alias(c) for c in names],
        F.first("n_words").cast("bigint").alias("n_words"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # Spans come by their start: each adds what lies beyond the end reached so far.
    fold = """aggregate(spans, named_struct('n', 0L, 'e', 0), (a, x) -> named_struct(
        'n', a.n + greatest(0, x.e - greatest(a.e, x.s)), 'e', greatest(a.e, x.e))).n"""
    return per_doc.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_words", F.expr(fold).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"), "items",
    )


def contaminated(docs: DataFrame, items: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """:func:`hits` with ``items_sha256`` (lowercase hex of the ids, comma-joined) and ``contaminated``."""
    rows = hits(docs, items, list(keep))
    return rows.withColumns(
        {"items_sha256": F.sha2(F.array_join("items", ",").cast("binary"), 256), "contaminated": F.col("n_hit") > 0}
    ).drop("items")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a hit. Rows are told apart by key and text, so repeated rows go or stay together."""
    mark = unused("_text", docs)
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(text, F.lit(""))))
    dirty = hits(marked.withColumn("text", F.col(text)), items, [key, mark]).where("n_hit > 0").select(key, mark).distinct()
    return matched(marked, staged(dirty, "dirty"), [key, mark], "left_anti").drop(mark)


def oracle() -> str:
    """DuckDB SQL for the query over ``documents`` and ``benchmark``."""
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = f"regexp_extract_all(coalesce({lowered}, '')" + r", '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+')"
    return f"""
    WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {split} AS w FROM benchmark),
    r AS (SELECT DISTINCT item, w[s:s + {SIZE - 1}] AS run
          FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {SIZE - 1}, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
    d AS (SELECT row_number() OVER () AS row, doc_id, {split} AS w FROM documents),
    p AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS s FROM d WHERE len(w) > 0),
    n AS (SELECT DISTINCT len(run) AS n FROM r),
    c AS (SELECT p.row, p.s, n.n, w[s:s + n.n - 1] AS run FROM p, n WHERE s + n.n - 1 <= len(w)),
    h AS (SELECT row, s, n, item FROM c JOIN r USING (run)),
    x AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(s, s + n)) AS pos FROM h) GROUP BY row),
    y AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN x USING (row) LEFT JOIN y USING (row)"""
