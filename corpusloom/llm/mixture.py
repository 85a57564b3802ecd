"""Mix sources to target weights by blocks of words, in DataFrame operations only.

The words of a source, its documents one after the other, are cut into blocks of fixed length. The output is a table of slots,
one block each. A source has as many slots as its target needs, and each draws its output shard: so the counts of the sources in
a shard are random, and multinomial over the shards. The slots of a source walk through its blocks in a pseudorandom order, pass
after pass, so no block comes again before all others have come as often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import unused
from corpusloom.sources.stage import staged

BLOCK = 128
#: Slots of an output shard on average: 8 million words.
SHARD = 65_536
ROUNDS = 6
REPEATS = 3
CELL = 4_096
#: Slots that a task makes at once.
CHUNK = 16_384
#: Fixed: words are what lies between ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def number(*parts: str | Column | int) -> Column:
    """A pseudorandom 60-bit whole number of the given values."""
    cells = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cells]).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def shuffled(index: Column, size: Column, *key: str | Column | int) -> Column:
    """A permutation of 0..size-1 at ``index``: a few rounds that each swap or leave pairs mirrored about a drawn point."""
    def swap(x: Column, turn: Column) -> Column:
        mirror = F.pmod(number(*key, turn) % size - x, size)
        high = F.greatest(x, mirror)
        return F.when(number(*key, turn, high) % 2 == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def targets(sizes: DataFrame) -> DataFrame:
    """``source, rank, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the sum of all sizes by weight; none exceeds
    three times its source, and what lies above is shared again. That is one level for all: with the first sources by size
    per weight taken as full, the rest shares what is left; any wrong choice of them gives a lower level, so the highest is
    right. The table has one row per source.
    """
    every = Window.partitionBy(F.lit(0))
    # UTF-8 orders as code points do.
    rank = F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source")))
    rows = sizes.withColumn("rank", rank).withColumn("weight", F.pmod(F.col("rank") - 1, F.lit(3)) + 1)
    rows = rows.withColumn("most", F.col("source_size") * REPEATS)
    before = every.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    full, held = F.coalesce(F.sum("most").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - full) / (F.sum("weight").over(every) - held)
    common = F.max("level").over(every)
    return rows.withColumn("level", level).select(
        "source", "rank", "source_size", F.least(common * F.col("weight"), F.col("most")).cast("double").alias("target")
    )


def sized(docs: DataFrame, keep: list[str], source: str, text: str) -> DataFrame:
    return docs.select(
        *keep, F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")
    )


def placed(rows: DataFrame, key: list[str]) -> DataFrame:
    """The staged rows with ``start``, where their words begin in their source, in the order of a hash of the key.

    Two steps: sums of cells of some thousand rows, then the order inside a cell; so a source with a third of all rows is
    many tasks.
    """
    cells = max(1, rows.count() // CELL)
    rows = rows.withColumn("hash", F.xxhash64(*key, "size")).withColumn("cell", F.pmod("hash", F.lit(cells)))
    sums = rows.groupBy("source", "cell").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "cell").orderBy("hash", *key, "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = ordered["source"].eqNullSafe(offsets["s"]) & (ordered["cell"] == offsets["c"])
    return ordered.join(offsets, same).withColumn("start", F.col("offset") + F.col("within")).drop("hash", "cell", "within", "offset", "s", "c")


def needs(plan: DataFrame) -> DataFrame:
    """The sources with ``need``, the slots that hold their target in blocks of their mean length, and the number of ``shards``."""
    need = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = plan.withColumn("need", F.round(need).cast("bigint"))
    shards = F.ceil(F.sum("need").over(Window.partitionBy(F.lit(0))) / SHARD)
    return rows.withColumn("shards", shards).where("need > 0")


def slots(plan: DataFrame) -> DataFrame:
    """``rank, shard, slot, block, lap``: every slot of the output, and the block that it holds.

    Every slot of a source draws the output shard that it goes to, all shards alike; so the counts of a source over the shards
    are multinomial, while its total is what its target needs. Slots are made in runs of CHUNK, each by the task that it hashes
    to. A source that stops at three times its size gets no fourth pass: a slot beyond that stays empty.
    """
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = needs(plan).select("rank", "blocks", "need", "shards", F.explode(F.expr(f"sequence(0L, (need - 1) div {CHUNK}L)")).alias("run"))
    rows = rows.repartition(tasks, "rank", "run")
    within = F.explode(F.expr(f"sequence(run * {CHUNK}L, least(need, (run + 1) * {CHUNK}L) - 1)"))
    rows = rows.withColumn("slot", within).withColumn("lap", F.expr("slot div blocks")).where(f"lap < {REPEATS}")
    shard = number(SEED, "shard", F.col("rank"), F.col("slot")) % F.col("shards")
    block = shuffled(F.expr("slot % blocks"), F.col("blocks"), SEED, F.col("rank"), F.col("lap"))
    return rows.select("rank", shard.alias("shard"), "slot", block.alias("block"), "lap")


def mixed(docs: DataFrame, keep: list[str], source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents with ``source, size, start, rank, source_size, target``, and the slots of the mix.

    Null texts have no words, a null source comes last. Rows with equal key are ordered by size, and repeated rows lie
    side by side, each with words of its own. A table without words gives no slots. Both tables are staged, so the mix is
    drawn once; all draws are hashes, so reruns agree.
    """
    rows = staged(sized(docs, keep, source, text), "sized")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    blocks = F.ceil(F.col("source_size") / BLOCK).alias("blocks")
    plan = staged(targets(sizes).select("*", blocks), "targets")
    place = placed(rows, keep)
    goals = plan.select(F.col("source").alias("s"), "rank", "source_size", "target")
    place = staged(place.join(goals, place["source"].eqNullSafe(goals["s"])).drop("s"), "placed")
    return place, staged(slots(plan), "slots")


def parts(place: DataFrame) -> DataFrame:
    """Every document's share of every block it lies in: ``block, from, words``, counted from the document's first word."""
    last = F.expr(f"(start + size - 1) div {BLOCK}L")
    rows = place.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {BLOCK}L"), last)))
    begin = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0))
    until = F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size"))
    return rows.withColumns({"from": begin, "words": until - begin})


def taken(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``key, size, source_size, target, taken`` of every document; see :func:`mixed`."""
    place, chosen = mixed(docs, [key], source, text)
    times = chosen.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    shares = parts(place).join(times, ["rank", "block"], "left")
    words = F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken")
    some = shares.groupBy("rank", "start", key, "size", "source_size", "target").agg(words).drop("rank", "start")
    none = place.where("size = 0").select(key, "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
    return some.unionByName(none)


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents as the mix takes them: per document and pass one row, its text the words of the blocks taken.

    A pass that takes all blocks of a document gives its text as it is, from its first word. Rows that agree in key and
    text are cut as one. ``chars`` is counted anew where the table has it; all other columns stay.
    """
    mark, cuts_of, words_of = (unused(name, docs) for name in ("_text", "_cuts", "_words"))
    columns, docs = docs.columns, docs.withColumn(mark, F.xxhash64(F.coalesce(text, F.lit(""))))
    narrow = docs.select(F.col(key).alias("key"), F.col(mark).alias("mark"), F.col(source).alias("source"), F.col(text).alias("text"))
    place, chosen = mixed(narrow, ["key", "mark"])
    cuts = parts(place).join(chosen.select("rank", "block", "lap"), ["rank", "block"])
    cuts = cuts.groupBy("key", "mark", "rank", "start", "lap").agg(F.array_sort(F.collect_list(F.struct("from", "words"))).alias(cuts_of))
    single = docs if docs.groupBy(key, mark).count().where("count > 1").isEmpty() else docs.dropDuplicates([key, mark])
    rows = single.join(cuts, single[key].eqNullSafe(cuts["key"]) & (single[mark] == cuts["mark"]))
    rows = rows.select(*[single[c] for c in single.columns], cuts_of)
    tokens = F.regexp_extract_all(F.col(text), F.lit(rf"{WORD}[\x20\x09-\x0D]*"), F.lit(0))
    rows = rows.withColumn(words_of, tokens)
    cut = F.transform(cuts_of, lambda c: F.array_join(F.slice(words_of, (c["from"] + 1).cast("int"), c["words"].cast("int")), ""))
    rows = rows.withColumn(text, F.array_join(cut, ""))
    if chars in docs.columns:
        rows = rows.withColumn(chars, F.length(text).cast(docs.schema[chars].dataType))
    return rows.select(*columns)
