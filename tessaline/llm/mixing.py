"""Mixing sources to target weights, in DataFrame operations only.

Words of a source's documents, one document after the other, are packed into blocks of `BLOCK` words. A source that is
to give w words needs slots: whole rounds over its blocks, and part of a round of which the last slot may be a part of
a block, so exactly w words are taken. Each output shard has `SHARD` slots and draws its source counts from a
multinomial distribution: every slot draws a ticket, and tickets belong to sources in proportion to their slots. A
source's slots are numbered over the shards; slots beyond its need are left out, missing ones go to a last shard. A
slot number's place within its round goes through a pseudorandom permutation of the source's whole blocks (swap-or-not,
defined for any number of blocks and computed for a single index), the short block comes last. Slots and documents meet in
an equi-join on source and block.

Draws and permutations depend on `seed`, sources, texts and ids alone, so reruns agree. Document order within a source
is by a hash of id and text. Running sums have two levels (groups, then rows of a group), so no task gets a source whole.

Null texts have size 0; null sources are a source of their own, the last one. Documents of size 0 are never taken.
Repeated rows are packed like different ones. An empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessaline.llm.base import WORD, plain_unions, table, written

BLOCK, SHARD = 256, 1024
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
ROUNDS = 12
#: Rows of a group in running sums, about.
GROUP = 20_000
#: Tickets of a bucket, in which a ticket finds its source.
BUCKET = 4096
#: Slots that a task numbers, about.
SLOTS = 50_000


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", uid: Column | None = None) -> DataFrame:
    """uid, doc_id, source, size (words) and place (a hash of id and text) of each row, as a written table."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select((F.monotonically_increasing_id() if uid is None else uid).alias("uid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(id_col, text_col).alias("place"))
    return written(rows, "sizes")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row per source: source, source_size, target. Weights go round the sources by code point, null last.

    Sources whose cap is reached first come first; the first one that stays below its cap at the level left by those
    before it gives the level of all from there on. That is where resharing the excess ends. The windows hold one row per
    source in one task: sources are taken to be far fewer than documents.
    """
    # strings compare by their UTF-8 bytes, which is the order of code points
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    rows = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("all", share * F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.col("all") - before) / left)
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(Window.partitionBy(F.lit(0)))
    rows = rows.withColumn("level", level["level"])
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def running(rows: DataFrame, keys: list[str], group: str, order: list, value: str, out: str) -> DataFrame:
    """rows with `out`: the sum of value over rows before, within keys, by group and then order."""
    sums = rows.groupBy(*keys, group).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*[F.col(k).alias(f"_{k}") for k in [*keys, group]], F.coalesce(before, F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, group]]
    joined = rows.join(sums, same).drop(*[f"_{k}" for k in [*keys, group]])
    within = F.sum(value).over(Window.partitionBy(*keys, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn(out, F.col("_before") + F.coalesce(within, F.lit(0))).drop("_before")


def shuffled(i: Column, n: Column, seed: Column) -> Column:
    """The place of i under a pseudorandom permutation of 0 .. n - 1."""

    def step(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(seed, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.greatest(x, y), seed, r), F.lit(2)) == 1, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), i, step)


def plan(sizes: DataFrame, by_source: DataFrame, seed: int = 1, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """A row per slot: shard, source, slot, round, block, words (of the block's start that the slot takes)."""
    spark = sizes.sparkSession
    want = F.least(F.round("target").cast("long"), 2 * F.col("source_size"))
    s = by_source.where("source_size > 0").withColumn("want", want).where("want > 0")
    s = s.withColumns({"whole": F.expr(f"source_size div {block}"), "tail": F.col("source_size") % block, "rounds": F.expr("want div source_size"), "rest": F.expr("want % source_size")})
    s = s.withColumn("blocks", F.col("whole") + (F.col("tail") > 0).cast("long"))
    s = s.withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    order = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    s = written(s.withColumn("first", F.coalesce(F.sum("slots").over(order), F.lit(0))).drop("target"), "mix-sources")
    total = s.agg(F.sum("slots")).first()[0] or 0
    shards = -(-total // shard)
    # tickets of all slots of all shards: a multinomial draw of sources for each shard
    drawn = spark.range(shards * shard).select(F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1))).alias("ticket"))
    drawn = drawn.withColumn("bucket", F.expr(f"ticket div {BUCKET}"))
    owners = s.select("source", F.col("first").alias("lo"), (F.col("first") + F.col("slots")).alias("hi"), F.explode(F.sequence(F.expr(f"first div {BUCKET}"), F.expr(f"(first + slots - 1) div {BUCKET}"))).alias("bucket"))
    counts = drawn.join(owners, (drawn.bucket == owners.bucket) & (F.col("ticket") >= F.col("lo")) & (F.col("ticket") < F.col("hi"))).groupBy("source", "shard").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.withColumn("hundred", F.expr("shard div 1000")), "mix-counts")
    numbered = running(counts, ["source"], "hundred", ["shard"], "n", "from")
    on = lambda a, b: a["source"].eqNullSafe(b["source"])
    used = numbered.join(s, on(numbered, s)).select(s["*"], "shard", "from", F.least(F.col("from") + F.col("n"), F.col("slots")).alias("to"))
    had = counts.groupBy("source").agg(F.sum("n").alias("n"))
    more = s.join(had, on(s, had), "left").select(s["*"], F.lit(shards).cast("long").alias("shard"), F.coalesce("n", F.lit(0)).alias("from"), F.col("slots").alias("to"))
    # what the shards left goes on in pieces of a shard's size; rows are few and small, so they are dealt by the slots they open
    more = more.where("from < to").withColumn("from", F.explode(F.sequence(F.col("from"), F.col("to") - 1, F.lit(shard).cast("long")))).withColumn("to", F.least("to", F.col("from") + shard))
    dealt = used.unionByName(more).where("from < to").repartition(max(1, total // SLOTS), "source", "from")
    slots = dealt.withColumn("slot", F.explode(F.sequence(F.col("from"), F.col("to") - 1)))
    slots = slots.withColumns({"round": F.expr("slot div blocks"), "i": F.expr("slot % blocks")})
    at = F.when(F.col("i") >= F.col("whole"), F.col("i")).otherwise(shuffled(F.col("i"), F.greatest("whole", F.lit(1)), F.xxhash64(F.lit(seed), F.col("source"), F.col("round"))))
    words = F.least(F.when(F.col("i") >= F.col("whole"), F.col("tail")).otherwise(F.lit(block)), F.when(F.col("round") < F.col("rounds"), F.lit(block)).otherwise(F.col("rest") - F.col("i") * block))
    return slots.select("shard", "source", "slot", "round", at.alias("block"), words.alias("words"))


def segments(sizes: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """uid, doc_id, source, size, and round, from, to for each run of a document's words that a slot takes (null: none)."""
    groups = max(64, sizes.count() // GROUP)
    rows = sizes.withColumn("part", F.pmod("place", F.lit(groups)))
    packed = running(rows, ["source"], "part", ["doc_id", "place", "uid"], "size", "start")
    ends = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    spans = packed.select("uid", "doc_id", "source", "size", "start", F.explode_outer(ends).alias("block"))
    b = slots.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "round", "words")
    joined = spans.join(b, spans["source"].eqNullSafe(b["b_source"]) & (spans["block"] == b["b_block"]), "left")
    lo = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    hi = F.least(F.col("size"), F.col("block") * block + F.col("words") - F.col("start"))
    taken = F.col("words").isNotNull() & (hi > lo)
    return joined.select("uid", "doc_id", "source", "size", "round", F.when(taken, lo).alias("from"), F.when(taken, hi).alias("to"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain_unions(spark)
    sizes = sized(table(spark, sf_dir, "documents"))
    by_source = written(targets(sizes), "mix-targets")
    runs = segments(sizes, plan(sizes, by_source))
    taken = runs.groupBy("uid", "doc_id", "source", "size").agg(F.coalesce(F.sum(F.col("to") - F.col("from")), F.lit(0)).alias("taken"))
    t = by_source.select(F.col("source").alias("t_source"), "source_size", "target")
    return taken.join(t, taken["source"].eqNullSafe(t["t_source"]), "left").select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as the mix takes them: a row per document of which a word is taken, with the taken words as text.

    A document taken once and whole keeps its text; a whole one taken twice has it twice, a line break between.
    Otherwise the words of each round follow those of the one before, in order, joined by one blank. n_chars follows.
    """
    plain_unions(docs.sparkSession)
    kept = written(docs.withColumn("_uid", F.monotonically_increasing_id()), "mix-docs")
    sizes = sized(kept, uid=F.col("_uid"))
    runs = segments(sizes, plan(sizes, written(targets(sizes), "mix-targets"))).where("to is not null")
    parts = runs.groupBy(F.col("uid").alias("_uid")).agg(F.array_sort(F.collect_list(F.struct("round", "from", "to"))).alias("_runs"), F.sum(F.col("to") - F.col("from")).alias("_taken"), F.first("size").alias("_size"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), 1)
    some = F.array_join(F.flatten(F.transform("_runs", lambda r: F.slice("_words", (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), " ")
    text = F.when(F.col("_taken") == F.col("_size"), F.col("text")).when(F.col("_taken") == 2 * F.col("_size"), F.concat_ws("\n", "text", "text")).otherwise(some)
    # taken == size may also be parts of two rounds, which make up the whole only if the first round has all
    whole = F.aggregate("_runs", F.lit(0).cast("long"), lambda a, r: a + F.when(r["round"] == F.element_at("_runs", 1)["round"], r["to"] - r["from"]).otherwise(F.lit(0)))
    text = F.when((F.col("_taken") == F.col("_size")) & (whole < F.col("_size")), some).otherwise(text)
    joined = kept.join(parts, "_uid").withColumn("_words", F.when((F.col("_taken") == 2 * F.col("_size")) | ((F.col("_taken") == F.col("_size")) & (whole == F.col("_size"))), F.array().cast("array<string>")).otherwise(words))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
