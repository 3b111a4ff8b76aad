"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over source blocks.

Each source's documents are dealt into BLOCKS blocks by a hash of their id. A source's target is met by whole copies of all its
blocks, then by blocks of one more copy in a random order, the last of them in part. All block draws, copies included, are
slots; the tree halves them at each level: the slots of a node are put in random order and the first half goes to the left
child, so each child's source quotas are a multivariate-hypergeometric draw of its parent's, and quotas add up exactly. A
leaf is an output shard. A shard's slots are disjoint blocks of one permutation for each source and copy. Inside a shard,
documents are shuffled by a hash. All of it is DataFrame expressions; hashes are MD5 over the seed, so reruns agree, and SQL can repeat them.

Scale: documents are met in three row-local or pre-aggregated steps. Windows run over block rows (sources x BLOCKS x 2 at
most, whatever the documents) and, for each source, over part sums of the one block that is taken in part, and the documents of one such part.

Defined results: a null or empty text has size 0; a null source is a source of its own, last in order; a document of size 0
is never drawn; rows that repeat an id are drawn together or not at all, each with its own size. An empty table gives an
empty mix. Columns of any other name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmill.llm.common import load, stored

BLOCKS, LEVELS, SHARE, MOST = 256, 4, 1.5, 2
#: The weights by source in order, repeating.
WEIGHTS = (3, 1, 2)


#: A block that is taken in part is added up in 2 ** PART_BITS parts.
PART_BITS = 10
#: Up to so many sources, block rows (at most 2 * BLOCKS a source) are broadcast; beyond it Spark joins by shuffling.
BROADCAST_SOURCES = 1000


def near(small: DataFrame, goal: DataFrame) -> DataFrame:
    """small, with a broadcast hint if the number of sources allows it."""
    return F.broadcast(small) if goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else small


def word_count(text: Column) -> Column:
    """Number of words: runs of characters that are no ASCII white space."""
    squeezed = F.regexp_replace(text, "[^\\x20\\x09-\\x0D]++", "w")
    return F.coalesce((F.length(squeezed) - F.length(F.translate(squeezed, "w", ""))).cast("long"), F.lit(0).cast("long"))


def draw(*parts: Column | str | int) -> Column:
    """Whole number of 60 bits that depends on the parts alone."""
    text = F.concat_ws("/", *(F.coalesce(p.cast("string"), F.lit("~")) if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def block_of(doc_id: Column, seed: str) -> Column:
    return draw(doc_id, seed, "block") % BLOCKS


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from a row for each source: weights by source in order, null last, held to most times the size.

    What a held source leaves is shared again by weight until no source is above; this is water filling: sources with the
    lowest size for their weight are held first. A target is most * size while the level does not reach it, else weight * level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    tight = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = tight.rowsBetween(Window.unboundedPreceding, -1), tight.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    out = out.withColumn("level", (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # The level that holds is the first, in that order, at which the source is not held; all before it are.
    held = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level"))))
    out = out.withColumn("last", held.over(whole)["level"])
    return out.select("source", "source_size", F.least("cap", F.coalesce(F.col("last") * F.col("w"), F.col("cap"))).alias("target"))


def plan(sized: DataFrame, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sized: doc_id, source, size. Gives targets by source; blocks taken in the last copy; documents taken of the block that is cut."""
    sums = stored(sized.groupBy("source", block_of(F.col("doc_id"), seed).alias("block")).agg(F.sum("size").alias("block_size")), "mix-blocks")
    goal = stored(targets(sums.groupBy("source").agg(F.sum("block_size").alias("source_size"))), "mix-targets")
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = goal.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    turn = Window.partitionBy("source").orderBy(draw(F.col("source"), F.col("block"), seed, "turn"), "block")
    dealt = sums.join(near(goal.withColumnRenamed("source", "s"), goal), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = dealt.withColumn("upto", F.sum("block_size").over(turn))
    dealt = dealt.withColumn("last", F.when(F.col("upto") <= F.col("rest"), "whole").when(F.col("upto") - F.col("block_size") < F.col("rest"), "cut").otherwise("none"))
    dealt = stored(dealt.withColumn("left", F.col("rest") - (F.col("upto") - F.col("block_size"))), "mix-dealt")
    cut = dealt.where("last = 'cut'").select(F.col("source").alias("s"), F.col("block").alias("b"), "left")
    inside = sized.where("size > 0").withColumn("block", block_of(F.col("doc_id"), seed)).join(near(cut, goal), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    inside = inside.groupBy("s", "block", "left", "doc_id").agg(F.sum("size").alias("size"))
    turn = draw(F.col("doc_id"), seed, "cut")
    inside = inside.withColumn("part", F.shiftright(turn, 60 - PART_BITS))
    # The block's documents in order of their draw: parts of it are added up first, and only the one in which the sum is reached is sorted.
    upto = Window.partitionBy("s", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = inside.groupBy("s", "block", "part").agg(F.sum("size").alias("part_size")).withColumn("before", F.coalesce(F.sum("part_size").over(upto), F.lit(0)))
    sums = sums.select(F.col("s").alias("s_"), F.col("block").alias("b_"), F.col("part").alias("p_"), "part_size", "before")
    inside = inside.join(sums, F.col("s").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_")) & (F.col("part") == F.col("p_"))).where("before < left")
    whole = inside.where("before + part_size <= left")
    here = Window.partitionBy("s", "block", "part").orderBy(turn, "doc_id")
    # A document is taken while the sum gets nearer to what is left.
    reached = inside.where("before + part_size > left").withColumn("sum", F.col("before") + F.sum("size").over(here)).where(F.col("sum") - F.col("size") / 2 <= F.col("left"))
    part = whole.select("s", "doc_id").unionByName(reached.select("s", "doc_id"))
    return goal, dealt, part.select("s", F.col("doc_id").alias("d"), F.lit(1).alias("more"))


def with_plan(df: DataFrame, seed: str = "mix") -> DataFrame:
    """df (doc_id, source, size and any others) with source_size, target, block, copies and more (1: taken once more)."""
    goal, dealt, part = plan(df.select("doc_id", "source", "size"), seed)
    blocks = dealt.select(F.col("source").alias("s"), F.col("block").alias("b"), "source_size", "target", "copies", "last")
    out = df.withColumn("block", block_of(F.col("doc_id"), seed))
    out = out.join(near(blocks, goal), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    out = out.join(part, F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("last") == "cut"), "left").drop("s", "d")
    more = F.when(F.col("last") == "whole", 1).otherwise(F.coalesce("more", F.lit(0)))
    return out.withColumn("more", F.when(F.col("size") > 0, more).otherwise(0)).drop("last")


def slots(blocks: DataFrame, seed: str = "mix", levels: int = LEVELS) -> DataFrame:
    """blocks (source, block, copy) dealt by the splitting tree: shard is the path from the root, a bit for each level."""
    out = blocks.withColumn("shard", F.lit(0))
    for level in range(levels):
        key = draw(F.col("source"), F.col("block"), F.col("copy"), seed, level)
        node = Window.partitionBy("shard").orderBy(key, "source", "block", "copy")
        size = Window.partitionBy("shard")
        right = F.row_number().over(node) * 2 > F.count("*").over(size) + draw(F.col("shard"), seed, level, "odd") % 2
        out = out.withColumn("right", right.cast("int")).withColumn("shard", F.col("shard") * 2 + F.col("right")).drop("right")
    return out


def with_slots(rows: DataFrame, seed: str = "mix") -> DataFrame:
    """rows (doc_id, source, size and any others) with source_size, target and dealt: copy and shard of each slot that draws the row, by copy."""
    planned = with_plan(rows, seed).withColumn("draws", F.when(F.col("size") > 0, F.col("copies") + F.col("more")).otherwise(0))
    most = planned.where("draws > 0").groupBy("source", "block").agg(F.max("draws").alias("draws"))
    blocks = stored(most.select("source", "block", F.explode(F.sequence(F.lit(1), F.col("draws"))).alias("copy")), "mix-slots")
    tree = slots(blocks, seed).groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))
    tree = stored(tree, "mix-shards")
    out = planned.join(near(tree, tree.select("s").distinct()), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    own = F.filter("dealt", lambda x: x["copy"] <= F.col("draws"))
    return out.withColumn("dealt", F.coalesce(own, F.array().cast("array<struct<copy:int,shard:int>>"))).drop("s", "b", "block", "copies", "more", "draws")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix: a row of docs for each time that it is drawn, with copy, shard and place, its turn in the shard."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    out = with_slots(rows, seed).withColumn("slot", F.explode("dealt"))
    place = draw(F.col("doc_id"), F.col("slot.copy"), seed, "place")
    return out.select("row.*", F.col("slot.copy").alias("mix_copy"), F.col("slot.shard").alias("mix_shard"), place.alias("mix_place"), F.col("doc_id").alias("mix_id"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tree deals of each document: words taken, and the shard of each copy."""
    docs = load(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return with_slots(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("dealt")).alias("taken"), F.col("dealt.shard").alias("shards"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each drawn copy of a document, with the columns of docs, written shard by shard and shuffled inside a shard."""
    return shuffled(mix(docs)).select(*docs.columns)


def shuffled(mixed: DataFrame) -> DataFrame:
    """The mix laid out for writing: shards one after another, each in order of place; ranges of it are tasks, however large a shard is."""
    return mixed.orderBy("mix_shard", "mix_place", "mix_id", "mix_copy")
