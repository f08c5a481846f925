"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share the words of the corpus; a
target stops at ``max_repeat`` times its source's words and the excess is shared again by weight until none is above.

Each source's documents are permuted and laid on a line of words, as often as a document may be repeated, and the line is cut into
equal blocks.  The tree's root parts these blocks: its left side, the mix, has an exact quota of each source, its target,
drawn without replacement by a seeded permutation of the source's blocks (the last block drawn is cut at the target).  So which
documents are taken, and how often, follows from the draw.  Below, a binary tree over the output shards divides the drawn
blocks: at a node all its blocks (of all sources) are permuted and the left half of the shards takes the first of them, which
draws the sources' left quotas from the multivariate-hypergeometric distribution and fixes which disjoint blocks they are.
Within a shard, blocks and the documents of a block are shuffled locally.

Only DataFrame functions are used.  Order statistics and running sums are taken in two steps (per hash bucket, then within
it), so that a source with a third of all rows is no single task's work.  One window runs over one row per source.

Edge cases: a null text has size 0 and is never taken; a source without words has target 0; null is a source of its own;
rows that repeat an identifier are separate documents; documents of a source whose permutation keys tie follow each other by
identifier and size, blocks by number; sources of equal level share by code point; texts of any length are cut at the edges of blocks; columns besides
identifier, text and source are not looked at, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, before, n_words, unit, words

#: Words of a block: this share of the corpus, within bounds.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 16, 32768, 4096
SHARDS = 8
SEED = 20240607
MAX_REPEAT = 3


def targets(stats: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``src, source, source_size, n_docs, target`` from ``source, source_size, n_docs``; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    df = stats.withColumn("src", F.row_number().over(order)).withColumn("weight", (F.col("src") - 1) % 3 + 1)
    df = df.withColumn("cap", max_repeat * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    low = Window.orderBy("level", "src")
    everything = Window.partitionBy(F.lit(0))
    df = df.withColumn("capped_before", F.coalesce(F.sum("cap").over(low.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("weight_from", F.sum("weight").over(low.rowsBetween(0, Window.unboundedFollowing)))
    df = df.withColumn("share", (F.sum("source_size").over(everything) - F.col("capped_before")) / F.col("weight_from"))
    free = F.col("level") > F.col("share")
    df = df.withColumn("at", F.min(F.when(free, F.struct("level", "src", "share"))).over(everything).getField("share"))
    target = F.when(free, F.least(F.col("at") * F.col("weight"), F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double"))
    return df.select("src", "source", "source_size", "n_docs", target.alias("target"))


def split_tree(blocks: DataFrame, total: int, shards: int, seed: int, scratch: Scratch) -> DataFrame:
    """Adds ``shard`` to blocks ``src, block``: draws each node's left blocks without replacement."""
    nodes = {(0, shards): total}
    df = blocks.withColumn("node", F.lit(0))
    level = 0
    while any(hi - lo > 1 for lo, hi in nodes):
        quota = {lo: n * ((hi - lo) // 2) // (hi - lo) for (lo, hi), n in nodes.items() if hi - lo > 1}
        middle = {lo: lo + (hi - lo) // 2 for (lo, hi) in nodes if hi - lo > 1}
        lookup = lambda d: F.coalesce(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("node")], F.lit(0)).cast("long")
        df = df.withColumn("u", unit(F.lit(seed), F.lit(level), "src", "block")).withColumn("_b", F.floor(F.col("u") * 1024)).withColumn("one", F.lit(1))
        df = before(df, ["node"], "_b", ["u", "src", "block"], {"rank": "one"})
        inner = F.col("node").isin(list(quota))
        df = df.withColumn("node", F.when(inner & (F.col("rank") >= lookup(quota)), lookup(middle).cast("int")).otherwise(F.col("node")))
        df = scratch.save(df.select("src", "block", "node"), f"tree-{level}")
        nodes = {k: v for (lo, hi), n in nodes.items() for k, v in ([((lo, middle[lo]), quota[lo]), ((middle[lo], hi), n - quota[lo])] if hi - lo > 1 else [((lo, hi), n)])}
        level += 1
    return df.withColumnRenamed("node", "shard")


def hash_share(hexes: Column) -> Column:
    """The first 32 bits of hexadecimal digits as a number in [0, 1)."""
    return F.conv(F.substring(hexes, 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, block: int | None = None, seed: int = SEED, max_repeat: int = MAX_REPEAT, row_col: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    documents: ``row, doc_id, size, source_size, target, taken``, one per input row.  pieces: what the mix takes,
    ``row, doc_id, src, shard, block_order, u, epoch, start, length`` (words ``start`` to ``start + length`` of the
    document); a shard's order is ``block_order, u``.  The rest of ``docs`` is not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    own = docs.select((row_col if row_col is not None else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("perm"))
    own = scratch.save(own, "own")
    plan = scratch.save(targets(own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")), max_repeat), "plan")
    if block is None:
        block = min(MOST_BLOCK, max(LEAST_BLOCK, (plan.agg(F.sum("source_size")).first()[0] or 0) // BLOCKS))
    plan = plan.withColumn("goal", F.floor(F.col("target") + 0.5).cast("long")).withColumn("buckets", F.ceil(F.sqrt("n_docs")).cast("int"))
    df = own.join(plan.select("source", "src", "source_size", "target", "goal", "buckets"), own["source"].eqNullSafe(plan["source"])).drop("source")
    df = df.withColumn("_b", F.floor(hash_share(F.col("perm")) * F.col("buckets")))
    df = scratch.save(before(df, ["src"], "_b", ["perm", "doc_id", "size", "row"], {"offset": "size"}), "line")

    # the root of the tree: each source's blocks in a seeded order, up to its target
    whole = F.col("source_size") * max_repeat
    ends = plan.filter("goal > 0").select("src", "goal", whole.alias("whole"), F.ceil(whole / F.lit(float(block))).cast("long").alias("n_blocks"))
    runs = ends.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_blocks") - 1) / 4096))))
    blocks = runs.repartition("src", "run").withColumn("block", F.explode(F.sequence(F.col("run") * 4096, F.least(F.col("run") * 4096 + 4095, F.col("n_blocks") - 1))))
    blocks = blocks.select("src", "block", "goal", F.least(F.lit(block), F.col("whole") - F.col("block") * block).alias("len"), F.md5(F.concat_ws(":", F.lit(str(seed)), "src", "block")).alias("perm"), F.ceil(F.sqrt("n_blocks")).alias("buckets"))
    blocks = blocks.withColumn("_b", F.floor(hash_share(F.col("perm")) * F.col("buckets")))
    blocks = before(blocks, ["src"], "_b", ["perm", "block"], {"ahead": "len"}).filter("ahead < goal")
    blocks = scratch.save(blocks.select("src", "block", F.least("len", F.col("goal") - F.col("ahead")).alias("len")), "blocks")
    drawn = split_tree(blocks.select("src", "block"), blocks.count(), shards, seed, scratch).join(blocks, ["src", "block"])

    pieces = df.filter("size > 0 and goal > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1)))).withColumn("at", F.col("epoch") * F.col("source_size") + F.col("offset"))
    pieces = pieces.withColumn("stop", F.col("at") + F.col("size"))
    pieces = pieces.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("stop") - 1) / block)))).join(drawn, ["src", "block"])
    begin, end = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("stop"), F.col("block") * block + F.col("len"))
    pieces = pieces.withColumn("start", begin - F.col("at")).withColumn("length", end - begin).filter("length > 0")
    pieces = pieces.withColumn("block_order", unit(F.lit(seed), "shard", "src", "block")).withColumn("u", unit(F.lit(seed + 1), "doc_id", "epoch", "start"))
    pieces = scratch.save(pieces.select("row", "doc_id", "src", "shard", "block_order", "u", "epoch", "start", "length"), "pieces")
    taken = pieces.groupBy("row").agg(F.sum("length").alias("taken"))
    out = df.select("row", "doc_id", "size", "source_size", "target").join(taken, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
    return out, pieces


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, block: int | None = None) -> DataFrame:
    """The mixed corpus with the columns of ``docs``, one row per piece that the mix takes, in its order.

    Ranges of ``shard, block_order, u`` become partitions, sorted by them, so a shard's blocks and the pieces of a block follow
    each other as drawn, and partitions follow the shards.  A piece that is a whole document keeps its text as it is; one that
    a block's edge or the target cuts holds its words, joined by single spaces.  Rows that repeat an identifier are told apart by
    their texts, equal ones share their pieces evenly.  ``n_chars``, where there is such a column, follows a shortened text.
    """
    names = docs.columns
    mine = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(source_col).alias("_source"))
    mine = mine.withColumn("_key", F.xxhash64(F.coalesce("_id", F.lit(-1)), F.sha2(F.coalesce("_text", F.lit("")), 256), F.coalesce("_source", F.lit(""))))
    parts, pieces = mix(mine, "_id", "_text", "_source", shards=shards, block=block, row_col=F.col("_key"))
    order = ["shard", "block_order", "u"]
    texts = mine.select("_key", "_row")
    if not parts.groupBy("row").count().filter("count > 1").isEmpty():
        # equal rows have the same key: each of the pieces that they have together is laid out once
        pieces, texts = pieces.dropDuplicates(["row", "epoch", "start", "length", *order]), texts.dropDuplicates(["_key"])
    drawn = pieces.join(parts.select("row", F.col("size").alias("_size")).distinct(), "row").select(F.col("row").alias("_key"), "_size", F.col("start").alias("_start"), F.col("length").alias("_length"), *[F.col(c).alias(f"_{c}") for c in order])
    out = texts.join(drawn, "_key")
    whole, text = F.col("_length") == F.col("_size"), F.col("_row").getField(text_col)
    cut = F.array_join(F.slice(words(text), (F.col("_start") + 1).cast("int"), F.col("_length").cast("int")), " ")
    changed = {text_col: F.when(whole, text).otherwise(cut)}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(whole, F.col("_row").getField("n_chars")).otherwise(F.length(cut).cast(kind))
    order = [f"_{c}" for c in order]
    out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    return out.select(*[changed.get(n, F.col("_row").getField(n)).alias(n) for n in names])
