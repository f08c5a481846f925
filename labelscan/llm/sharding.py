"""Sharding by balanced label propagation under capacity quotas.

Documents with equal texts are linked (through their group, so a group of g copies has g links, not g^2).  Labels
(shards) start even, by hash.  In each round a join brings every document the shard in which most bytes of its neighbours
lie; those elsewhere ask to move; each shard admits as much as its capacity, its load and the leavers leave room
for, and whole groups are admitted or not; rounds end when none asks or what asks no longer shrinks.  A group larger than a fraction of the corpus is propagated in parts, so that a hot group can
spread over shards.  At last the documents are laid on a line in the order of their shards, linked ones in the
middle of each, and the line is cut into equal numbers of bytes: the balance is exact to a document, and what the cuts
move are mostly documents without links.

Law: ``bytes``.  Loads, flows and the starts of shards (a few numbers per shard) reach the driver, nothing else.

Edge cases: a null text counts as none (size 1); rows that repeat an identifier are separate documents; all documents in one
group are still spread evenly; ties between shards fall to a hash; texts of any length count by their bytes; an empty table gives an
empty result; more columns are not looked at, whatever their names.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, before, unit

SHARDS = 8
SLACK = 0.02
PARTS = 128
#: A group of more than this part of all rows is joined by broadcast.
LARGE = 1000


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slack: float = SLACK, seed: int = 7) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, group_rows, label`` of every row (``label``: before the last balancing)."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("group"))
    own = scratch.save(own, "own")
    n, total = own.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not n:
        return own.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("group_rows"), F.lit(0).alias("label"))
    groups = own.groupBy("group").agg(F.count(F.lit(1)).alias("group_rows"), F.sum("size").alias("group_size")).filter("group_rows > 1")
    groups = scratch.save(groups, "groups")
    large = F.broadcast(groups.filter(F.col("group_rows") * LARGE > n))  # fewer than LARGE rows
    linked = own.join(large, "group").unionByName(own.join(large.select("group"), "group", "left_anti").join(groups, "group"))
    parts = F.ceil(F.greatest(F.col("group_size") / (total / PARTS), F.col("group_rows") / (n / PARTS)))
    linked = linked.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int"))
    start = F.floor(unit(F.lit(seed), "row") * shards).cast("int")
    at = scratch.save(linked.select("row", "doc_id", "size", "text_crc32", "group", "part", "group_rows", start.alias("shard")), "round-0")
    single = own.join(large.select("group"), "group", "left_anti").join(groups.select("group"), "group", "left_anti").select("row", "doc_id", "size", "text_crc32", "group", F.lit(0).alias("part"), F.lit(1).cast("long").alias("group_rows"), start.alias("shard"))
    single = scratch.save(single, "single")
    alone = {r["shard"]: r["b"] for r in single.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    cap = total / shards * (1 + slack)
    k, before_ = 0, None
    while True:
        k += 1
        load = {r["shard"]: r["b"] for r in at.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
        most = at.groupBy("group", "part", "shard").agg(F.sum("size").alias("b")).groupBy("group", "part").agg(F.max(F.struct("b", unit(F.lit(seed + k), "group", "part", "shard"), "shard")).getField("shard").alias("to"))
        asked = at.join(most, ["group", "part"])
        flow = asked.filter("shard <> to").groupBy("shard", "to").agg(F.sum("size").alias("b")).collect()
        asking = sum(r["b"] for r in flow)
        if not flow or (before_ is not None and asking >= before_):  # settled, or quotas let no more through
            break
        before_ = asking
        into, out = dict.fromkeys(range(shards), 0), dict.fromkeys(range(shards), 0)
        for r in flow:
            into[r["to"]] += r["b"]
            out[r["shard"]] += r["b"]
        # documents without links fill what linked ones leave free, so a shard may hold linked ones up to its capacity
        room = {s: max(0.0, cap - load.get(s, 0) + out[s] / 2) for s in range(shards)}
        admit = F.array(*[F.lit(min(1.0, room[s] / into[s]) if into[s] else 1.0) for s in range(shards)])
        moves = unit(F.lit(seed - k), "group", "part") < F.element_at(admit, F.col("to") + 1)
        at = scratch.save(asked.withColumn("shard", F.when(moves, F.col("to")).otherwise(F.col("shard"))).select(*at.columns), f"round-{k}")
        scratch.drop(f"round-{k - 1}")
    # unlinked documents are dealt anew, to what linked ones leave of each shard
    load = {r["shard"]: r["b"] for r in at.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    free = [max(0.0, total / shards - load.get(s, 0)) for s in range(shards)]
    edges = [sum(free[: s + 1]) / (sum(free) or 1.0) for s in range(shards)]
    u = unit(F.lit(seed), "row")
    dealt = sum((u >= e).cast("int") for e in edges[:-1]) if alone and shards > 1 else F.lit(0)
    single = single.withColumn("shard", dealt.cast("int"))
    every = at.unionByName(single).withColumn("label", F.col("shard"))
    # position on the line: the shard, then a third of the rest for unlinked, linked, unlinked documents
    spread = unit(F.lit(seed + 99), "group", "part")
    side = F.when(F.col("group_rows") > 1, 1).when(unit(F.lit(seed + 98), "row") < 0.5, 0).otherwise(2)
    every = every.withColumn("x", F.col("shard") + (side + spread) / 3.0)
    buckets = max(1, ceil(sqrt(n) / shards))
    every = every.withColumn("_b", F.floor(F.col("x") * buckets)).withColumn("one", F.lit(1).cast("long"))
    every = before(every, [], "_b", ["x", "group", "part", "row"], {"ahead": "size", "index": "one"})
    every = every.withColumn("shard", F.least(F.floor((F.col("ahead") + F.col("size") / 2) * shards / F.lit(total)), F.lit(shards - 1)).cast("int"))
    every = scratch.save(every.select("doc_id", "size", "text_crc32", "shard", "index", "group_rows", "label"), "line")
    first = {r["shard"]: r["i"] for r in every.groupBy("shard").agg(F.min("index").alias("i")).collect()}
    starts = F.array(*[F.lit(first.get(s, 0)) for s in range(shards)])
    return every.withColumn("slot", (F.col("index") - F.element_at(starts, F.col("shard") + 1)).cast("long")).drop("index")
