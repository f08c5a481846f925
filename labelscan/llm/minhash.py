"""MinHash near-duplicates, verified in sequence by Bayes' rule.

A document is the set of its distinct word n-grams; equal sets are one class, so copies cost nothing further.  Each class has
``BANDS * ROWS`` minimal hashes.  Classes that agree on all hashes of a band are candidates: at a similarity of 0.85 a pair misses all 32
bands of 5 with a probability of 7e-9.

Candidates are compared batch by batch of their signatures (a byte of every hash).  With a uniform prior, the similarity of a pair
that agrees on m of n hashes has a Beta(m + 1, n - m + 1) posterior; as soon as the posterior probability of the asked
similarity falls below ``miss``, the pair is given up.  Bytes that agree by chance only keep a pair longer.  What survives the last
batch is confirmed on the whole sets, so no link is ever wrong, and one is missed with a probability of about ``miss`` a batch.

Families of near copies aren't enumerated pair by pair.  Each bucket of a band has a pivot, the member that meets most others over all its
buckets (what the others are copies of), and classes are verified with the pivots they meet.  Only members of a bucket outside its largest component are joined with its members at last, and there parity
bitmaps of the whole sets (a differing bit is a differing n-gram) rule out most pairs before they leave the join.  Hot buckets are dealt to
several tasks.

Edge cases: null and empty texts, and texts without words, have the empty set and link with nothing; a text of fewer words
than n is one n-gram; rows that repeat an identifier are one node, whatever their texts, and each row of the identifier that
stays is kept; a null identifier names no group that has another and is kept only where its group has none; equal sets go by the
smallest identifier; texts of any length are read whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, Scratch, among, bitmap
from .jaccard import BITMAP, TEXTS, Once, close_enough, components, key_of, lists, mixed, near_size, needed, renamed, sets, shingles

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Hashes of a batch; columns of a parity bitmap.
BATCH, BITS = 32, [f"bits_{k}" for k in range(BITMAP)]
#: n-grams hashed at once.
BLOCK = 2048
#: A bucket of more classes is dealt to so many tasks.
HOT, SALTS = 64, 16
MISS = 1e-6

SIGNED = "doc_id long, n int, key long, bands array<long>, signature array<long>"


def multipliers() -> np.ndarray:
    """Odd factors and offsets of the hash functions: the same everywhere."""
    x = np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = mixed(mixed(x) + np.uint64(0xC2B2AE3D27D4EB4F))
    return np.stack([x[:HASHES] | np.uint64(1), x[HASHES:]])


def minimal(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), BLOCK):
        own = s[k : k + BLOCK, None] * factors[0]
        own += factors[1]
        np.minimum(out, own.min(axis=0), out=out)
    return out


def band_keys(hashes: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in hashes.reshape(BANDS, ROWS).T:
        h = mixed(h * np.uint64(0xC2B2AE3D27D4EB4F) + row)
    return h.view(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(56)).astype(np.uint8)


def least_matches(n: int, p: float, miss: float) -> int:
    """Fewest agreements among n with which the posterior probability of at least p isn't below ``miss``.

    P(x >= p) under Beta(m + 1, n - m + 1) is the probability of at most m successes in n + 1 trials at p.
    """
    term, total = (1 - p) ** (n + 1), 0.0
    for m in range(n + 1):
        total += term
        if total >= miss:
            return m
        term *= (n + 1 - m) / (m + 1) * p / (1 - p)
    return n


def describe(n: int):
    """Set size and digest of every document; bands and signature where the task sees the set for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, factors = Once(), multipliers()
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                ids, sizes, keys, bands, signatures = [], [], [], [], []
                for i, s in shingles(batch.slice(k, TEXTS), n):
                    key = key_of(s)
                    ids.append(i)
                    sizes.append(len(s))
                    keys.append(key)
                    own = minimal(s, factors) if len(s) and once.new(key) else None
                    bands.append(np.empty(0, np.int64) if own is None else band_keys(own))
                    signatures.append(np.empty(0, np.int64) if own is None else signature(own).view(np.int64))
                numbers = pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(keys, pa.int64())
                yield pa.RecordBatch.from_arrays([*numbers, lists(bands), lists(signatures)], ["doc_id", "n", "key", "bands", "signature"])

    return run


def bytes_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(len(column), HASHES)


def entries(several, hot):
    """``bucket, key, n, salt`` of the members of buckets that may have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more, frequent = Bits(several.value), Bits(hot.value)
        for batch in batches:
            buckets = batch.column(2).flatten().to_numpy()
            at = np.flatnonzero(more.has(buckets))
            row, buckets = at // BANDS, buckets[at]
            key, n = batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            salt = np.where(frequent.has(buckets), (key.view(np.uint64) >> np.uint64(20)) % np.uint64(SALTS), np.uint64(SALTS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (buckets, key, n, salt)], ["bucket", "key", "n", "salt"])

    return run


def compared(percent: int, miss: float):
    """The pairs that no batch of their signatures rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [(k, least_matches(k + BATCH, percent / 100, miss)) for k in range(0, HASHES, BATCH)]
        for batch in batches:
            a, b = bytes_of(batch.column(4)), bytes_of(batch.column(5))
            left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
            for k, fewest in least:
                matches[left] += (a[left, k : k + BATCH] == b[left, k : k + BATCH]).sum(axis=1)
                left = left[matches[left] >= fewest]
            yield batch.select([0, 1, 2, 3]).take(pa.array(left))

    return run


def parities(n: int):
    """``key, bits`` of every row: which of 1024 places an odd number of the set's n-grams falls on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sets(n)(batches):
            keys, maps = batch.column(0), []
            for own in batch.column(1):
                at = own.values.to_numpy().view(np.uint64) >> np.uint64(40)
                odd = np.bincount((at & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
                maps.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            yield pa.RecordBatch.from_arrays([keys, lists(maps)], ["key", "bits"])

    return run


class Run:
    """Tables of one run: documents, classes, signatures and the index of buckets."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, miss: float):
        spark = docs.sparkSession
        self.n, self.percent, self.miss, self.scratch = n, percent, miss, Scratch(spark, "minhash")
        self.share = spark.sparkContext.broadcast
        self.own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        described = self.scratch.save(self.own.mapInArrow(describe(n), SIGNED), "described")
        self.rows = self.scratch.save(described.select("doc_id", "n", "key"), "rows")
        self.classes = self.scratch.save(self.rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("class_id")), "classes")
        signed = described.filter("size(signature) > 0").select("key", "n", "bands", "signature")
        # several tasks may have seen a set: a bucket counts only where its sets differ
        held = signed.select("key", F.explode("bands").alias("bucket")).groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("held"))
        held = self.scratch.save(held.filter("low <> high").select("bucket", "held"), "held")
        several, hot = (self.share(bitmap(held.filter(f"held > {k}"), "bucket")) for k in (1, HOT))
        met = signed.select("key", "n", "bands").mapInArrow(entries(several, hot), "bucket long, key long, n int, salt int").dropDuplicates(["bucket", "key"])
        met = self.scratch.save(met, "met")
        weight = met.join(self.dealt(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"), F.min("salt").alias("salt"))), ["bucket", "salt"]).groupBy("key").agg(F.sum("held").alias("weight"))
        self.index = self.scratch.save(met.join(weight, "key"), "index")
        self.cards = self.scratch.save(signed.join(self.index.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("key", "n", "signature"), "cards")
        self.scratch.drop("described")
        self.scratch.drop("held")
        self.scratch.drop("met")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b), those that link: signatures batch by batch, then the whole sets of the survivors."""
        both = pairs.join(renamed(self.cards, "a"), "a").join(renamed(self.cards, "b"), "b").filter(near_size(F.col("a_n"), F.col("b_n"), self.percent))
        both = both.select("a", "b", "a_n", "b_n", "a_signature", "b_signature").mapInArrow(compared(self.percent, self.miss), "a long, b long, a_n int, b_n int")
        pairs = self.scratch.save(both, f"{name}-pairs")
        keys = self.scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), f"{name}-keys")
        whole = self.scratch.save(self.again(keys, sets, "key long, grams array<long>"), f"{name}-sets").dropDuplicates(["key"])
        met = pairs.join(renamed(whole, "a"), "a").join(renamed(whole, "b"), "b")
        links = self.scratch.save(met.filter(F.size(F.array_intersect("a_grams", "b_grams")) >= needed(self.percent)).select("a", "b"), name)
        for done in ("keys", "sets", "pairs"):
            self.scratch.drop(f"{name}-{done}")
        return links

    @staticmethod
    def dealt(buckets: DataFrame) -> DataFrame:
        """A row of every bucket for each salt that its members have."""
        salts = F.when(F.col("salt") < SALTS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(SALTS)))
        return buckets.withColumn("salt", F.explode(salts))

    def pivots(self) -> DataFrame:
        """Pairs (a, b) of a class and a pivot that it meets."""
        per = self.index.groupBy("bucket").agg(F.max(F.struct("weight", "key", "n")).alias("top"), F.count(F.lit(1)).alias("held"), F.min("salt").alias("salt")).filter("held > 1")
        per = self.dealt(per.select("bucket", F.col("top.key").alias("pivot"), F.col("top.n").alias("pivot_n"), "salt"))
        met = self.index.join(per, ["bucket", "salt"]).filter((F.col("pivot") != F.col("key")) & near_size(F.col("n"), F.col("pivot_n"), self.percent))
        return met.select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b")).distinct()

    def again(self, keys: DataFrame, read, schema: str) -> DataFrame:
        """``read`` (of jaccard.sets' kind) over the texts of classes; the same class may come several times."""
        ids = keys.join(self.classes, "key").select(F.coalesce("class_id", F.lit(0)).alias("id"))
        wanted = among(self.own, F.col("doc_id"), ids, "wanted").filter("wanted").select("doc_id", "text")
        return wanted.mapInArrow(read(self.n), schema).join(keys, "key", "left_semi")

    def rest(self, found: DataFrame) -> DataFrame:
        """Candidates that lie in different components; in a bucket, those of the largest component meet only the others."""
        placed = self.index.select("bucket", "key", "n").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        sizes = placed.groupBy("bucket", "component").count()
        largest = sizes.groupBy("bucket").agg(F.max(F.struct("count", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
        placed = self.scratch.save(placed.join(largest.select("bucket", F.col("top.component").alias("largest")), "bucket"), "open")
        keys = self.scratch.save(placed.select("key").distinct(), "open-keys")
        maps = self.again(keys, parities, "key long, bits array<long>").dropDuplicates(["key"]).select("key", *[F.get("bits", F.lit(k)).alias(c) for k, c in enumerate(BITS)])
        placed = self.scratch.save(placed.withColumn("inside", F.col("component") == F.col("largest")).drop("largest").join(maps, "key"), "members")
        a, b = renamed(placed.filter("not inside"), "a", same=("bucket",)), renamed(placed, "b", same=("bucket",))
        once = F.col("b_inside") | (F.col("a") < F.col("b"))
        fits = once & (F.col("a_component") != F.col("b_component")) & near_size(F.col("a_n"), F.col("b_n"), self.percent) & close_enough(self.percent, BITS)
        out = self.scratch.save(a.join(b, "bucket").filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "rest")
        for done in ("open", "open-keys", "members"):
            self.scratch.drop(done)
        return out

    def connected(self) -> DataFrame:
        """``node, component`` of the classes that link with another."""
        scratch = self.scratch
        links = self.verified(self.pivots(), "pivoted")
        found = components(links, scratch, "first")
        rest = self.rest(found)
        if rest.isEmpty():
            return found
        more = self.verified(rest, "more")
        return found if more.isEmpty() else components(links.union(more), scratch, "last")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 85, miss: float = MISS) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id, kept`` of every row.

    ``class_id``: smallest identifier with the same set; ``component_id``: smallest that is reached by links; ``kept``: it is that one.
    """
    run = Run(docs, id_col, text_col, n, percent, miss)
    found, scratch = run.connected(), run.scratch
    # an identifier with several sets joins their components
    several = run.rows.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("doc_id", "low")
    several = scratch.save(several, "repeated")
    if not several.isEmpty():
        same = run.rows.filter("n > 0").join(several, "doc_id").select(F.col("key").alias("a"), F.col("low").alias("b"))
        found = components(found.toDF("a", "b").union(same), scratch, "all")
    placed = run.classes.join(found, run.classes["key"] == found["node"], "left").select("key", "class_id", F.coalesce("component", "key").alias("component"))
    names = placed.groupBy("component").agg(F.min("class_id").alias("component_id"))
    placed = scratch.save(placed.join(names, "component").select("key", "class_id", "component_id"), "placed")
    out = run.rows.join(placed, "key", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
