"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components.

A document is the set of its distinct word n-grams (64-bit hashes).  Equal sets are one class (a 64-bit digest), so copies cost
nothing further.  All sets are ordered by one global order, rare n-grams first.  If two sets link, they share at least
l n-grams among the first ``|x| - ceil(t |x|) + l`` of each; of the smaller one fewer still, ``|x| - ceil(2 t |x| / (1 + t)) + l``,
so its shorter part is the index and the longer parts probe it.  Each document chooses its own l: the estimated cost of its
candidates is weighed against the longer prefix, and a pair has to share as many prefix n-grams as the smaller l of both asks for.

The order: word counts of the whole corpus (a sketch) estimate how frequent an n-gram is if its words are
independent.  That misses phrases that many documents share, so the n-grams of provisional prefixes are counted exactly, one
aggregation of narrow rows, and those of more than ``HOT`` documents go last.  The same counts tell which n-grams a single
document has; these never enter the index.

Large families of near-copies are not enumerated pair by pair.  Each prefix n-gram has a pivot, the document where it comes first,
which is the one with the fewest n-grams of its own.  Documents are compared with the pivot they meet most often, then with the
other pivots that lie in another component; only pairs still in different components are joined at last.  Size,
position and parity bitmaps (a differing bit is a differing n-gram) bound the overlap from above before sets are compared, and
every link counted is confirmed on the whole sets.  Components come from large and small stars, in rounds until nothing is
left to move.  ``links`` gives every link between classes instead, without that short cut.

Edge cases: null and empty texts, and texts without words, have the empty set and link with nothing; a text of fewer words
than n is one n-gram; rows that repeat an identifier are one node, whatever their texts; a null identifier is smaller than none
and names no group that has another; texts of any length are read whole, and equally frequent n-grams are ordered by
their hash; an empty table gives an empty result; columns besides identifier and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bits, Scratch, among, bitmap

#: Counters of the word sketch and its rows of transport.
SKETCH, CHUNK = 1 << 20, 1 << 12
MATCHES = (1, 2, 4, 8)
#: An n-gram of more provisional prefixes than this goes last in the order.
HOT = 64
#: A hot n-gram's rows are dealt to so many tasks.
SALTS = 16
#: 64-bit words of a parity bitmap, and of its folded form.
BITMAP, FOLDED = 16, 4
#: Sets that a task remembers.
CACHE = 300_000
#: Texts and bytes of text that are hashed at once (a longer text alone); a word of more than LONG bytes is hashed by itself.
TEXTS, BYTES, LONG = 256, 1 << 20, 64

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: The first so many of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _A
    return h ^ (h >> np.uint64(29))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after the other, and where each text's begin; A-Z lower-cased, words between ASCII white space."""
    b = np.concatenate([data, np.zeros(8, np.uint8)])
    b += ((b - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~((b == 32) | ((b - np.uint8(9)) < 5))[:-8]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    size = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1 - starts
    eight = np.ndarray(len(data) + 1, "<u8", b, strides=(1,))
    h, left = size.astype(np.uint64), np.arange(len(size))
    for k in range(0, min(LONG, int(size.max(initial=0))), 8):
        left = left[size[left] > k] if k else left
        h[left] = mixed(h[left] * _B + (eight[starts[left] + k] & _FIRST[np.minimum(size[left] - k, 8)]) + _C)
    for k in np.flatnonzero(size > LONG):
        h[k] = xxhash.xxh3_64_intdigest(b[starts[k] : starts[k] + size[k]])
    return h, np.searchsorted(starts, offsets)


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Identifiers and ``words`` of a batch of identifier and text, TEXTS texts or BYTES bytes at a time."""
    ids, column = batch.column(0), batch.column(1).cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, min(at + TEXTS, int(np.searchsorted(offsets, offsets[at] + BYTES, "right")) - 1))
        yield ids[at:to].to_pylist(), *words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of hashed words, in order."""
    size = min(n, len(h))
    out = np.full(len(h) - size + 1 if size else 0, size, np.uint64)
    for k in range(size):
        out = mixed(out * _B + h[k : len(h) - size + 1 + k] + _C)
    return out


def firsts(s: np.ndarray) -> np.ndarray:
    """Which of sorted hashes differ from the one before."""
    return np.concatenate([np.ones(min(1, len(s)), bool), s[1:] != s[:-1]])


def ngrams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of each text's hashed words, where each text's begin, and the first word of each."""
    held = np.diff(bounds)
    ends = np.concatenate([[0], np.cumsum(np.where(held >= n, held - n + 1, np.minimum(held, 1)))])
    place = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], np.diff(ends))
    every = windows(h, n)
    g = every[np.minimum(place, len(every) - 1)]
    for k in np.flatnonzero((held > 0) & (held < n)):
        g[ends[k]] = windows(h[bounds[k] : bounds[k + 1]], n)[0]
    return g, ends, place


def distinct(g: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of n-grams, sorted within each text, are its first of their kind, and where each text's begin among these."""
    first = firsts(g)
    first[ends[:-1][np.diff(ends) > 0]] = True
    return first, np.concatenate([[0], np.cumsum(first)])[ends]


def shingles(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Identifier and sorted distinct hashes of the word n-grams of each row."""
    for ids, h, bounds in blocks(batch):
        g, ends, _ = ngrams(h, bounds, n)
        for a, b in zip(ends, ends[1:]):
            g[a:b].sort()
        first, at = distinct(g, ends)
        s = g[first]
        yield from ((i, s[a:b]) for i, a, b in zip(ids, at, at[1:]))


def weighed(batch: pa.RecordBatch, n: int, logs: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Identifiers, ``shingles``, the logarithm of the number of places where words as frequent would meet by chance, and where each text's begin."""
    for ids, h, bounds in blocks(batch):
        g, ends, place = ngrams(h, bounds, n)
        own = logs[(h & np.uint64(SKETCH - 1)).astype(np.int64)]
        # of a text of fewer words than n, all that it has
        size = np.repeat(np.minimum(np.diff(bounds), n), np.diff(ends))
        chance = own[place]
        for k in range(1, n):
            more = size > k
            chance[more] += own[place[more] + k]
        chance -= (size - 1).astype(np.float32) * logs[-1]
        order = np.concatenate([a + np.argsort(g[a:b]) for a, b in zip(ends, ends[1:])])
        # equal n-grams have equal chances, so any of their places does
        g = g[order]
        first, at = distinct(g, ends)
        yield ids, g[first], chance[order[first]], at


def ranked(chance: np.ndarray, at: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    """Numbers that sort as (last, chance, n-gram) does within a text; their lower 31 bits are the n-gram's place in the text's set."""
    x = (chance + np.float32(0)).view(np.uint32).astype(np.uint64)
    x = np.where(x >> np.uint64(31), x ^ np.uint64(0xFFFFFFFF), x | np.uint64(1 << 31)) << np.uint64(31)
    x |= (np.arange(len(x)) - np.repeat(at[:-1], np.diff(at))).astype(np.uint64)
    return x if last is None else x | (last.astype(np.uint64) << np.uint64(63))


def lowest(x: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` lowest ``ranked`` numbers of a text, in order."""
    x = np.sort(np.partition(x, most - 1)[:most]) if most < len(x) else np.sort(x)
    return (x & np.uint64((1 << 31) - 1)).astype(np.int64)


def key_of(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task's word counts: chunk, counters."""
    counts = np.zeros(SKETCH, np.int64)
    for batch in batches:
        for _, h, _ in blocks(batch):
            np.add.at(counts, (h & np.uint64(SKETCH - 1)).astype(np.int64), 1)
    used = [c for c in range(0, SKETCH, CHUNK) if counts[c : c + CHUNK].any()]
    yield pa.RecordBatch.from_arrays([pa.array([c // CHUNK for c in used], pa.int32()), pa.array([counts[c : c + CHUNK].tobytes() for c in used], pa.binary())], ["chunk", "counts"])


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, b in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(b.as_py(), np.int64)
            sums[c] = sums[c] + own if c in sums else own
    yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])


def word_logs(own: DataFrame, parts: int) -> np.ndarray:
    """Logarithms of the SKETCH word counters of all texts, then that of their sum; as large for any corpus."""
    out = np.zeros(SKETCH, np.int64)
    for r in own.mapInArrow(count_words, "chunk int, counts binary").repartition(min(parts, SKETCH // CHUNK), "chunk").mapInArrow(add_up, "chunk int, counts binary").toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return np.log(np.maximum(np.append(out, out.sum()), 1)).astype(np.float32)


def least(n: int, percent: int) -> int:
    """The fewest n-grams that a set of n shares with any set it links to."""
    return -(-percent * n // 100)


def least_of_larger(n: int, percent: int) -> int:
    """The fewest n-grams that a set of n shares with a set it links to that is no smaller."""
    return -(-2 * percent * n // (100 + percent))


def provisional(n: int, percent: int) -> int:
    """How many n-grams of a set are counted."""
    first = n - least(n, percent)
    return min(n, first + first // 2 + MATCHES[-1])


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


class Once:
    """Tells the keys that a task has seen already, within a bound of memory."""

    def __init__(self):
        self.keys: set[int] = set()

    def new(self, key: int) -> bool:
        if len(self.keys) >= CACHE:
            self.keys.clear()
        size = len(self.keys)
        self.keys.add(key)
        return len(self.keys) > size


DESCRIBED = "doc_id long, n int, key long, grams array<long>"
PREFIXES = "key long, n int, l int, near int, prefix array<long>, late array<long>, bits array<long>"
INDEX = "gram long, key long, n int, l int, pos int, indexed boolean, salt int"


def describe(n: int, percent: int, logs):
    """Set size and digest of every document; its provisional prefix where the task sees the set for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = Once()
        for batch in batches:
            for ids, grams, chance, at in weighed(batch, n, logs.value):
                rank = ranked(chance, at)
                keys, arrays = [], []
                for a, b in zip(at, at[1:]):
                    s = grams[a:b]
                    key = key_of(s)
                    keys.append(key)
                    arrays.append(s[lowest(rank[a:b], provisional(len(s), percent))].view(np.int64) if len(s) and once.new(key) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.diff(at), pa.int32()), pa.array(keys, pa.int64()), lists(arrays)], ["doc_id", "n", "key", "grams"])

    return run


def prefixes(n: int, percent: int, logs, hot):
    """Prefix, its l, how much of it is index (``near``), the n-grams nobody has counted (``late``) and parity bitmap of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, frequent = Once(), Bits(hot.value)
        places = np.uint64(64 * BITMAP - 1)
        for batch in batches:
            for _, grams, chances, at in weighed(batch, n, logs.value):
                lasts = frequent.has(grams)
                rank, plain = ranked(chances, at, lasts), ranked(chances, at)
                odd = np.repeat(np.arange(len(at) - 1) * 64 * BITMAP, np.diff(at)) + ((grams >> np.uint64(40)) & places).astype(np.int64)
                odd = (np.bincount(odd, minlength=(len(at) - 1) * 64 * BITMAP) & 1).astype(np.uint8).reshape(-1, 64 * BITMAP)
                bits = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
                keys, sizes, ls, nears, arrays, later, maps = [], [], [], [], [], [], []
                for k, (a, b) in enumerate(zip(at, at[1:])):
                    s, last = grams[a:b], lasts[a:b]
                    if not len(s) or not once.new(key := key_of(s)):
                        continue
                    t = least(len(s), percent)
                    first = len(s) - t
                    own = lowest(rank[a:b], min(len(s), first + MATCHES[-1]))
                    others = np.where(last[own], HOT, np.minimum(np.maximum(np.exp(chances[a:b][own]) - 1, 0), HOT))
                    total = np.cumsum(others)
                    costs = [(first + m + total[first + m - 1] + len(s) / 8 * total[first + m - 1] / m, m) for m in MATCHES if m <= t]
                    m = min(costs)[1]
                    own = own[: first + m]
                    keys.append(key)
                    sizes.append(len(s))
                    ls.append(m)
                    nears.append(len(s) - least_of_larger(len(s), percent) + m)
                    arrays.append(s[own].view(np.int64))
                    # without n-grams that go last, all of them have been counted
                    late = np.setdiff1d(own, lowest(plain[a:b], provisional(len(s), percent))) if last.any() else own[:0]
                    later.append(s[late].view(np.int64))
                    maps.append(bits[k])
                numbers = [pa.array(x, pa.int32()) for x in (sizes, ls, nears)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *numbers, lists(arrays), lists(later), lists(maps)], ["key", "n", "l", "near", "prefix", "late", "bits"])

    return run


def entries(hot, several, late):
    """INDEX rows of the prefix n-grams that more than one document may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, more, uncounted = (Bits(b.value) for b in (hot, several, late))
        for batch in batches:
            column = batch.column(4)
            sizes = np.diff(column.offsets.to_numpy())
            grams = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            pos = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(more.has(grams) | uncounted.has(grams))
            grams, row, pos = grams[at], row[at], pos[at].astype(np.int32)
            key, n, l, near = (batch.column(k).to_numpy()[row] for k in range(4))
            salt = np.where(frequent.has(grams), (key.view(np.uint64) >> np.uint64(20)) % np.uint64(SALTS), np.uint64(SALTS)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (grams, key, n, l, pos, pos < near, salt)], ["gram", "key", "n", "l", "pos", "indexed", "salt"])

    return run


def sets(n: int):
    """``key, grams`` (the whole set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                arrays = [s for _, s in shingles(batch.slice(k, TEXTS), n)]
                yield pa.RecordBatch.from_arrays([pa.array(map(key_of, arrays), pa.int64()), lists([s.view(np.int64) for s in arrays])], ["key", "grams"])

    return run


def needed(percent: int) -> Column:
    """The least overlap of linked sets of sizes a_n and b_n."""
    return F.ceil(F.lit(percent) * (F.col("a_n") + F.col("b_n")) / F.lit(100 + percent))


def near_size(a: Column, b: Column, percent: int) -> Column:
    return (a * 100 >= percent * b) & (b * 100 >= percent * a)


def close_enough(percent: int, names: list[str]) -> Column:
    """False only where the parity bitmaps prove that the sets can't link."""
    apart = sum(F.bit_count(F.col(f"a_{k}").bitwiseXOR(F.col(f"b_{k}"))) for k in names)
    return apart <= F.col("a_n") + F.col("b_n") - 2 * needed(percent)


def renamed(df: DataFrame, name: str, key: str = "key", same: tuple = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in same else F.col(c).alias(name if c == key else f"{name}_{c}") for c in df.columns])


class Join:
    """Index, cards (size and bitmap of each class) and checks of one run."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int):
        spark = docs.sparkSession
        self.n, self.percent, self.scratch = n, percent, Scratch(spark, "jaccard")
        self.share = spark.sparkContext.broadcast
        self.own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        logs = self.share(word_logs(self.own, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        described = self.scratch.save(self.own.mapInArrow(describe(n, percent, logs), DESCRIBED), "described")
        self.rows = self.scratch.save(described.select("doc_id", "n", "key"), "rows")
        self.classes = self.scratch.save(self.rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("class_id")), "classes")

        counts = described.select(F.explode("grams").alias("gram")).groupBy("gram").count().filter("count > 1")
        counts = self.scratch.save(counts, "counts")
        self.scratch.drop("described")
        hot, several = (self.share(bitmap(counts.filter(f"count > {k}"), "gram")) for k in (HOT, 1))
        chosen = self.scratch.save(self.own.mapInArrow(prefixes(n, percent, logs, hot), PREFIXES), "prefixes")
        late = self.share(bitmap(chosen.select(F.explode("late").alias("gram")), "gram"))
        index = chosen.select("key", "n", "l", "near", "prefix").mapInArrow(entries(hot, several, late), INDEX)
        self.index = self.scratch.save(index.dropDuplicates(["gram", "key"]), "index")
        self.full, self.folded = [str(k) for k in range(BITMAP)], [f"f{k}" for k in range(FOLDED)]
        met = self.index.select("key").distinct()
        cards = chosen.join(met, "key", "left_semi").dropDuplicates(["key"]).select("key", "n", *[F.get("bits", k).alias(c) for k, c in enumerate(self.full)])
        self.cards = self.scratch.save(cards, "cards")
        self.scratch.drop("counts")
        self.scratch.drop("prefixes")

    def checked(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b), those whose whole sets link; only texts of documents in pairs are read again."""
        near = pairs.join(renamed(self.cards, "a"), "a").join(renamed(self.cards, "b"), "b").filter(near_size(F.col("a_n"), F.col("b_n"), self.percent) & close_enough(self.percent, self.full))
        pairs = self.scratch.save(near.select("a", "b", "a_n", "b_n"), f"{name}-pairs")
        keys = self.scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), f"{name}-keys")
        ids = keys.join(self.classes, "key").select(F.coalesce("class_id", F.lit(0)).alias("id"))
        wanted = among(self.own, F.col("doc_id"), ids, "wanted").filter("wanted").select("doc_id", "text")
        whole = wanted.mapInArrow(sets(self.n), "key long, grams array<long>").join(keys, "key", "left_semi")
        # one exchange by key serves the removal of repeats and both sides of the comparison
        whole = self.scratch.save(whole, f"{name}-sets").dropDuplicates(["key"])
        both = pairs.join(renamed(whole, "a"), "a").join(renamed(whole, "b"), "b")
        links = self.scratch.save(both.filter(F.size(F.array_intersect("a_grams", "b_grams")) >= needed(self.percent)).select("a", "b"), name)
        self.scratch.drop(f"{name}-keys")
        self.scratch.drop(f"{name}-sets")
        self.scratch.drop(f"{name}-pairs")
        return links

    def candidates(self, rows: DataFrame, apart: Column | None = None) -> DataFrame:
        """Pairs (a, b) of index rows that share as many prefix n-grams as they must."""
        a, b = renamed(rows, "a", same=("gram",)), renamed(rows.drop("salt"), "b", same=("gram",))
        smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
        reach = F.least("a_pos", "b_pos") + 1 + F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos")) - 1
        fits = smaller & F.col("a_indexed") & near_size(F.col("a_n"), F.col("b_n"), self.percent) & (reach >= needed(self.percent))
        if self.folded[0] in rows.columns:
            fits = fits & close_enough(self.percent, self.folded)
        if apart is not None:
            fits = fits & apart
        met = a.join(b, "gram").filter(fits).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("a_l").alias("l"), F.first("b_l").alias("k"))
        return met.filter(F.col("shared") >= F.least("l", "k")).select("a", "b")

    def with_bitmap(self, rows: DataFrame) -> DataFrame:
        """Adds the bitmap folded to a quarter, a parity bitmap too and narrow enough to travel with every n-gram."""
        fold = lambda k: F.col(self.full[k]).bitwiseXOR(F.col(self.full[k + 4])).bitwiseXOR(F.col(self.full[k + 8])).bitwiseXOR(F.col(self.full[k + 12]))
        return rows.join(self.cards.select("key", *[fold(k).alias(f) for k, f in enumerate(self.folded)]), "key")

    def pivots(self) -> DataFrame:
        """``key, pivot, shared``: the pivots that a class meets, and at how many n-grams."""
        per = self.index.groupBy("gram").agg(F.min(F.struct("pos", "key", "n")).alias("p"), F.count(F.lit(1)).alias("held"), F.min("salt").alias("salt")).filter("held > 1")
        salts = F.when(F.col("salt") < SALTS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(SALTS)))
        per = per.select("gram", "p", F.explode(salts).alias("salt"))
        met = self.index.join(per, ["gram", "salt"]).filter((F.col("p.key") != F.col("key")) & near_size(F.col("n"), F.col("p.n"), self.percent))
        return self.scratch.save(met.groupBy("key", F.col("p.key").alias("pivot")).agg(F.count(F.lit(1)).alias("shared")), "pivots")

    def stars(self) -> tuple[DataFrame, DataFrame]:
        """Links with pivots, and the components they make."""
        met = self.pivots()
        pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        best = met.groupBy("key").agg(F.max(F.struct("shared", "pivot")).getField("pivot").alias("pivot"))
        links = self.checked(best.select(*pair("key", "pivot")).distinct(), "best")
        found = components(links, self.scratch, "first")
        rest = met.select("key", "pivot").join(best, ["key", "pivot"], "left_anti")
        rest = rest.join(found.toDF("key", "u"), "key", "left").join(found.toDF("pivot", "v"), "pivot", "left").filter(F.coalesce("u", "key") != F.coalesce("v", "pivot"))
        rest = self.scratch.save(rest.select(*pair("key", "pivot")).distinct(), "others")
        if not rest.isEmpty():
            links = links.union(self.checked(rest, "other"))
            found = components(links, self.scratch, "second")
        return links, found

    def connected(self) -> DataFrame:
        """``node, component`` of the classes that link with another."""
        stars, found = self.stars()
        placed = self.index.select("gram", "key", "n", "l", "pos", "indexed").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        open_ = placed.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("gram")
        placed = self.scratch.save(self.with_bitmap(placed.join(open_, "gram", "left_semi")), "open")
        rest = self.scratch.save(self.candidates(placed, F.col("a_component") != F.col("b_component")), "rest")
        self.scratch.drop("open")
        if rest.isEmpty():
            return found
        more = self.checked(rest, "more")
        return found if more.isEmpty() else components(stars.union(more), self.scratch, "last")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` (its smallest node) of the undirected links ``a, b``; nodes without links are left out.

    Alternates large stars (larger neighbours move to the smallest neighbour) and small stars (smaller ones do), which
    keeps what is connected, until every node hangs on a root: rounds grow with the logarithm of a chain's length.
    """
    edges = scratch.save(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    k = 0
    while not (edges.groupBy("a").count().filter("count > 1").isEmpty() and edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty()):
        k += 1
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = scratch.save(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct(), f"{name}-large-{k}")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = scratch.save(low.select("a", F.col("low").alias("b")).union(moved).distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-large-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of every row.

    ``class_id``: smallest identifier with the same set; ``component_id``: smallest that is reached by links.
    """
    run = Join(docs, id_col, text_col, n, percent)
    found, scratch = run.connected(), run.scratch
    # an identifier with several sets joins their components
    keyed = run.rows.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("doc_id", "low")
    keyed = scratch.save(keyed, "repeated")
    if not keyed.isEmpty():
        same = run.rows.filter("n > 0").join(keyed, "doc_id").select(F.col("key").alias("a"), F.col("low").alias("b"))
        found = components(found.toDF("a", "b").union(same), scratch, "all")
    placed = run.classes.join(found, run.classes["key"] == found["node"], "left").select("key", "class_id", F.coalesce("component", "key").alias("component"))
    names = placed.groupBy("component").agg(F.min("class_id").alias("component_id"))
    placed = scratch.save(placed.join(names, "component").select("key", "class_id", "component_id"), "placed")
    out = run.rows.join(placed, "key", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``doc_id, class_id, n_links`` of every row, and every linked pair of classes ``a, b`` (smallest identifiers).

    ``n_links``: classes that link with the row's class, its own left out.  As large as the number of links: a family of
    f different texts that all link has f (f - 1) / 2.
    """
    run = Join(docs, id_col, text_col, n, percent)
    pairs = run.checked(run.candidates(run.with_bitmap(run.index)), "links")
    count = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    members = run.rows.join(run.classes, "key", "left").join(count, "key", "left")
    members = members.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    named = pairs.join(run.classes.toDF("a", "x"), "a").join(run.classes.toDF("b", "y"), "b")
    return members, named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-copies (the smallest identifier) stays, with its columns.

    Only rows that a bitmap of the identifiers to drop lets through are joined; the others stay where they lie.
    """
    gone = join(docs, id_col, text_col, n, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    gone = Scratch(docs.sparkSession, "near-copies").save(gone, "gone")
    asked = max(docs.columns, key=len) + "_asked"  # no other column's name
    parts = among(docs, docs[id_col].cast("long"), gone, asked)
    hit = parts.filter(F.col(asked)).drop(asked)
    hit = hit.join(gone.select(F.col("doc_id").alias("_gone_id")), hit[id_col].cast("long") == F.col("_gone_id"), "left_anti")
    return parts.filter(~F.col(asked)).drop(asked).unionByName(hit)
