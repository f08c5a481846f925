"""Phrase collocations: words that stand together more often than their parts do apart.

Texts are cut into pieces; identical pieces of a language are counted once, with a multiplicity.  Phrases are counted by length.
A task counts the phrases of many pieces at once, weighted, and deals what it has to hash buckets; per bucket, duckdb adds up the
counts out of core (it spills below the task's own folder, which is gone with the task).  A phrase is counted only where both phrases of one
word less in it are frequent: a bitmap of those, of bounded size, leaves some too many through, never one too few.

What a phrase's parts count is asked for by requests: rows of (part, phrase, cut) that are shuffled to the counts of the part, and
answers that are gathered by phrase.  Parts that make up a thousandth of all words (1,000 at most, whatever the corpus)
are asked for by so many phrases that their counts are broadcast instead.  The best phrases of a language are found by a histogram of
scores first, then in two steps, so no task sees more of a language than its best.

Edge cases: a null text counts as empty, a null language as ``und`` (and is one with a language of that name); texts and pieces
without words give nothing; repeated rows count each; pieces of any length are read whole; equal scores of a phrase's cuts go to
the shortest first part, equally good phrases follow each other by count, then by bytes; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import string
import tempfile
from collections.abc import Callable, Iterator
from functools import reduce

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Bits, Scratch, bitmap
from .jaccard import mixed

#: What separates pieces, and the language of texts that name none: fixed values.
BREAKS, NO_LANG = r"[.,;:!?\x0A-\x0D]", "und"
#: Bytes of pieces that a task counts at once, and what duckdb may hold of a bucket in memory.
GATHERED, MEMORY = 12 << 20, "256MB"
#: A part is hot if it makes up at least one in so many words.
HOT = 1000
#: Width of a step of the score histogram; a language's phrases are ranked in so many groups first.
STEP, GROUPS = 100, 64
SCALE = 2_000_000

COUNTED = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("times", pa.int64())])
FREQUENT = "lang string, gram string, f long, key long"


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, piece, times``: distinct pieces, their words joined by single spaces, and how often each occurs."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG))
    cut = docs.select(lang.alias("lang"), F.explode_outer(F.split(text, BREAKS)).alias("piece"))
    odd = F.contains("piece", F.lit("\t")) | F.contains("piece", F.lit("  "))
    piece = F.trim(F.when(odd, F.regexp_replace("piece", r"[\x20\x09]+", " ")).otherwise(F.col("piece")))
    return cut.select("lang", piece.alias("piece")).filter("piece <> ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("times"))


def hashed(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def chained(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Keys of phrases one word longer."""
    return mixed(h * np.uint64(0xC2B2AE3D27D4EB4F) + x)


def words_of(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes of the words in order, what they stand for, and the number of words of each row."""
    lists = pc.split_pattern(column, " ")
    flat = lists.flatten().dictionary_encode()
    return flat.indices.to_numpy().astype(np.int64), flat.dictionary, np.diff(lists.offsets.to_numpy())


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GATHERED:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def occurrences(size: int, frequent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Weighted counts of the phrases of ``size`` words, of those that may be frequent, per gathered pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent and Bits(frequent.value)
        for own in gathered(batches):
            word, vocabulary, sizes = words_of(own.column("piece").combine_chunks())
            langs = own.column("lang").combine_chunks().dictionary_encode()
            lang, times = (np.repeat(x, sizes) for x in (langs.indices.to_numpy().astype(np.int64), own.column("times").to_numpy()))
            starts = max(0, len(word) - size + 1)
            left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))
            fits = left[:starts] >= size
            if known:
                own_hash = hashed(vocabulary)[word]
                h = chained(hashed(langs.dictionary)[lang], own_hash)
                for k in range(1, size - 1):
                    h = chained(h[:-1], own_hash[k:])
                may = known.has(h)
                fits &= may[:starts] & may[1 : starts + 1]
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            # exact codes of the phrases: the phrase so far gets a code before each further word
            code = lang[at] * len(vocabulary) + word[at]
            for k in range(1, size):
                code = np.unique(code, return_inverse=True)[1] * len(vocabulary) + word[at + k]
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            sums, at = np.add.reduceat(times[at[order]], first), at[order[first]]
            grams = pc.binary_join_element_wise(*[vocabulary.take(pa.array(word[at + k])) for k in range(size)], " ")
            out = pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang[at])), grams, pa.array(sums)], schema=COUNTED)
            for k in range(0, out.num_rows, 50_000):
                yield out.slice(k, 50_000)

    return run


def added(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per hash bucket: the phrases that occur ``least`` times or more, and their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"memory_limit": MEMORY, "temp_directory": spill, "threads": 1, "preserve_insertion_order": False}) as con:
            counts = pa.RecordBatchReader.from_batches(COUNTED, (b.cast(COUNTED) for b in batches))
            con.register("counts", counts)
            found = con.sql(f"SELECT lang, gram, sum(times)::BIGINT AS f FROM counts GROUP BY ALL HAVING sum(times) >= {int(least)}")
            for batch in found.to_arrow_reader(10_000):
                lang, gram = (batch.column(k).cast(pa.string()) for k in (0, 1))
                word, vocabulary, sizes = words_of(gram)
                word, h = hashed(vocabulary)[word].reshape(len(batch), -1), hashed(lang)
                for k in range(word.shape[1] if len(batch) else 0):
                    h = chained(h, word[:, k])
                yield pa.RecordBatch.from_arrays([lang, gram, batch.column(2), pa.array(h.view(np.int64))], ["lang", "gram", "f", "key"])

    return run


def frequent_grams(cut: DataFrame, longest: int, least: int, scratch: Scratch) -> list[DataFrame]:
    """FREQUENT rows of the phrases of 1, 2, ... ``longest`` words."""
    levels: list[DataFrame] = []
    for size in range(1, longest + 1):
        known = levels and cut.sparkSession.sparkContext.broadcast(bitmap(levels[-1], "key"))
        counts = cut.mapInArrow(occurrences(size, known), "lang string, gram string, times long")
        levels.append(scratch.save(counts.repartition("lang", "gram").mapInArrow(added(least), FREQUENT), f"level-{size}"))
    return levels


def joined(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def not_covered(levels: list[DataFrame], percent: int) -> DataFrame:
    """``lang, phrase, size, a`` of the candidates that no longer candidate around them nearly always accompanies."""
    inner = []
    for size, level in enumerate(levels, 1):
        words = F.split("gram", " ")
        subs = [joined(words, F.lit(i), F.lit(n)) for n in range(2, size) for i in range(1, size - n + 2)]
        if subs:
            inner.append(level.select("lang", F.explode(F.array(*subs)).alias("gram"), "f"))
    candidates = reduce(DataFrame.unionByName, [level.select("lang", "gram", F.lit(size).alias("size"), F.col("f").alias("a")) for size, level in enumerate(levels, 1) if size > 1])
    if inner:
        longer = reduce(DataFrame.union, inner).groupBy("lang", "gram").agg(F.max("f").alias("longer"))
        exact = lambda c: F.col(c).cast("decimal(19,0)")
        candidates = candidates.join(longer, ["lang", "gram"], "left").filter(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * percent)).drop("longer")
    return candidates.withColumnRenamed("gram", "phrase")


def answered(candidates: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``lang, phrase, size, a, k, left, f``: what both parts count, for every cut of every candidate."""
    words = F.split("phrase", " ")
    ask = lambda k, left, part: F.struct(k.alias("k"), F.lit(left).alias("left"), part.alias("gram"))
    parts = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.array(ask(k, True, joined(words, F.lit(1), k)), ask(k, False, joined(words, k + 1, F.col("size") - k))))
    requests = candidates.select("*", F.explode(F.flatten(parts)).alias("asked")).select("lang", "phrase", "size", "a", "asked.*")
    hot = F.broadcast(counts.filter(F.col("f").cast("decimal(19,0)") * HOT >= total))
    rest = requests.join(hot, ["lang", "gram"], "left_anti").join(counts, ["lang", "gram"])
    return rest.unionByName(requests.join(hot, ["lang", "gram"]))


def scored(answers: DataFrame, longest: int) -> DataFrame:
    """``lang, phrase, a, l, r, score``: the cut with the lowest score counts, of equal ones the first."""
    part = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f")))
    cuts = range(1, longest)
    both = answers.groupBy("lang", "phrase", "a").agg(*[part(k, True).alias(f"l{k}") for k in cuts], *[part(k, False).alias(f"r{k}") for k in cuts])
    score = lambda k: F.expr(f"(cast(a as decimal(19,0)) * {SCALE}) div (cast(l{k} as decimal(19,0)) + cast(r{k} as decimal(19,0)))")
    cut = lambda k: F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    best = both.select("lang", "phrase", "a", F.array_min(F.array(*[cut(k) for k in cuts])).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best_of(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank."""
    steps = found.groupBy("lang", F.expr(f"score div {STEP}").alias("step")).count()
    ahead = F.coalesce(F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lowest = steps.select("lang", "step", ahead.alias("ahead")).filter(F.col("ahead") < top).groupBy("lang").agg(F.min("step").alias("lowest"))
    found = found.join(lowest, "lang").filter(f"score div {STEP} >= lowest").drop("lowest")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))], ["lang"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return found


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, top: int = 2000, percent: int = 80) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to ``longest`` words that occur ``least`` times or more."""
    scratch = Scratch(docs.sparkSession, "phrases")
    cut = scratch.save(pieces(docs, text_col, lang_col), "pieces")
    n_words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    sizes = scratch.save(cut.groupBy("lang").agg(F.sum(F.col("times") * n_words).alias("n")), "sizes")
    levels = frequent_grams(cut, longest, least, scratch)
    scratch.drop("pieces")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    candidates = scratch.save(not_covered(levels, percent), "candidates")
    counts = reduce(DataFrame.union, [level.select("lang", "gram", "f") for level in levels[:-1]])
    found = scratch.save(scored(answered(candidates, counts, total), longest), "found")
    return best_of(found, top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
